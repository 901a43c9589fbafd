"""From raw event text to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import quality
from tidewell.functions.contract import ENVELOPE
from tidewell.functions.scalars import event_key, lenient_timestamp

DEDUP_KEY = "dedup_key"

#: Column of the silver layer <- field of the envelope; the contract of both sides.
FIELDS = (
    ("event_id", "eventId"), ("event_time", "eventTime"), ("event_type", "type"), ("session_code", "sessionCode"), ("schema_version", "schemaVersion"),
    ("game_id", "session.gameId"), ("region", "session.region"), ("session_state", "session.state"), ("host_player_id", "session.host.playerId"),
    ("player_count", "session.currentPlayerCount"), ("max_players", "session.maxPlayers"), ("min_players_to_start", "session.minPlayersToStart"),
    ("is_full", "session.isFull"), ("uptime_seconds", "session.uptimeSeconds"), ("session_created_at", "session.createdAt"), ("session_updated_at", "session.updatedAt"),
)
_TIMES = {"event_time", "session_created_at", "session_updated_at"}


def parse(bronze: DataFrame, keep: tuple[str, ...] = ("raw_value", "source_partition", "source_offset", "ingest_time")) -> DataFrame:
    """Flatten the JSON envelope in ``raw_value``; unparsable parts become null.

    The text is parsed once per row under the declared schema, never inferred;
    fields that the contract does not name are ignored.
    """
    # A generator of one row keeps the optimizer from repeating the parse in every expression above it.
    opened = bronze.select(*dict.fromkeys((*keep, "raw_value")), F.explode(F.array(F.from_json("raw_value", ENVELOPE))).alias("envelope"))
    columns = [F.col(f"envelope.{path}") for _, path in FIELDS]
    typed = [(lenient_timestamp(c) if name in _TIMES else c).alias(name) for c, (name, _) in zip(columns, FIELDS, strict=True)]
    return opened.select(*typed, *keep)


def prepare(bronze: DataFrame) -> DataFrame:
    """Parse, annotate with broken rules and add the deduplication key."""
    return quality.annotate(parse(bronze)).withColumn(DEDUP_KEY, event_key(F.col("event_id"), F.col("raw_value")))
