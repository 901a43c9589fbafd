"""The data contract: the event envelope and the schemas of all tables.

Field names, types and their order are fixed by the producers of the events and
by the readers of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1

#: Fixed values.
EVENT_TYPES = ("SESSION_CREATED", "PLAYER_JOINED", "PLAYER_LEFT", "SESSION_STARTED", "SESSION_TERMINATED")
SESSION_STATES = ("WAITING", "STARTING", "ACTIVE", "PAUSED", "TERMINATED")
LIVE_STATES = ("WAITING", "STARTING", "ACTIVE", "PAUSED")
JOINABLE_STATES = ("WAITING", "STARTING", "ACTIVE")
GAMES = ("cyberpunk-2077", "fortnite", "rocket-league", "apex-legends")
REGIONS = ("us-west-2", "us-east-1", "eu-central-1", "ap-northeast-1")

# Names, types and order of the envelope's fields and of all tables' columns.
_PLAYER = "struct<playerId:string,displayName:string,region:string,joinedAt:string,connected:boolean>"
_SESSION = (
    f"struct<id:string,sessionCode:string,gameId:string,region:string,state:string,host:{_PLAYER},players:array<{_PLAYER}>,"
    "maxPlayers:int,minPlayersToStart:int,createdAt:string,updatedAt:string,expiresAt:string,currentPlayerCount:int,isFull:boolean,uptimeSeconds:bigint>"
)
#: Times are strings on the wire and parsed with the rules of the silver layer.
ENVELOPE = f"eventId string, eventTime string, type string, sessionCode string, schemaVersion int, session {_SESSION}"

SOURCE = "raw_value string, source_key string, source_partition int, source_offset bigint, source_timestamp timestamp"
BRONZE_SCHEMA = f"{SOURCE}, ingest_time timestamp, ingest_date date"
_PARSED = (
    "event_id string, event_time timestamp, event_type string, session_code string, schema_version int, game_id string, region string,"
    " session_state string, host_player_id string, player_count int, max_players int, min_players_to_start int, is_full boolean,"
    " uptime_seconds bigint, session_created_at timestamp, session_updated_at timestamp"
)
SILVER_SCHEMA = f"{_PARSED}, source_partition int, source_offset bigint, ingest_time timestamp, event_date date"
QUARANTINE_SCHEMA = (
    f"{_PARSED}, raw_value string, source_partition int, source_offset bigint, ingest_time timestamp,"
    " quality_failures array<string>, quarantined_at timestamp, failure_count int"
)
LIFECYCLE_SCHEMA = (
    "window_start timestamp, window_end timestamp, game_id string, region string, sessions_created bigint, sessions_started bigint,"
    " sessions_terminated bigint, player_joins bigint, player_leaves bigint, event_count bigint, distinct_sessions bigint,"
    " peak_players_in_a_session int, computed_at timestamp"
)
CONCURRENCY_SCHEMA = (
    "window_start timestamp, window_end timestamp, region string, active_sessions bigint, player_slot_events bigint,"
    " peak_session_size int, event_count bigint, computed_at timestamp"
)
DURATION_SCHEMA = (
    "session_code string, game_id string, region string, first_event_at timestamp, last_event_at timestamp, peak_players int, capacity int,"
    " event_count bigint, start_events bigint, terminate_events bigint, reported_uptime_seconds bigint, observed_duration_seconds bigint,"
    " duration_seconds bigint, completed boolean, computed_at timestamp"
)
FUNNEL_SCHEMA = (
    "game_id string, region string, sessions_observed bigint, sessions_started bigint, sessions_terminated bigint,"
    " p50_duration_seconds bigint, p95_duration_seconds bigint, avg_peak_players double, start_rate double, computed_at timestamp"
)

#: Table -> schema, partition columns.
TABLE_SCHEMAS: dict[str, tuple[str, tuple[str, ...]]] = {
    "bronze_session_events": (BRONZE_SCHEMA, ("ingest_date",)),
    "silver_session_events": (SILVER_SCHEMA, ("event_date",)),
    "silver_quarantine": (QUARANTINE_SCHEMA, ()),
    "gold_session_lifecycle_1m": (LIFECYCLE_SCHEMA, ()),
    "gold_region_concurrency_1m": (CONCURRENCY_SCHEMA, ()),
    "gold_session_duration": (DURATION_SCHEMA, ()),
    "gold_matchmaking_funnel": (FUNNEL_SCHEMA, ()),
}
LIFECYCLE_KEY = ("window_start", "game_id", "region")
CONCURRENCY_KEY = ("window_start", "region")


def struct(schema: str) -> StructType:
    """A schema string as a type."""
    return StructType.fromDDL(schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows."""
    return spark.createDataFrame([], struct(schema))
