"""Named expectations on rows: annotate each row with the rules it breaks, split on that.

A rule holds only if its condition is true; a null condition breaks it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.contract import EVENT_TYPES, SCHEMA_VERSION, SESSION_STATES

FAILURES = "quality_failures"


@dataclass(frozen=True)
class Expectation:
    """A rule: its name and the condition that good rows meet."""

    name: str
    condition: Column


def session_rules() -> list[Expectation]:
    """The rules of the silver layer, in reporting order."""
    c = F.col
    return [
        Expectation("envelope_parses", c("event_id").isNotNull()),
        Expectation("event_time_parses", c("event_time").isNotNull()),
        Expectation("event_type_known", c("event_type").isin(*EVENT_TYPES)),
        Expectation("session_code_present", c("session_code").isNotNull() & (c("session_code") != "")),
        Expectation("game_id_present", c("game_id").isNotNull()),
        Expectation("region_present", c("region").isNotNull()),
        Expectation("session_state_known", c("session_state").isin(*SESSION_STATES)),
        Expectation("player_count_non_negative", c("player_count") >= 0),
        Expectation("max_players_positive", c("max_players") > 0),
        Expectation("player_count_within_capacity", c("player_count") <= c("max_players")),
        Expectation("schema_version_supported", c("schema_version") <= SCHEMA_VERSION),
    ]


def broken(rules: Sequence[Expectation]) -> Column:
    """The names of the rules that a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(r.condition, F.lit(None)).otherwise(F.lit(r.name)) for r in rules]))


def annotate(df: DataFrame, rules: Sequence[Expectation] | None = None) -> DataFrame:
    """Add ``quality_failures``."""
    return df.withColumn(FAILURES, broken(session_rules() if rules is None else rules))


def is_valid() -> Column:
    return F.size(FAILURES) == 0


def split(df: DataFrame, rules: Sequence[Expectation] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, without the annotation, and the others with it."""
    marked = annotate(df, rules)
    return marked.where(is_valid()).drop(FAILURES), marked.where(~is_valid())
