"""Rollups that can be added up: counts, sums, maxima and sketches per window.

A partial row holds for one window, game and region what any set of events came to.
Partial rows of different events merge into the row of all of them, rows of short windows into
those of long ones, and rows by game into those by region, without going back to the
events.  Distinct sessions are HyperLogLog sketches, reported uptimes KLL sketches.

Where estimates will not do, exact partial rows hold for one session as well, and counted uptimes
for one value; they merge in the same way and grow with the events instead of the windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import count_of
from tidewell.operators.gold import MINUTE
from tidewell.operators.percentile import percentiles

KEYS = ("game_id", "region")
#: Columns that add up: counts of event types, and others.
COUNTS = {
    "sessions_created": "SESSION_CREATED",
    "sessions_started": "SESSION_STARTED",
    "sessions_terminated": "SESSION_TERMINATED",
    "player_joins": "PLAYER_JOINED",
    "player_leaves": "PLAYER_LEFT",
}
SUMS = (*COUNTS, "event_count", "player_slot_events")
MAXIMA = ("peak_players",)
SESSIONS, UPTIMES = "sessions_sketch", "uptimes_sketch"
#: What exact partial rows have in place of sketches.
SESSION = "session_code"
#: 2**12 registers: a standard error of 1.6 %, and next to none up to some hundred sessions.
REGISTERS = 12
#: Items of a quantile sketch's levels: a rank is off by 0.36 % at most in 99 of 100 cases, and not at all up to so many values.
ITEMS = 1024


def partial(events: DataFrame, window: str = MINUTE, keys: Sequence[str] = KEYS, exact: bool = False) -> DataFrame:
    """Partial rows of some events: ``window_start, window_end``, keys, sums, maxima and sketches.

    With ``exact`` there is a row for each session as well, and no sketches.  Events without a time are in no window.
    """
    sketches = [F.hll_sketch_agg("session_code", REGISTERS).alias(SESSIONS), F.kll_sketch_agg_bigint(F.col("uptime_seconds").cast("long"), ITEMS).alias(UPTIMES)]
    by = (*keys, SESSION) if exact else keys
    rolled = events.where("event_time IS NOT NULL").groupBy(F.window("event_time", window).alias("w"), *by).agg(
        *[count_of(t).alias(n) for n, t in COUNTS.items()],
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("player_count").cast("long")).alias("player_slot_events"),
        F.max("player_count").alias("peak_players"),
        *([] if exact else sketches),
    )
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rolled.columns[1:])


def _is_exact(partials: DataFrame) -> bool:
    return SESSIONS not in partials.columns


def _added_up() -> list[Column]:
    return [*[F.sum(n).alias(n) for n in SUMS], *[F.max(n).alias(n) for n in MAXIMA]]


def combined(partials: DataFrame, keys: Sequence[str] = KEYS, window: str | None = None) -> DataFrame:
    """Partial rows merged by window and keys; fewer keys or a longer window, of whole old ones, merge further.

    Of a window as long as the old ones or none the old ones stay.  Sums of nothing but nulls are null.
    Exact rows stay one per session.
    """
    exact = _is_exact(partials)
    w = F.window("window_start", window) if window else F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    sketches = [] if exact else [F.hll_union_agg(SESSIONS).alias(SESSIONS), F.kll_merge_agg_bigint(UPTIMES, ITEMS).alias(UPTIMES)]
    merged = partials.groupBy(w.alias("w"), *keys, *([SESSION] if exact else [])).agg(*_added_up(), *sketches)
    return merged.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *merged.columns[1:])


def total(partials: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Partial rows merged over all of time: keys, sums, maxima, sketches."""
    whole = partials.select("*").withColumns({"window_start": F.lit(0).cast("timestamp"), "window_end": F.lit(0).cast("timestamp")})
    return combined(whole, keys).drop("window_start", "window_end")


def with_sessions(merged: DataFrame, keys: Sequence[str] = KEYS, name: str = "distinct_sessions") -> DataFrame:
    """Merged rows with their number of sessions: estimated from sketches; exact ones are counted and become one row per window and keys."""
    if not _is_exact(merged):
        return merged.withColumn(name, distinct_sessions())
    windows = [c for c in ("window_start", "window_end") if c in merged.columns]
    return merged.groupBy(*windows, *keys).agg(*_added_up(), F.count(SESSION).alias(name))


def distinct_sessions() -> Column:
    """The estimated number of sessions of a partial row."""
    return F.hll_sketch_estimate(SESSIONS)


def uptime_quantile(share: float) -> Column:
    """The least reported uptime that so great a share of them do not exceed, estimated; null without any."""
    return F.when(F.kll_sketch_get_n_bigint(UPTIMES) > 0, F.kll_sketch_get_quantile_bigint(UPTIMES, F.lit(float(share))))


def counted_uptimes(events: DataFrame, window: str = MINUTE, keys: Sequence[str] = KEYS) -> DataFrame:
    """``window_start, window_end``, keys, ``uptime_seconds, times``: reported uptimes, equal ones counted; rows of other events add up."""
    timed = events.where("event_time IS NOT NULL AND uptime_seconds IS NOT NULL")
    rolled = timed.groupBy(F.window("event_time", window).alias("w"), *keys, "uptime_seconds").agg(F.count(F.lit(1)).alias("times"))
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rolled.columns[1:])


def uptime_percentiles(counted: DataFrame, percents: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys, ``uptimes`` and a ``pN`` per percentage, exact, over all windows of counted uptimes."""
    merged = counted.groupBy(*keys, "uptime_seconds").agg(F.sum("times").alias("times"))
    found = percentiles(merged, "uptime_seconds", percents, by=keys, times="times").groupBy(*keys).agg(*[F.max(F.when(F.col("percent") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    sizes = merged.groupBy(*keys).agg(F.sum("times").alias("uptimes")).withColumnsRenamed({k: f"of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return found.join(sizes, same).select(*keys, "uptimes", *[f"p{p}" for p in percents])


def lifecycle(partials: DataFrame, window: str | None = None) -> DataFrame:
    """The lifecycle rollup from partial rows."""
    names = [n for n in SUMS if n != "player_slot_events"]
    merged = with_sessions(combined(partials, KEYS, window), KEYS)
    return merged.select("window_start", "window_end", *KEYS, *names, "distinct_sessions", F.col("peak_players").alias("peak_players_in_a_session"))


def concurrency(partials: DataFrame, window: str | None = None) -> DataFrame:
    """The concurrency rollup from partial rows; games merge into their regions."""
    merged = with_sessions(combined(partials, ("region",), window), ("region",), "active_sessions")
    return merged.select("window_start", "window_end", "region", "active_sessions", "player_slot_events", F.col("peak_players").alias("peak_session_size"), "event_count")
