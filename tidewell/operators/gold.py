"""Rollups of session events.

Windowed rollups take their window from the event time.  Distinct sessions are
counted by sketch, as a trend line needs no more; ``exact=True`` counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import count_of, seconds_between
from tidewell.operators.ranking import running_total

MINUTE = "1 minute"


def _distinct(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column)


def lifecycle(events: DataFrame, window: str = MINUTE, exact: bool = False) -> DataFrame:
    """Per window, game and region: what happened to sessions."""
    rolled = events.groupBy(F.window("event_time", window).alias("w"), "game_id", "region").agg(
        count_of("SESSION_CREATED").alias("sessions_created"),
        count_of("SESSION_STARTED").alias("sessions_started"),
        count_of("SESSION_TERMINATED").alias("sessions_terminated"),
        count_of("PLAYER_JOINED").alias("player_joins"),
        count_of("PLAYER_LEFT").alias("player_leaves"),
        F.count(F.lit(1)).alias("event_count"),
        _distinct("session_code", exact).alias("distinct_sessions"),
        F.max("player_count").alias("peak_players_in_a_session"),
    )
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rolled.columns[1:])


def concurrency(events: DataFrame, window: str = MINUTE, exact: bool = False) -> DataFrame:
    """Per window and region: the load that a region carried."""
    rolled = events.groupBy(F.window("event_time", window).alias("w"), "region").agg(
        _distinct("session_code", exact).alias("active_sessions"),
        F.sum("player_count").alias("player_slot_events"),
        F.max("player_count").alias("peak_session_size"),
        F.count(F.lit(1)).alias("event_count"),
    )
    return rolled.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rolled.columns[1:])


def session_durations(events: DataFrame) -> DataFrame:
    """A row per session, ended or not: how long it ran and how large it became.

    The reported uptime is that of the latest event; of events at one time, that
    with the greatest id.
    """
    order = F.struct("event_time", *(["event_id"] if "event_id" in events.columns else []))
    per_session = events.groupBy("session_code").agg(
        F.max("game_id").alias("game_id"),
        F.max("region").alias("region"),
        F.min("event_time").alias("first_event_at"),
        F.max("event_time").alias("last_event_at"),
        F.max("player_count").alias("peak_players"),
        F.max("max_players").alias("capacity"),
        F.count(F.lit(1)).alias("event_count"),
        count_of("SESSION_STARTED").alias("start_events"),
        count_of("SESSION_TERMINATED").alias("terminate_events"),
        F.max_by("uptime_seconds", order).alias("reported_uptime_seconds"),
    )
    observed = seconds_between(F.col("first_event_at"), F.col("last_event_at"))
    return per_session.select(
        "*",
        observed.alias("observed_duration_seconds"),
        F.coalesce("reported_uptime_seconds", observed).alias("duration_seconds"),
        (F.col("terminate_events") > 0).alias("completed"),
    )


def matchmaking_funnel(durations: DataFrame) -> DataFrame:
    """Per game and region: observed, started and ended sessions, and how long they ran.

    Percentiles are exact: the least duration that so great a share of a group's do not exceed.
    Equal durations are counted first and ranks are running sums, so a group of any size is
    spread over tasks.  Without any duration they are null.
    """
    keys = ["game_id", "region"]
    every = F.count(F.lit(1))
    sums = {"sessions_observed": every, "sessions_started": F.count_if(F.col("start_events") > 0), "sessions_terminated": F.count_if(F.col("terminate_events") > 0),
            "timed": F.count("duration_seconds"), "peaks_sum": F.sum("peak_players"), "peaks": F.count("peak_players")}
    counted = durations.groupBy(*keys, "duration_seconds").agg(*[c.alias(n) for n, c in sums.items()])
    placed = running_total(counted, keys, ["duration_seconds"], F.col("timed"), "upto")
    totals = placed.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums]).withColumnsRenamed({k: f"of_{k}" for k in keys})
    places = placed.select(*keys, "duration_seconds", "upto")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    reached = {p: F.min(F.when(F.col("upto") * 100 >= F.col("timed") * p, F.col("duration_seconds"))) for p in (50, 95)}
    rolled = places.join(totals, same).groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in sums],
        *[c.alias(f"p{p}_duration_seconds") for p, c in reached.items()],
    )
    return rolled.select(
        *keys, "sessions_observed", "sessions_started", "sessions_terminated", "p50_duration_seconds", "p95_duration_seconds",
        (F.col("peaks_sum") / F.when(F.col("peaks") > 0, F.col("peaks"))).alias("avg_peak_players"),
        F.round(F.col("sessions_started") / F.col("sessions_observed"), 4).alias("start_rate"),
    )


def stamped(df: DataFrame) -> DataFrame:
    """Add the time of computation."""
    return df.withColumn("computed_at", F.current_timestamp())


def in_touched_windows(events: DataFrame, batch: DataFrame, window: str = MINUTE) -> DataFrame:
    """All events of the windows that a batch has events in, and of no others.

    Windows are compared by their start, so a late event that comes alone brings
    back its whole window.
    """
    start = F.window("event_time", window).getField("start")
    touched = batch.where("event_time is not null").select(start.alias("touched_start")).distinct()
    marked = events.withColumn("touched_start", start)
    return marked.join(touched, "touched_start", "left_semi").drop("touched_start")
