"""Gold: windowed rollups kept up with silver, and per-session rollups computed whole.

A batch of new events recomputes exactly the windows it touches, from all of
silver, and replaces them.  However late an event is, its window comes out right,
and doing a batch again changes nothing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.contract import CONCURRENCY_KEY, LIFECYCLE_KEY
from tidewell.operators import gold as rollups
from tidewell.options import CONCURRENCY, DURATION, FUNNEL, LIFECYCLE, SILVER, Drive, LakeOptions
from tidewell.sources.log_tail import added_rows, commits
from tidewell.sources.table import LakeTable
from tidewell.streaming.support import configured, ensure_tables, finish

NAME = "gold-aggregates"


def refresh(batch: DataFrame, silver: LakeTable, lifecycle: LakeTable, concurrency: LakeTable, window: str) -> None:
    """Recompute the windows that a batch of silver rows touches.

    Silver is read at its latest version, which holds the batch, and only the
    dates that a touched window lies on are read, however far apart they are.
    """
    w = F.window("event_time", window)
    days = batch.select(F.explode(F.sequence(F.to_date(w["start"]), F.to_date(w["end"]))).alias("day")).distinct()
    dates = sorted(r["day"] for r in days.collect())  # a row per date
    if not dates:
        return
    near = silver.read(where=[("event_date", "in", dates)])
    scope = rollups.in_touched_windows(near, batch, window).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lifecycle.upsert(rollups.stamped(rollups.lifecycle(scope, window)), LIFECYCLE_KEY, prune="window_start")
        concurrency.upsert(rollups.stamped(rollups.concurrency(scope, window)), CONCURRENCY_KEY, prune="window_start")
    finally:
        scope.unpersist()


def run_session_tables(spark: SparkSession, options: LakeOptions) -> None:
    """Recompute the per-session tables from the whole of silver; durations are computed once for both."""
    tables = ensure_tables(spark, options, SILVER, DURATION, FUNNEL)
    durations = rollups.session_durations(tables[SILVER].read()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tables[DURATION].overwrite(rollups.stamped(durations))
        tables[FUNNEL].overwrite(rollups.stamped(rollups.matchmaking_funnel(durations)))
    finally:
        durations.unpersist()


def start(spark: SparkSession, options: LakeOptions) -> StreamingQuery:
    tables = ensure_tables(spark, options, SILVER, LIFECYCLE, CONCURRENCY)

    def write(batch: DataFrame, number: int) -> None:
        rows = added_rows(batch, spark, tables[SILVER].path)
        refresh(rows, tables[SILVER], tables[LIFECYCLE], tables[CONCURRENCY], options.window_text)
        if options.drive is Drive.CONTINUOUS:
            run_session_tables(spark, options)

    stream = commits(tables[SILVER], options.max_files)
    return configured(stream.writeStream.outputMode("append").foreachBatch(write), options, NAME).start()


def run(spark: SparkSession, options: LakeOptions) -> None:
    """Bring all gold tables up to silver."""
    finish(start(spark, options), options)
    run_session_tables(spark, options)
