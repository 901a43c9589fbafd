"""Silver: parsed, checked and deduplicated events; rejected ones go to quarantine.

Deduplication is by what the table holds, not by a state with a watermark: a
replay brings events in any order, and a watermark would drop them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions import quality
from tidewell.operators.envelope import DEDUP_KEY, prepare
from tidewell.operators.merge import first_of_each
from tidewell.options import BRONZE, QUARANTINE, SILVER, LakeOptions
from tidewell.sources.log_tail import added_rows, commits
from tidewell.sources.table import LakeTable
from tidewell.streaming.support import application_id, configured, ensure_tables, finish

NAME = "silver-transform"


def accepted(prepared: DataFrame) -> DataFrame:
    """Valid rows, one per event: the first to arrive."""
    good = prepared.where(quality.is_valid())
    good = first_of_each(good, [DEDUP_KEY], "ingest_time", "source_partition", "source_offset", "raw_value")
    return good.drop(DEDUP_KEY, quality.FAILURES, "raw_value").withColumn("event_date", F.to_date("event_time"))


def rejected(prepared: DataFrame) -> DataFrame:
    """Rows that break rules, with their text and what they break."""
    bad = prepared.where(~quality.is_valid()).drop(DEDUP_KEY)
    return bad.withColumn("quarantined_at", F.current_timestamp()).withColumn("failure_count", F.size(quality.FAILURES))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores: bronze's few files are a task each, however long their texts take to parse."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= tasks:
        return rows
    name = next(n for n in (f"deal_{k}" for k in range(len(rows.columns) + 1)) if n not in rows.columns)
    return rows.withColumn(name, F.monotonically_increasing_id()).repartition(tasks, name).drop(name)


def write_batch(bronze_rows: DataFrame, silver: LakeTable, quarantine: LakeTable, txn: tuple[str, int], prune: bool = True) -> int:
    """Send one batch to both tables; returns how many events were new.

    The batch is parsed once.  Silver takes only what it lacks, so a replay adds
    nothing; quarantine has no key and goes by the batch number.  An event's
    identity is its id within the batch's dates, or everywhere without ``prune``.
    """
    prepared = prepare(spread(bronze_rows)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        new = silver.insert_if_absent(accepted(prepared), ["event_id"], prune="event_date" if prune else None)
        bad = rejected(prepared)
        if not bad.isEmpty():
            quarantine.append(bad, txn=txn, merge_schema=True)
        return new
    finally:
        prepared.unpersist()


def start(spark: SparkSession, options: LakeOptions, prune: bool = True) -> StreamingQuery:
    tables = ensure_tables(spark, options, BRONZE, SILVER, QUARANTINE)
    app = application_id(spark, options, NAME)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(added_rows(batch, spark, tables[BRONZE].path), tables[SILVER], tables[QUARANTINE], (app, number), prune)

    stream = commits(tables[BRONZE], options.max_files)
    return configured(stream.writeStream.outputMode("append").foreachBatch(write), options, NAME).start()


def run(spark: SparkSession, options: LakeOptions) -> None:
    """Bring silver up to bronze."""
    finish(start(spark, options), options)
