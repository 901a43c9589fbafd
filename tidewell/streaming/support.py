"""Starting, driving and ending streaming queries."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tidewell.functions.contract import TABLE_SCHEMAS
from tidewell.options import Drive, LakeOptions
from tidewell.sources.storage import Storage
from tidewell.sources.table import LakeTable


def configured(writer: DataStreamWriter, options: LakeOptions, name: str) -> DataStreamWriter:
    """Name, checkpoint and trigger of a query."""
    writer = writer.queryName(name).option("checkpointLocation", options.checkpoint(name))
    if options.drive is Drive.AVAILABLE_NOW:
        return writer.trigger(availableNow=True)
    seconds = options.interval.total_seconds() if options.drive is Drive.CONTINUOUS else 0
    return writer.trigger(processingTime=f"{seconds:g} seconds")


def finish(query: StreamingQuery, options: LakeOptions) -> None:
    """Wait until the query has taken all that is there; a continuous query runs on until stopped."""
    if options.drive is Drive.RATE_LIMITED:
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return
    query.awaitTermination()


def run_batches(query: StreamingQuery, batches: int, timeout: float | None = 120) -> int:
    """Let a query commit so many batches with rows, then stop it; returns how many it had.

    Without ``timeout`` batches of any length are waited for; one that is cut off is work lost.
    """
    end = time.time() + timeout if timeout else float("inf")
    done = 0
    while time.time() < end and query.isActive and done < batches:
        done = len({p.batchId for p in query.recentProgress if p.numInputRows})
        time.sleep(0.05)
    query.stop()
    return done


def application_id(spark: SparkSession, options: LakeOptions, name: str) -> str:
    """An id that lives and dies with the query's checkpoint.

    Batch numbers start anew with a new checkpoint, so they only identify a batch
    together with this.
    """
    folder = options.checkpoint(name)
    storage = Storage(spark, folder)
    path = f"{storage.root}/application-id"
    if not storage.exists(path):
        storage.make(storage.root)
        storage.publish(path, f"{name}-{uuid.uuid4().hex}")
    return storage.read(path)


def ensure_tables(spark: SparkSession, options: LakeOptions, *names: str) -> dict[str, LakeTable]:
    """The named tables, made from their declared schemas where they are missing.

    A downstream stream can then start before the first row arrives.
    """
    out = {}
    for name in names:
        out[name] = LakeTable(spark, options.table(name))
        out[name].create(*TABLE_SCHEMAS[name])
    return out
