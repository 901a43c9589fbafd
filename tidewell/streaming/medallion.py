"""The layers together."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewell.options import TABLES, Drive, LakeOptions
from tidewell.sources.events import EventSource
from tidewell.sources.table import LakeTable
from tidewell.streaming import bronze, gold, silver


def start_all(spark: SparkSession, options: LakeOptions, source: EventSource) -> list[StreamingQuery]:
    """Start the three streams side by side; each follows the one above it."""
    return [bronze.start(spark, options, source), silver.start(spark, options), gold.start(spark, options)]


def run_all(spark: SparkSession, options: LakeOptions, source: EventSource) -> None:
    """Run the layers: one after the other until all is taken, or side by side until one ends."""
    if options.drive is Drive.CONTINUOUS:
        queries = start_all(spark, options, source)
        try:
            spark.streams.awaitAnyTermination()
        finally:
            for q in queries:
                q.stop()
        return
    bronze.run(spark, options, source)
    silver.run(spark, options)
    gold.run(spark, options)


def row_counts(spark: SparkSession, options: LakeOptions) -> dict[str, int]:
    """Rows of each table that is there, from the manifests."""
    tables = {name: LakeTable(spark, options.table(name)) for name in TABLES}
    return {name: t.detail().rows for name, t in tables.items() if t.exists()}
