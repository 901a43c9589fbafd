"""A table's commits as a stream.

The log's manifests are read by Spark's own file stream, so offsets, rate limits
and restarts are the engine's.  A manifest becomes visible whole and once, and a
batch of manifests names the data files that came with it.  Commits that only
move rows, such as compaction, are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.table import COMMIT_SCHEMA, LakeTable


def commits(table: LakeTable, max_commits: int | None = None) -> DataFrame:
    """The stream of a table's manifests, at most ``max_commits`` in a batch."""
    reader = table.spark.readStream.schema(COMMIT_SCHEMA).option("pathGlobFilter", "[0-9]*.json")
    if max_commits:
        reader = reader.option("maxFilesPerTrigger", max_commits)
    return reader.json(table.log)


def added_rows(batch: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The rows that a batch of manifests added to the table."""
    names = batch.where("data_change").select(F.explode("add.path").alias("path")).distinct().collect()
    return LakeTable(spark, path).rows_of(sorted(r["path"] for r in names))
