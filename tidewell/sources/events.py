"""Sources of raw events.  All give the same five columns, with or without a stream."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.options import LakeOptions


class EventSource(Protocol):
    """Where raw events come from."""

    def read_stream(self, spark: SparkSession) -> DataFrame:
        """raw_value, source_key, source_partition, source_offset, source_timestamp."""

    def describe(self) -> str:
        """A line for people."""


@dataclass(frozen=True)
class FileEventSource:
    """One event per line of the files that appear in the landing folder.

    ``source_timestamp`` is the time of reading, since copying a file changes its own.
    """

    options: LakeOptions
    max_files: int | None = None

    def read_stream(self, spark: SparkSession) -> DataFrame:
        limit = self.max_files or self.options.max_files
        lines = spark.readStream.option("maxFilesPerTrigger", limit).text(self.options.landing)
        return lines.select(
            F.col("value").alias("raw_value"),
            F.col("_metadata.file_name").alias("source_key"),
            F.lit(-1).alias("source_partition"),
            F.lit(-1).cast("long").alias("source_offset"),
            F.current_timestamp().alias("source_timestamp"),
        )

    def describe(self) -> str:
        return f"files in {self.options.landing}"


@dataclass(frozen=True)
class KafkaEventSource:
    """A topic; needs Spark's Kafka connector on the class path."""

    options: LakeOptions

    def read_stream(self, spark: SparkSession) -> DataFrame:
        o = self.options
        settings = {"kafka.bootstrap.servers": o.kafka_servers, "subscribe": o.kafka_topic, "startingOffsets": o.starting_offsets, "failOnDataLoss": "false"}
        rows = spark.readStream.format("kafka").options(**settings).load()
        return rows.select(
            F.col("value").cast("string").alias("raw_value"),
            F.col("key").cast("string").alias("source_key"),
            F.col("partition").alias("source_partition"),
            F.col("offset").alias("source_offset"),
            F.col("timestamp").alias("source_timestamp"),
        )

    def describe(self) -> str:
        return f"topic {self.options.kafka_topic} at {self.options.kafka_servers}"


def write_events(df: DataFrame, options: LakeOptions, value: str = "raw_value", key: str = "session_code") -> None:
    """Send events to the topic, keyed so that a session's events stay in order."""
    df.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")).write.format("kafka").options(
        **{"kafka.bootstrap.servers": options.kafka_servers, "topic": options.kafka_topic}
    ).save()
