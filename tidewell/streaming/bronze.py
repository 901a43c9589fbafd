"""Bronze: events as they arrive, with their coordinates, partitioned by arrival date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.options import BRONZE, LakeOptions
from tidewell.sources.events import EventSource
from tidewell.streaming.support import application_id, configured, ensure_tables, finish

NAME = "bronze-ingest"


def arriving(raw: DataFrame) -> DataFrame:
    """Non-empty events with their time of arrival; nothing of the text decides where a row goes."""
    return raw.where(F.length("raw_value") > 0).withColumn("ingest_time", F.current_timestamp()).withColumn("ingest_date", F.to_date("ingest_time"))


def start(spark: SparkSession, options: LakeOptions, source: EventSource) -> StreamingQuery:
    table = ensure_tables(spark, options, BRONZE)[BRONZE]
    app = application_id(spark, options, NAME)

    def write(batch: DataFrame, number: int) -> None:
        table.append(batch, txn=(app, number))

    rows = arriving(source.read_stream(spark))
    return configured(rows.writeStream.outputMode("append").foreachBatch(write), options, NAME).start()


def run(spark: SparkSession, options: LakeOptions, source: EventSource) -> None:
    """Take in all events that are there."""
    finish(start(spark, options, source), options)
