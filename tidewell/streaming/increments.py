"""Gold by increments: each batch of newly accepted events adds partial rows, and nothing is read again.

A batch's partial rows are a folder of their own, named after the batch, that a replay of
the batch writes anew; so each event counts once however often its batch is tried.  Readers merge
the few rows that a window has.  Batches may hold events of any windows, in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.gold import MINUTE
from tidewell.operators.partials import combined, partial
from tidewell.options import SILVER, LakeOptions
from tidewell.sources.log_tail import added_rows, commits
from tidewell.streaming.support import configured, ensure_tables, finish

NAME = "gold-increments"


def folder(options: LakeOptions) -> str:
    return f"{options.base}/partials"


def write_batch(events: DataFrame, number: int, path: str, window: str = MINUTE, exact: bool = False) -> None:
    """Put a batch's partial rows into its folder, in place of what an earlier try left there; ``exact`` ones are per session."""
    partial(events, window, exact=exact).write.mode("overwrite").parquet(f"{path}/batch={number}")


def start(spark: SparkSession, options: LakeOptions, exact: bool = False) -> StreamingQuery:
    """Follow silver's newly accepted rows."""
    silver = ensure_tables(spark, options, SILVER)[SILVER]

    def write(batch: DataFrame, number: int) -> None:
        write_batch(added_rows(batch, spark, silver.path), number, folder(options), options.window_text, exact)

    stream = commits(silver, options.max_files)
    return configured(stream.writeStream.outputMode("append").foreachBatch(write), options, NAME).start()


def run(spark: SparkSession, options: LakeOptions, exact: bool = False) -> None:
    """Bring the partial rows up to silver."""
    finish(start(spark, options, exact), options)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All batches' partial rows, merged to one per window, game and region, and session if they are exact."""
    return combined(spark.read.parquet(path))
