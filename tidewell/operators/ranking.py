"""Ranks within groups that may be too large for one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    A session on one machine that names none gets a temporary folder; on a cluster
    that is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add each row's place (from 1) within its group, as ``row_number`` would.

    Rows are dealt out in ranges of (keys, order), ranked within their range, and
    shifted by what the group has in earlier ranges.  A group of any size is
    spread over tasks; the only table that is summed up across ranges has a row
    per group and range.  A column that has the rank's name already is replaced.
    """
    part, own, size, before = (_free(df, c) for c in ("range_id", "own_rank", "range_size", "earlier"))
    spread = settled(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()))
    sizes = spread.groupBy(part, *keys).agg(F.count(F.lit(1)).alias(size))
    sizes = sizes.withColumn(before, F.sum(size).over(Window.partitionBy(*keys).orderBy(part)) - F.col(size))
    sizes = sizes.select(*[F.col(c).alias(f"right_{c}") for c in (part, *keys)], before)
    ranked = spread.withColumn(own, F.row_number().over(Window.partitionBy(part, *keys).orderBy(*order)))
    match = F.lit(True)
    for c in (part, *keys):
        match &= ranked[c].eqNullSafe(sizes[f"right_{c}"])
    rank = (ranked[own] + sizes[before]).cast("long").alias(name)
    return ranked.join(sizes, match).select(*[ranked[c] for c in df.columns if c.lower() != name.lower()], rank)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over a row and those before it in its group; rows that are equal in order follow each other somehow.

    Spread over tasks as ``group_rank`` is.
    """
    part, own, whole, before = (_free(df, c) for c in ("range_id", "own_total", "range_total", "earlier"))
    spread = settled(df.withColumn(own, value.cast("long")).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()))
    totals = spread.groupBy(part, *keys).agg(F.sum(own).alias(whole))
    totals = totals.withColumn(before, F.sum(whole).over(Window.partitionBy(*keys).orderBy(part)) - F.col(whole))
    totals = totals.select(*[F.col(c).alias(f"right_{c}") for c in (part, *keys)], before)
    up_to_here = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = spread.withColumn(own, F.sum(own).over(up_to_here))
    match = F.lit(True)
    for c in (part, *keys):
        match &= summed[c].eqNullSafe(totals[f"right_{c}"])
    return summed.join(totals, match).select(*[summed[c] for c in df.columns if c.lower() != name.lower()], (summed[own] + totals[before]).alias(name))


def _free(df: DataFrame, stem: str) -> str:
    """A name that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (stem + "_" * k for k in range(len(taken) + 1)) if name.lower() not in taken)
