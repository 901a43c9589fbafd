"""Percentiles by rank, exact and without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranking import running_total

#: Rank of the p-th percentile of n values; the two rules differ and are not to be mixed.
RULES = {"nearest": "ceil(percent / 100.0D * n)", "rounded": "bround(percent / 100.0D * n + 0.5D, 0)"}


def percentiles(df: DataFrame, value: str, percents: Sequence[int], rule: str = "nearest", by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """``by``, ``percent, value``: the value at the rank that the rule gives, within 1 to the number of values.

    Values are counted first, so ties are one row each, and ranks are running sums of
    the counts.  Null values do not count; without values there are no rows.  Null keys are keys.
    With ``times`` that column has how often each row's value counts, at least once.
    """
    own = [f"key_{i}" for i in range(len(by))]
    values = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, own, strict=True)], F.col(value).alias("value"), (F.col(times) if times else F.lit(1)).cast("long").alias("each")).where("value is not null")
    counts = values.groupBy(*own, "value").agg(F.sum("each").alias("times"))
    placed = running_total(counts, own, ["value"], F.col("times"), "upto")
    n = placed.groupBy(*own).agg(F.max("upto").alias("n"))
    wanted = n.select(*own, "n", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    wanted = wanted.select(*[F.col(k).alias(f"of_{k}") for k in own], "percent", F.expr(f"CAST(greatest(1, least(n, {RULES[rule]})) AS BIGINT)").alias("rank"))
    # One row has each rank: the first that reaches it.
    at = (F.col("rank") > F.col("upto") - F.col("times")) & (F.col("rank") <= F.col("upto"))
    for k in own:
        at &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    found = placed.join(F.broadcast(wanted) if not by else wanted, at)  # without keys there is a row per percentile
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, own, strict=True)], "percent", "value")
