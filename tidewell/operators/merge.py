"""Table mutations as joins, for any two frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """One row per key: the first by ``order``, which makes the choice repeatable.

    Without an order any row may survive, which costs no sort.
    """
    if not order:
        return df.dropDuplicates(list(keys))
    taken = {c.lower() for c in df.columns}
    place = next(n for n in (f"place_{k}" for k in range(len(taken) + 1)) if n not in taken)
    ranked = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(place) == 1).drop(place)


def absent_from(source: DataFrame, target: DataFrame, keys: Sequence[str], within: Column | None = None) -> DataFrame:
    """Rows of ``source`` whose key the target does not have (insert if absent).

    ``within`` limits the target's rows that are looked at; a condition on
    partition columns keeps old partitions from being read.  Null keys never
    match, so they are inserted.
    """
    seen = target if within is None else target.where(within)
    return source.join(seen.select(*keys), list(keys), "left_anti").select(*source.columns)


def upserted(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the source's rows in place of those with the same key (update or insert)."""
    kept = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def touching(rows: DataFrame, touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that belong to one of the touched keys."""
    return rows.join(touched.select(*keys).distinct(), list(keys), "left_semi").select(*rows.columns)
