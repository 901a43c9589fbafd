"""File layout: clustering rows by several columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges per column are 2 ** BITS; boundaries come from a sample of so many rows.
BITS, SAMPLE_ROWS = 6, 20_000


def _boundaries(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    total = df.count()
    share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, total))
    sample = df.select(*columns) if share == 1.0 else df.select(*columns).sample(share, seed=11)
    rows = sample.collect()  # about SAMPLE_ROWS, from all partitions alike
    out = {}
    for c in columns:
        values = sorted(r[c] for r in rows if r[c] is not None)
        out[c] = sorted({values[len(values) * k // (1 << BITS)] for k in range(1, 1 << BITS)}) if values else []
    return out


def _range_of(column: str, edges: list) -> Column:
    """The number of boundaries at or below a value; nulls come first."""
    if not edges:
        return F.lit(0)
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(at)


def z_value(df: DataFrame, columns: Sequence[str]) -> Column:
    """Interleaved bits of the columns' ranges, low bits first.

    The boundaries are sampled, so ranges hold about as many rows each whatever
    the values' distribution.
    """
    edges = _boundaries(df, columns)
    z = F.lit(0).cast("long")
    for j, c in enumerate(columns):
        place = _range_of(c, edges[c]).cast("long")
        for bit in range(BITS):
            one = F.shiftright(place, bit).bitwiseAND(F.lit(1))
            z = z + F.shiftleft(one, bit * len(columns) + j)
    return z


def z_ordered(df: DataFrame, columns: Sequence[str], partitions: int, within: Sequence[str] = ()) -> DataFrame:
    """Rows in ``partitions`` ranges of the interleaved value, sorted within each.

    With ``within`` the ranges first follow those columns, so that a range holds one
    or few of their values.
    """
    name = next(n for n in (f"z_{k}" for k in range(len(df.columns) + 1)) if n not in df.columns)
    placed = df.withColumn(name, z_value(df, columns))
    return placed.repartitionByRange(partitions, *within, name, *columns).sortWithinPartitions(*within, name, *columns).drop(name)
