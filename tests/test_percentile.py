"""Percentiles against sorted lists."""

import math
import random

from tidewell.operators.percentile import percentiles


def plain(values, percent, rule):
    n = len(values)
    rank = math.ceil(percent / 100 * n) if rule == "nearest" else round(percent / 100 * n + 0.5)
    return sorted(values)[max(1, min(n, rank)) - 1]


def test_ties_nulls_and_keys(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(("a", "b", None)), rnd.choice((7, 7, 7, 7, rnd.randrange(100), None))) for _ in range(400)] + [("one", 5), ("none", None)]
    frame = spark.createDataFrame(rows, "percent string, value int")
    for rule in ("nearest", "rounded"):
        got = {(r.k, r.percent): r.value for r in percentiles(frame.withColumnRenamed("percent", "k"), "value", (0, 1, 50, 95, 100), rule, by=["k"]).collect()}
        held = {k: [v for q, v in rows if q == k and v is not None] for k in ("a", "b", None, "one")}
        assert got == {(k, p): plain(v, p, rule) for k, v in held.items() for p in (0, 1, 50, 95, 100)}
        whole = {r.percent: r.value for r in percentiles(frame, "value", (50, 99), rule).collect()}
        assert whole == {p: plain([v for _, v in rows if v is not None], p, rule) for p in (50, 99)}
    assert percentiles(frame.limit(0), "value", (50,)).count() == 0


def test_ties_are_counted_before_they_are_ranked(spark):
    """However many rows share a value, one row of it is dealt out to be ranked."""
    from tidewell.operators import percentile

    seen = []
    kept = percentile.running_total
    percentile.running_total = lambda df, *a: seen.append(df.count()) or kept(df, *a)
    try:
        assert percentiles(spark.range(50_000).selectExpr("id % 3 AS value"), "value", (50,)).first().value == 1
    finally:
        percentile.running_total = kept
    assert seen == [3]
