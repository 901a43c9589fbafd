"""Nearest players of all anchors against a scan of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import neighbours
from tidewell.operators.ranking import running_total

PLAYERS = "game_id string, region string, player_id string, rating int"


def plain(players, anchors, k):
    out = []
    for g, r, a, rating, reach in anchors:
        mine = 1200 if rating is None else rating
        if reach is None:
            continue
        near = sorted((abs((1200 if x is None else x) - mine), 1200 if x is None else x, p) for q, s, p, x in players if (q, s) == (g, r) and p is not None)
        out += [(g, r, a, mine, n, p, x, d) for n, (d, x, p) in enumerate([c for c in near if c[0] <= reach][:k], 1)]
    return out


@pytest.mark.parametrize("k", [1, 3, 12])
def test_all_anchors_by_a_scan(spark, rows, monkeypatch, k):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rnd = random.Random(k)
    players = [(rnd.choice("gh"), "r", f"p{i:03}", rnd.choice((None, 1200, 1201, rnd.randrange(0, 4000), rnd.randrange(1000, 1400)))) for i in range(250)]
    players += [("g", "r", f"hot{i:03}", 1300) for i in range(60)] + [(None, None, "lost", 5), (None, None, "found", 9), ("g", "r", None, 1200), players[0], players[0]]
    anchors = [(g, r, p, x, rnd.choice((0, 1, 50, 600, 10_000, None))) for g, r, p, x in players if p]
    anchors += [("g", "r", "guest", 1299, 40), ("h", "r", "low", -50, 3000), ("h", "r", "high", 9000, 100), ("empty", "r", "alone", 1200, 600), anchors[1]]
    frame = spark.createDataFrame(players, PLAYERS)
    asked = spark.createDataFrame(anchors, PLAYERS + ", reach int")
    found = neighbours.nearest_to_all(frame, asked, k, F.col("reach"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(players, anchors, k), key=key)


def test_empty_tables_and_bad_arguments(spark):
    frame = spark.createDataFrame([("g", "r", "p", 1)], PLAYERS)
    assert neighbours.nearest_to_all(frame.limit(0), frame, 3, F.lit(5)).count() == 0
    assert neighbours.nearest_to_all(frame, frame.limit(0), 3, F.lit(5)).count() == 0
    with pytest.raises(ValueError, match="neighbour"):
        neighbours.nearest_to_all(frame, frame, 0, F.lit(5))


def test_running_totals(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(("a", "b", None)), i, rnd.choice((0, 1, 5, -2))) for i in range(300)]
    got = running_total(spark.createDataFrame(data, "k string, i int, v int"), ["k"], ["i"], F.col("v"), "total").collect()
    sums: dict = {}
    want = {}
    for k, i, v in data:
        want[i] = sums[k] = sums.get(k, 0) + v
    assert {r.i: r.total for r in got} == want
