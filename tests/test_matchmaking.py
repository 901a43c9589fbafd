"""Matchmaking against plain scans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.scalars import ExpandingWindow, human_bytes, rating_is_valid
from tidewell.operators import matchmaking as mm
from tidewell.operators.ranking import group_rank

NOW = dt.datetime(2026, 8, 27, 12)
SCHEMA = "game_id string, region string, player_id string, rating int, enqueued_at timestamp_ntz"


def players(spark, rows):
    return spark.createDataFrame([("g", "r", p, rating, NOW - dt.timedelta(seconds=w)) for p, rating, w in rows], SCHEMA)


def scan_party(waiting, size, window=None):
    """One attempt by a plain scan: rows are (id, rating, seconds waited)."""
    window = window or ExpandingWindow()
    if not waiting:
        return None
    anchor = min(waiting, key=lambda p: (-p[2], p[0]))
    width = window.width(anchor[2])
    near = sorted((p for p in waiting if abs(p[1] - anchor[1]) <= width), key=lambda p: (abs(p[1] - anchor[1]), p[1], p[0]))[: 3 * size]
    party = [anchor, *[p for p in near if p != anchor]][:size]
    return [p[0] for p in party] if len(party) == size else None


def party_of(df):
    return [r.player_id for r in df.orderBy("seat").collect()] or None


DEMO = [("dana", 1480, 0), ("eli", 1495, 0), ("faye", 1510, 0), ("gus", 1470, 0), ("novice", 600, 0)]


@pytest.mark.parametrize(
    ("rows", "size", "want"),
    [
        (DEMO, 4, {"dana", "eli", "faye", "gus"}),
        (DEMO, 5, None),
        ([("a", 1000, 0)], 1, {"a"}),
        ([("a", 1000, 0), ("b", 1100, 0)], 2, {"a", "b"}),
        ([("a", 1000, 0), ("b", 1101, 0)], 2, None),
        ([("a", 1000, 1), ("b", 1125, 0)], 2, {"a", "b"}),
        ([("a", 1000, 500), ("b", 1600, 0)], 2, {"a", "b"}),
        ([("a", 1000, 500), ("b", 1601, 0)], 2, None),
        ([("a", None, 5), ("b", 1200, 0)], 2, {"a", "b"}),
    ],
)
def test_attempt_cases(spark, rows, size, want):
    got = party_of(mm.attempt(players(spark, rows), size, F.lit("2026-08-27 12:00:00").cast("timestamp_ntz")))
    assert (set(got) if got else None) == want


def test_attempt_refuses_empty_parties(spark):
    with pytest.raises(ValueError, match="at least one"):
        mm.attempt(players(spark, DEMO), 0, NOW)


@pytest.mark.parametrize("seed", range(4))
def test_attempt_drain_and_queue_match_a_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(f"p{k:03d}", 25 * rng.randint(30, 60), rng.randint(0, 30)) for k in range(rng.randint(1, 90))]
    size = rng.choice((2, 3, 4))
    df = players(spark, rows)
    assert party_of(mm.attempt(df, size, F.lit("2026-08-27 12:00:00").cast("timestamp_ntz"))) == scan_party(rows, size)
    waiting, want = list(rows), []
    while party := scan_party(waiting, size):
        want.append(party)
        waiting = [p for p in waiting if p[0] not in party]
    got: dict[int, list] = {}
    for r in mm.drain(df, size, NOW).orderBy("party", "seat").collect():
        got.setdefault(r.party, []).append(r.player_id)
    assert list(got.values()) == want


def test_nearest_in_memory_matches_a_sort():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(25 * rng.randint(0, 80), f"p{k}") for k in range(rng.randint(0, 120))]
        queue = mm.Queue((p, r, NOW) for r, p in rows)
        for r, p in rng.sample(rows, len(rows) // 3):
            queue.remove(p)
            rows.remove((r, p))
        low = rng.randint(0, 2000)
        high, k = low + rng.randint(0, 800), rng.randint(1, 20)
        middle = (low + high) / 2
        want = [p for r, p in sorted((x for x in rows if low <= x[0] <= high), key=lambda x: (abs(x[0] - middle), *x))][:k]
        assert queue.nearest(low, high, k) == want


def test_queue_requeues_and_removes():
    q = mm.Queue([("a", 1000, NOW), ("b", None, NOW), ("a", 1300, NOW)])
    q.remove("nobody")
    q.remove("b")
    q.remove("b")
    assert len(q) == 1 and q.rating["a"] == 1300 and q.nearest(0, 3000, 5) == ["a"]


def test_a_long_queue_of_one_rating_drains_in_near_linear_time():
    import time

    began = time.perf_counter()
    queue = mm.Queue((f"p{k:06d}", 1200, NOW - dt.timedelta(seconds=k % 100)) for k in range(60_000))
    assert sum(1 for _ in queue.parties(4, NOW, ExpandingWindow())) == 15_000
    assert time.perf_counter() - began < 20


def test_fifo_and_quality(spark, rows):
    df = players(spark, [(f"p{k}", 1000 + 10 * k, 100 - k) for k in range(10)])
    parties = mm.fifo_parties(df, 4)
    assert rows(parties.select("party", "seat", "player_id")) == sorted((k // 4, k % 4 + 1, f"p{k}") for k in range(8))
    assert {r.spread for r in mm.party_quality(parties).collect()} == {30}
    assert mm.depth(mm.without(df, parties)).first().waiting == 2
    with pytest.raises(ValueError, match="at least one"):
        mm.fifo_parties(df, 0)


def test_fifo_match(spark):
    sessions = spark.createDataFrame(
        [("full", "g", "r", "WAITING", 4, 4, NOW), ("late", "g", "r", "WAITING", 1, 4, NOW), ("open", "g", "r", "WAITING", 1, 4, NOW - dt.timedelta(1)), ("gone", "g", "r", "ACTIVE", 1, 4, NOW - dt.timedelta(2))],
        "session_code string, game_id string, region string, state string, player_count int, max_players int, created_at timestamp_ntz",
    )
    df = players(spark, [("b", 1, 5), ("a", 1, 9)])
    assert mm.fifo_match(df, sessions).first()[2:] == ("a", "open")
    assert mm.fifo_match(df, sessions.limit(0)).first()["session_code"] is None


def test_ranks_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(None)).alias("k"), F.xxhash64("id").alias("o"))
    got = group_rank(df, ["k"], ["o"])
    assert got.count() == 5000
    bad = got.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY o) AS want").where("rank <> want")
    assert bad.count() == 0


def test_ranks_beside_clashing_names(spark):
    clash = ("range_id", "own_rank", "range_size", "earlier", "Rank", "right_k")
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), *[F.lit("x").alias(c) for c in clash])
    got = group_rank(df, ["k"], ["o"])
    assert got.columns == ["k", "o", *(c for c in clash if c != "Rank"), "rank"]
    assert got.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY o) AS want").where("rank = want and earlier = 'x'").count() == 200
    assert group_rank(df.limit(0), ["k"], ["o"]).count() == 0


def test_window_policy():
    w = ExpandingWindow()
    assert [w.width(s) for s in (-5, 0, 0.9, 1, 20, 100)] == [100, 100, 100, 125, 600, 600]
    assert w.seconds_to_cap() == 20 and ExpandingWindow(100, 0, 600).seconds_to_cap() is None
    for bad in ((-1, 0, 1), (1, -1, 1), (5, 1, 4)):
        with pytest.raises(ValueError):
            ExpandingWindow(*bad)


def test_window_column_agrees(spark):
    w = ExpandingWindow(50, 7, 333)
    df = spark.createDataFrame([(float(s),) for s in (-3, 0, 1.5, 40, 41, 1000)], "s double")
    assert all(r[1] == w.width(r[0]) for r in df.select("s", w.width_column(F.col("s"))).collect())


def test_small_helpers(spark):
    assert [human_bytes(n) for n in (0, 1023, 1024, -2048, 5 << 20)] == ["0 B", "1023 B", "1.0 KB", "-2.0 KB", "5.0 MB"]
    df = spark.createDataFrame([(0,), (4000,), (4001,), (None,)], "r int")
    assert [x[0] for x in df.select(rating_is_valid(F.col("r"))).collect()] == [True, True, False, True]


def test_skill_beats_fifo(spark):
    df = mm.population(spark, 400, NOW.replace(tzinfo=dt.UTC)).cache()
    skill = mm.party_quality(mm.drain(df, 4, NOW)).agg(F.avg("spread"), F.count(F.lit(1))).first()
    fifo = mm.party_quality(mm.fifo_parties(df, 4)).agg(F.avg("spread"), F.count(F.lit(1))).first()
    assert fifo[1] == 100 and skill[1] > 60 and skill[0] < fifo[0] / 5


@pytest.fixture
def lobby(spark, tmp_path):
    """Put rows of (player, rating, seconds waited) into a stream of queues, drain it, and see who was seated."""
    from tidewell.streaming.matchmaking import parties

    def step(k, rows):
        lines = [("g", "r", p, rating, NOW - dt.timedelta(seconds=w), NOW + dt.timedelta(seconds=k)) for p, rating, w in rows]
        spark.createDataFrame(lines, SCHEMA + ", now timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA.replace("timestamp_ntz", "timestamp") + ", now timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = parties(stream, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        if not out.awaitTermination(90):
            out.stop()
            pytest.fail("the stream did not end")
        return {r.player_id for r in spark.read.schema("player_id string").parquet(str(tmp_path / "out")).collect()}

    return step


def test_streaming_matchmaker(lobby):
    assert lobby(0, [("a", 1000, 3), ("far", 3000, 1)]) == set()
    assert lobby(1, [("b", 1010, 0), ("slow", 5000, 0)]) == {"a", "b"}
    # Two hours on, those who still wait are forgotten; a partner comes too late for them.
    assert lobby(7200, [("late", 3000, -7200), ("c", 990, -7200)]) == {"a", "b"}
    assert lobby(7201, [("d", 1000, -7201)]) == {"a", "b", "c", "d"}
