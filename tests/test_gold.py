"""Rollups against plain Python over generated sessions."""

import datetime as dt
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import START
from tests.test_rules import bronze
from tidewell.operators import gold, merge
from tidewell.operators.envelope import parse
from tidewell.operators.generate import event_lines
from tidewell.plans.catalog import session_lengths


@pytest.fixture(scope="module")
def events(spark):
    return parse(bronze(spark, event_lines(120, START, seed=3))).cache()


@pytest.fixture(scope="module")
def plain(spark):
    return [json.loads(line) for line in event_lines(120, START, seed=3)]


def minute(e):
    return dt.datetime.fromisoformat(e["eventTime"]).replace(second=0, microsecond=0, tzinfo=None)


def test_lifecycle(events, plain):
    want = Counter((minute(e), e["session"]["gameId"], e["session"]["region"], e["type"]) for e in plain)
    got = gold.lifecycle(events, exact=True).collect()
    for r in got:
        key = (r.window_start, r.game_id, r.region)
        assert r.sessions_created == want[(*key, "SESSION_CREATED")]
        assert r.player_joins == want[(*key, "PLAYER_JOINED")]
        assert r.sessions_terminated == want[(*key, "SESSION_TERMINATED")]
        assert r.window_end - r.window_start == dt.timedelta(minutes=1)
    assert sum(r.sessions_created for r in got) == 120
    assert sum(r.event_count for r in got) == len(plain)


def test_concurrency(events, plain):
    seen = defaultdict(set)
    for e in plain:
        seen[(minute(e), e["session"]["region"])].add(e["sessionCode"])
    got = {(r.window_start, r.region): r.active_sessions for r in gold.concurrency(events, exact=True).collect()}
    assert got == {k: len(v) for k, v in seen.items()}
    near = {(r.window_start, r.region): r.active_sessions for r in gold.concurrency(events).collect()}
    assert near.keys() == got.keys()


def test_durations_and_funnel(events, plain):
    durations = gold.session_durations(events)
    got = {r.session_code: r for r in durations.collect()}
    assert len(got) == 120 and all(r.completed for r in got.values())
    for n in range(120):
        own = [e for e in plain if e["sessionCode"] == f"S{n:07d}"]
        r = got[own[0]["sessionCode"]]
        assert r.event_count == len(own)
        assert r.reported_uptime_seconds == own[-1]["session"]["uptimeSeconds"] == r.duration_seconds
        assert r.peak_players == max(e["session"]["currentPlayerCount"] for e in own)
    started = {e["sessionCode"] for e in plain if e["type"] == "SESSION_STARTED"}
    funnel = gold.matchmaking_funnel(durations).collect()
    assert sum(r.sessions_started for r in funnel) == len(started)
    assert sum(r.sessions_observed for r in funnel) == 120
    assert all(r.start_rate == round(r.sessions_started / r.sessions_observed, 4) for r in funnel)


def test_missing_uptime_falls_back_to_observed(spark):
    rows = [("s", "g", "r", dt.datetime(2026, 1, 1, 0, 0, 1, 900000), 1, 4, "SESSION_CREATED", None), ("s", "g", "r", dt.datetime(2026, 1, 1, 0, 0, 5, 100000), 2, 4, "PLAYER_JOINED", None)]
    df = spark.createDataFrame(rows, "session_code string, game_id string, region string, event_time timestamp, player_count int, max_players int, event_type string, uptime_seconds long")
    r = gold.session_durations(df).first()
    assert r.observed_duration_seconds == 4 and r.duration_seconds == 4 and not r.completed


def test_percentiles_of_the_funnel_are_exact_over_many_durations(spark):
    n = 60_000
    seconds = F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(2_000_000)))
    d = spark.range(n).select(
        (F.col("id") % 2).alias("game_id"), F.when(F.col("id") % 2 > 0, "r").alias("region"), seconds.alias("duration_seconds"), (F.col("id") % 3).alias("start_events"),
        F.lit(1).alias("terminate_events"), F.when(F.col("id") % 5 > 0, 1 + F.col("id") % 4).cast("int").alias("peak_players"),
    )
    plain = d.collect()
    got = {r.game_id: r for r in gold.matchmaking_funnel(d.unionByName(d.limit(1).withColumns({"game_id": F.lit(9).cast("long"), "duration_seconds": F.lit(None).cast("long"), "peak_players": F.lit(None).cast("int")}))).collect()}
    assert set(got) == {0, 1, 9} and got[0].region is None
    for game in (0, 1):
        own = [r for r in plain if r.game_id == game]
        held = sorted(r.duration_seconds for r in own if r.duration_seconds is not None)
        peaks = [r.peak_players for r in own if r.peak_players is not None]
        r = got[game]
        assert (r.p50_duration_seconds, r.p95_duration_seconds) == (held[-(-len(held) // 2) - 1], held[-(-len(held) * 95 // 100) - 1])
        assert (r.sessions_observed, r.sessions_terminated, r.sessions_started) == (n // 2, n // 2, sum(x.start_events > 0 for x in own))
        assert r.avg_peak_players == sum(peaks) / len(peaks)
    assert (got[9].sessions_observed, got[9].p50_duration_seconds, got[9].avg_peak_players) == (1, None, None)


@pytest.mark.parametrize("window", ["1 minute", "5 minutes", "30 seconds"])
def test_late_events_bring_back_exactly_their_windows(events, window, rows):
    first, late = events.where("pmod(hash(event_id), 7) <> 0"), events.where("pmod(hash(event_id), 7) = 0")
    table = gold.lifecycle(first, window, exact=True)
    fixed = merge.upserted(gold.lifecycle(gold.in_touched_windows(events, late, window), window, exact=True), table, ["window_start", "game_id", "region"])
    assert rows(fixed) == rows(gold.lifecycle(events, window, exact=True))


def test_lone_late_event(spark, rows):
    times = [dt.datetime(2026, 1, 1, 9, 0, s) for s in (5, 30, 55, 40)]
    df = spark.createDataFrame([(t, "r", f"s{k}", 1) for k, t in enumerate(times)], "event_time timestamp, region string, session_code string, player_count int")
    late = df.where("session_code = 's3'")
    assert gold.concurrency(gold.in_touched_windows(df, late), exact=True).first().event_count == 4


def test_merges(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert rows(merge.absent_from(source, target, ["k"])) == [(3, "C"), (None, "N")]
    assert rows(merge.absent_from(source, target, ["k"], within=F.col("k") < 2)) == [(2, "B"), (3, "C"), (None, "N")]
    assert rows(merge.upserted(source, target, ["k"])) == [(1, "a"), (2, "B"), (3, "C"), (None, "N"), (None, "n")]
    twice = source.union(source.withColumn("v", F.lit("A")))
    assert rows(merge.first_of_each(twice, ["k"], "v")) == [(2, "A"), (3, "A"), (None, "A")]
    assert merge.first_of_each(twice, ["k"]).count() == 3
    assert rows(merge.touching(target, source, ["k"])) == [(2, "b")]


def test_session_lengths_of_the_pack_are_exact_over_many_durations(spark):
    d = spark.range(41_000).select(F.lit("g").alias("game_id"), F.lit("r").alias("region"), (F.col("id") * 37).alias("duration_seconds"), F.lit(1).alias("start_events"), F.lit(0).alias("terminate_events"), F.lit(3).alias("peak_players"))
    r = session_lengths(lambda name: gold.matchmaking_funnel(d)).first()
    assert tuple(r) == ("g", "r", 41_000, 41_000, 1.0, 20_499 * 37, 38_949 * 37, 3.0)
