"""Partial rows: merging in any order, error bounds of sketches, replayed batches."""

import math
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewell.operators import gold, partials
from tidewell.streaming import increments, silver, support

COUNTS = [c for c in partials.SUMS if c != "player_slot_events"]


@pytest.fixture(scope="module")
def events(spark):
    kinds = F.array(*map(F.lit, ("SESSION_CREATED", "PLAYER_JOINED", "PLAYER_LEFT", "SESSION_STARTED", "SESSION_TERMINATED", "OTHER")))
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    rows = spark.range(120_000).select(
        "id",
        F.timestamp_seconds(1_700_000_000 + draw(1, 3 * 86_400)).alias("event_time"),
        F.get(kinds, draw(2, 6).cast("int")).alias("event_type"),
        F.concat(F.lit("S"), draw(3, 40_000).cast("string")).alias("session_code"),
        F.concat(F.lit("g"), draw(4, 2).cast("string")).alias("game_id"),
        F.when(draw(5, 10) > 0, F.concat(F.lit("r"), draw(5, 2).cast("string"))).alias("region"),
        draw(6, 6).cast("int").alias("player_count"),
        F.when(draw(7, 4) > 0, draw(8, 100_000)).alias("uptime_seconds"),
    )
    return rows.unionByName(rows.limit(3).withColumn("event_time", F.lit(None).cast("timestamp"))).cache()


def same(spark, rows, a, b):
    assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns)))


def test_parts_merge_into_the_whole_and_minutes_into_hours(spark, rows, events):
    parts = [partials.partial(events.where(F.col("id") % 5 == k)) for k in (3, 0, 4, 1, 2)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    hours = partials.lifecycle(merged, "1 hour").cache()
    exact = gold.lifecycle(events, "1 hour", exact=True)
    columns = ["window_start", "window_end", "game_id", "region", *COUNTS, "peak_players_in_a_session"]
    assert rows(hours.select(columns)) == rows(exact.where("window_start IS NOT NULL").select(columns))
    loads = partials.concurrency(merged, "1 day").drop("active_sessions")
    same(spark, rows, loads, gold.concurrency(events.where("event_time IS NOT NULL"), "1 day", exact=True).drop("active_sessions"))


def test_every_distinct_count_is_within_five_standard_errors(spark, events):
    days = partials.concurrency(partials.partial(events), "1 day")
    exact = gold.concurrency(events.where("event_time IS NOT NULL"), "1 day", exact=True).select("window_start", "region", F.col("active_sessions").alias("exact"))
    met = [(r.active_sessions, r.exact) for r in days.join(exact, (days["window_start"] == exact["window_start"]) & days["region"].eqNullSafe(exact["region"])).collect()]
    assert len(met) >= 9 and max(n for _, n in met) > 5000
    assert all(abs(near - n) <= 5 * 1.04 / math.sqrt(2**partials.REGISTERS) * n + 1 for near, n in met)


def test_every_quantile_is_within_the_rank_error(spark, events):
    whole = partials.total(partials.partial(events, "1 hour"), ("region",))
    shares = (0.01, 0.25, 0.5, 0.95, 0.999)
    got = whole.select("region", F.kll_sketch_get_n_bigint(partials.UPTIMES).alias("n"), *[partials.uptime_quantile(s).alias(f"q{i}") for i, s in enumerate(shares)]).collect()
    values: dict = {}
    for r in events.where("event_time IS NOT NULL AND uptime_seconds IS NOT NULL").select("region", "uptime_seconds").collect():
        values.setdefault(r.region, []).append(r.uptime_seconds)
    assert {r.region for r in got} == set(values)
    for r in got:
        held = values[r.region]
        assert r.n == len(held)
        for i, s in enumerate(shares):
            q = r[f"q{i}"]
            below, upto = sum(v < q for v in held) / r.n, sum(v <= q for v in held) / r.n
            assert below - 0.01 <= s <= upto + 0.01


def test_exact_rows_merge_into_exact_days(spark, rows, events):
    timed = events.where("event_time IS NOT NULL")
    parts = partials.partial(events.where("id % 2 = 0"), exact=True).unionByName(partials.partial(events.where("id % 2 = 1"), exact=True))
    hours = partials.combined(parts, window="1 hour")
    same(spark, rows, partials.concurrency(hours, "1 day"), gold.concurrency(timed, "1 day", exact=True))
    same(spark, rows, partials.lifecycle(hours, "1 day"), gold.lifecycle(timed, "1 day", exact=True))


def test_sessions_of_all_time_are_counted_exactly(spark, rows, events):
    whole = partials.total(partials.partial(events, "1 hour", exact=True), ("game_id",))
    got = partials.with_sessions(whole, ("game_id",)).select("game_id", "distinct_sessions")
    assert rows(got) == rows(events.where("event_time IS NOT NULL").groupBy("game_id").agg(F.count_distinct("session_code")))


def test_counted_uptimes_give_exact_percentiles(spark, events):
    values: dict = {}
    for r in events.where("event_time IS NOT NULL AND uptime_seconds IS NOT NULL").select("region", "uptime_seconds").collect():
        values.setdefault(r.region, []).append(r.uptime_seconds)
    got = partials.uptime_percentiles(partials.counted_uptimes(events, "1 day", ("region",)), (50, 95), ("region",)).collect()
    assert {r.region for r in got} == set(values)
    for r in got:
        held = sorted(values[r.region])
        assert (r.uptimes, r.p50, r.p95) == (len(held), held[-(-len(held) // 2) - 1], held[-(-len(held) * 95 // 100) - 1])


def test_few_values_are_exact(spark):
    rows = [("g", "r", f"S{k % 7}", k) for k in range(100)]
    frame = spark.createDataFrame(rows, "game_id string, region string, session_code string, uptime_seconds int").withColumns(
        {"event_time": F.timestamp_seconds(F.col("uptime_seconds") * 3600), "event_type": F.lit("PLAYER_JOINED"), "player_count": F.lit(None).cast("int")}
    )
    r = partials.total(partials.partial(frame)).select(partials.distinct_sessions().alias("d"), partials.uptime_quantile(0.5).alias("m"), "player_joins", "player_slot_events", "peak_players").first()
    assert tuple(r) == (7, 49, 100, None, None)
    nothing = frame.withColumn("uptime_seconds", F.lit(None).cast("int"))
    assert partials.total(partials.partial(nothing)).select(partials.uptime_quantile(0.5).alias("q")).first().q is None
    assert partials.total(partials.partial(frame.limit(0))).count() == 0


def test_a_batch_that_runs_twice_counts_once(spark, rows, events, tmp_path):
    path = str(tmp_path / "partials")
    for number in (2, 0, 1, 0, 2):
        increments.write_batch(events.where(F.col("id") % 3 == number), number, path, "1 day")
    whole = gold.lifecycle(events.where("event_time IS NOT NULL"), "1 day", exact=True)
    columns = ["window_start", "game_id", "region", *COUNTS]
    assert rows(increments.read(spark, path).select(columns)) == rows(whole.select(columns))


def test_exact_batches_count_sessions_exactly_and_once(spark, rows, events, tmp_path):
    path = str(tmp_path / "partials")
    for number in (1, 0, 1):
        increments.write_batch(events.where(F.col("id") % 2 == number), number, path, "1 day", exact=True)
    same(spark, rows, partials.concurrency(increments.read(spark, path)), gold.concurrency(events.where("event_time IS NOT NULL"), "1 day", exact=True))


def test_few_large_files_are_parsed_by_all_cores(spark):
    few = spark.range(100).coalesce(1)
    assert silver.spread(few).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in silver.spread(few).collect()) == list(range(100)) and silver.spread(few).columns == ["id"]
    assert silver.spread(spark.range(0, 100, 1, 40)).rdd.getNumPartitions() == 40


def test_a_long_batch_is_waited_for(monkeypatch):
    class Slow:
        isActive, stopped = True, False
        asked = 0

        @property
        def recentProgress(self):
            self.asked += 1
            return [SimpleNamespace(batchId=0, numInputRows=1)] if self.asked > 5 else []

        def stop(self):
            self.stopped = True

    clock = iter(range(0, 100_000, 100))
    monkeypatch.setattr(support, "time", SimpleNamespace(time=lambda: next(clock), sleep=lambda s: None))
    query = Slow()
    assert support.run_batches(query, 1, timeout=None) == 1 and query.stopped
