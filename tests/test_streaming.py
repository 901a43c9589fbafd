"""Streams end to end: reconciliation, restarts, duplicates, late data, all drives."""

import json
import time
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import START
from tidewell.functions import quality
from tidewell.operators import gold as rollups
from tidewell.operators.generate import event_lines, session_events, write_landing
from tidewell.options import BRONZE, CONCURRENCY, DURATION, FUNNEL, LIFECYCLE, QUARANTINE, SILVER, Drive, LakeOptions
from tidewell.plans.catalog import PACK, register_views, run_pack
from tidewell.sources.events import FileEventSource, KafkaEventSource
from tidewell.sources.table import LakeTable
from tidewell.streaming import bronze, gold, medallion, silver
from tidewell.streaming.support import run_batches

LINES: list[str] = []
IDS: list[str] = []


@pytest.fixture(scope="module", autouse=True)
def made(spark):
    LINES[:] = event_lines(60, START, seed=42)
    IDS[:] = sorted(json.loads(x)["eventId"] for x in LINES)


def options(tmp_path, **more):
    return LakeOptions(base=str(tmp_path / "lake"), drive=Drive.RATE_LIMITED, max_files=2, shuffle_partitions=4, **more)


def read(spark, o, name):
    return LakeTable(spark, o.table(name)).read()


def run(spark, o):
    medallion.run_all(spark, o, FileEventSource(o))


def silver_ids(spark, o):
    return sorted(r.event_id for r in read(spark, o, SILVER).select("event_id").collect())


def test_end_to_end_and_rerun(spark, tmp_path, rows):
    o = options(tmp_path)
    bad = ["this is not json at all", '{"eventId":"broken-json",', LINES[3].replace('"schemaVersion":1', '"schemaVersion":99')]
    write_landing(LINES + bad, o.landing, 6)
    run(spark, o)
    first = medallion.row_counts(spark, o)
    assert first[BRONZE] == len(LINES) + 3 and first[SILVER] == len(LINES) and first[QUARANTINE] == 3 and first[DURATION] == 60
    assert silver_ids(spark, o) == IDS
    rejected = read(spark, o, QUARANTINE)
    assert rejected.where(F.array_contains(quality.FAILURES, "envelope_parses")).count() == 2
    assert rejected.where("failure_count = 1").count() == 1
    whole = rollups.lifecycle(read(spark, o, SILVER))
    assert rows(read(spark, o, LIFECYCLE).drop("computed_at")) == rows(whole)
    assert rows(read(spark, o, CONCURRENCY).drop("computed_at")) == rows(rollups.concurrency(read(spark, o, SILVER)))
    assert sum(r.sessions_observed for r in read(spark, o, FUNNEL).collect()) == 60
    assert LakeTable(spark, o.table(SILVER)).detail().partition_by == ("event_date",)
    run(spark, o)
    assert medallion.row_counts(spark, o) == first
    texts = run_pack(spark, o)
    assert len(texts) == len(PACK) and not any("unavailable" in t for t in texts)
    # A late event alone comes in: only its windows are rewritten, and rightly.
    late = session_events(7, START, seed=42)[0] | {"eventId": "late-1"}
    write_landing([json.dumps(late)], o.landing, 1, prefix="late")
    run(spark, o)
    assert rows(read(spark, o, LIFECYCLE).drop("computed_at")) == rows(rollups.lifecycle(read(spark, o, SILVER)))
    assert read(spark, o, LIFECYCLE).agg(F.sum("event_count")).first()[0] == len(LINES) + 1


def test_restart_after_a_crash(spark, tmp_path):
    o = replace(options(tmp_path), max_files=1)
    write_landing(LINES, o.landing, 8)
    assert run_batches(bronze.start(spark, o, FileEventSource(o)), 2) >= 2
    assert 0 < medallion.row_counts(spark, o)[BRONZE]
    bronze.run(spark, o, FileEventSource(o))
    assert medallion.row_counts(spark, o)[BRONZE] == len(LINES)
    run_batches(silver.start(spark, o), 2)
    silver.run(spark, o)
    assert silver_ids(spark, o) == IDS


def test_duplicates_near_and_far(spark, tmp_path):
    o = options(tmp_path)
    write_landing([x for x in LINES for _ in (0, 1)] + LINES, o.landing, 9)
    run(spark, o)
    assert medallion.row_counts(spark, o)[BRONZE] == 3 * len(LINES)
    assert silver_ids(spark, o) == IDS


def test_lost_checkpoint_adds_nothing_twice(spark, tmp_path):
    o = options(tmp_path)
    write_landing(LINES + ["junk"], o.landing, 3)
    bronze.run(spark, o, FileEventSource(o))
    silver.run(spark, o)
    store = LakeTable(spark, o.table(SILVER)).storage
    store.delete(o.checkpoint(silver.NAME))
    silver.run(spark, o)
    assert silver_ids(spark, o) == IDS


def test_same_id_on_another_date(spark, tmp_path):
    o = options(tmp_path)
    event = session_events(1, START, seed=42)[0]
    moved = event | {"eventTime": "2026-09-01T00:00:00.000Z"}
    for k, e in enumerate((event, moved)):
        write_landing([json.dumps(e)], o.landing, 1, prefix=f"part{k}")
        bronze.run(spark, o, FileEventSource(o))
        silver.run(spark, o)
    assert len(silver_ids(spark, o)) == 2


def test_all_invalid_first_batch(spark, tmp_path):
    o = options(tmp_path)
    write_landing(["junk", "more junk"], o.landing, 1)
    run(spark, o)
    assert medallion.row_counts(spark, o) == {BRONZE: 2, SILVER: 0, QUARANTINE: 2, LIFECYCLE: 0, CONCURRENCY: 0, DURATION: 0, FUNNEL: 0}


def test_compaction_is_not_streamed_again(spark, tmp_path):
    o = options(tmp_path)
    write_landing(LINES, o.landing, 6)
    run(spark, o)
    version = LakeTable(spark, o.table(LIFECYCLE)).latest_version()
    LakeTable(spark, o.table(SILVER)).optimize(["game_id", "session_code"])
    gold.run(spark, o)
    assert LakeTable(spark, o.table(LIFECYCLE)).latest_version() == version


def test_available_now(spark, tmp_path):
    o = replace(options(tmp_path), drive=Drive.AVAILABLE_NOW)
    write_landing(LINES, o.landing, 3)
    run(spark, o)
    assert silver_ids(spark, o) == IDS


def test_continuous_reaches_gold(spark, tmp_path):
    o = replace(options(tmp_path), drive=Drive.CONTINUOUS, interval=timedelta(seconds=1))
    write_landing(LINES, o.landing, 2)
    queries = medallion.start_all(spark, o, FileEventSource(o))
    try:
        assert {q.name for q in queries} == {"bronze-ingest", "silver-transform", "gold-aggregates"}
        end = time.time() + 90
        while time.time() < end and medallion.row_counts(spark, o).get(DURATION, 0) < 60:
            time.sleep(0.5)
            assert all(q.isActive for q in queries)
        assert medallion.row_counts(spark, o)[DURATION] == 60
    finally:
        for q in queries:
            q.stop()


def test_views_without_tables(spark, tmp_path):
    o = options(tmp_path)
    assert register_views(spark, o) == [QUARANTINE]
    texts = run_pack(spark, o)
    assert sum("unavailable" in t for t in texts) == 6


def test_sources_describe_themselves(tmp_path):
    o = options(tmp_path)
    assert o.landing in FileEventSource(o).describe() and "session-events" in KafkaEventSource(o).describe()
    with pytest.raises(ValueError, match="no table"):
        o.table("nothing")
    with pytest.raises(ValueError, match="at least a second"):
        _ = replace(o, window=timedelta(0)).window_text
