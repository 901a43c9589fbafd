"""The streaming matchmaker: matches and leave-takings as time passes."""

import datetime as dt
import time

import pytest

from tidewell.functions.scalars import ExpandingWindow
from tidewell.streaming.matchmaking import parties

NOW = dt.datetime(2026, 8, 27, 12)
SCHEMA = "game_id string, region string, player_id string, rating int, enqueued_at timestamp, now timestamp"


@pytest.fixture
def lobby(spark, tmp_path):
    """Rows of (queue, player, rating, seconds after NOW) into a stream with the event clock; who was seated, and when."""

    def step(*rows):
        lines = [(q, "r", p, rating, NOW + dt.timedelta(seconds=s), NOW + dt.timedelta(seconds=s)) for q, p, rating, s in rows]
        spark.createDataFrame(lines, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        out = parties(stream, 2, wait_limit=dt.timedelta(minutes=2)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        if not query.awaitTermination(120):
            query.stop()
            pytest.fail("the stream did not end")
        found = spark.read.schema("player_id string, formed_at timestamp").parquet(str(tmp_path / "out")).collect()
        return {r.player_id: (r.formed_at - NOW).total_seconds() for r in found}

    step.waiting = lambda: {r.p for r in spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "cp")).selectExpr("user_map_key.player_id AS p").collect()}
    return step


def test_a_window_grows_until_two_meet_and_the_rest_are_forgotten(lobby):
    assert lobby(("g", "a", 1000, 0), ("g", "b", 1500, 3), ("h", "far", 100, 0), ("h", "off", 900, 1)) == {}
    assert lobby.waiting() == {"a", "b", "far", "off"}
    # Another queue's row moves the clock on: 500 points are in reach 16 seconds after the first came, not earlier and not later.
    assert lobby(("x", "tick", 0, 60)) == {"a": 16.0, "b": 16.0}
    assert lobby.waiting() == {"far", "off", "tick"}
    assert lobby(("x", "tock", 4000, 150)) == {"a": 16.0, "b": 16.0}
    # 800 points are never in reach; both have gone after two minutes, without a row of their queue.
    assert lobby.waiting() == {"tick", "tock"}


def test_newcomers_find_what_is_left(lobby):
    assert lobby(("g", "a", 1000, 0), ("g", "b", 1500, 0)) == {}
    # What was due before they came is done first: c would have been nearer to a.
    assert lobby(("g", "c", 1001, 30)) == {"a": 16.0, "b": 16.0}
    assert lobby(("g", "d", 1010, 31), ("g", "c", 3000, 31)) == {"a": 16.0, "b": 16.0}
    # The later row of a player counts: c is at 3000 now.
    assert lobby(("g", "e", 2950, 32))["c"] == 32.0


def test_two_meet_by_the_clock_of_the_cluster_alone(spark, tmp_path):
    now = dt.datetime.now(dt.UTC)
    rows = [("g", "r", "a", 1000, now, now), ("g", "r", "b", 1500, now, now)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    window = ExpandingWindow(100, 20, 600)
    made = parties(stream, 2, window, clock="processing").writeStream.format("memory").queryName("lobby_clock")
    query = made.option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 120
        while time.time() < end and query.isActive and spark.table("lobby_clock").count() == 0:
            time.sleep(1)
        assert {r.player_id for r in spark.table("lobby_clock").collect()} == {"a", "b"}
        assert all(r.anchor_wait_seconds >= 20 for r in spark.table("lobby_clock").collect())
        assert sum(p.numInputRows for p in query.recentProgress) == 2
    finally:
        query.stop()


def test_bad_arguments(spark):
    frame = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="at least one"):
        parties(frame, 0)
    with pytest.raises(ValueError, match="clock"):
        parties(frame, 2, clock="sundial")


def test_seconds_to_a_width():
    window = ExpandingWindow()
    for width in (0, 100, 101, 125, 126, 500, 600):
        s = window.seconds_to(width)
        assert window.width(s) >= width and (s == 0 or window.width(s - 1) < width)
    assert window.seconds_to(601) is None and ExpandingWindow(5, 0, 5).seconds_to(6) is None and ExpandingWindow(5, 0, 9).seconds_to(7) is None
