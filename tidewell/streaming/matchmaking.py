"""Matchmaking over a stream: waiting players as keyed state, parties as output.

A queue's players are entries of a map state, so a batch writes only those who come and
go.  A timer wakes the queue when its longest-waiting player's window has grown to the
next players, or when that player is forgotten; parties form as time passes, whether
rows arrive or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.functions.scalars import ExpandingWindow
from tidewell.operators.matchmaking import QUEUE, Queue

PARTIES = "game_id string, region string, seat int, player_id string, rating int, anchor_wait_seconds long, formed_us long"
#: How long a player waits at most before the state forgets them.
WAIT_LIMIT = timedelta(hours=1)
#: Map states and timers are kept by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_map_states(spark: SparkSession) -> None:
    """Streams that the session starts from now on keep their state where map states and timers can be kept."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Matchmaker(StatefulProcessor):
    """One queue's waiting players, and the parties that they form."""

    def __init__(self, size: int, window: ExpandingWindow, wait_limit: timedelta, event_time: bool):
        self.size, self.window, self.wait_limit, self.event_time = size, window, wait_limit, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "player_id string", "rating int, since_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came: dict[str, tuple] = {}
        clock = None if self.event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
        for frame in rows:
            if self.event_time:
                clock = max(clock or 0, int(frame["now_us"].max()))
            came |= {p: (r, int(t)) for p, r, t in zip(frame["player_id"], frame["rating"], frame["enqueued_at_us"], strict=True)}
        stored = self._stored()
        # Those who wait already move on first: what they could do before the newcomers were there is done.
        queue = _queue(stored)
        seated = list(self._advanced(queue, clock))
        now = {p: (queue.rating[p], _micros(queue.since[p])) for p in queue.rating} | came
        queue = _queue(now)
        seated += self._step(queue, clock)
        self._keep(queue, stored, came, clock)
        yield _frame(key, seated)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs()) * 1000
        stored = self._stored()
        queue = _queue(stored)
        seated = list(self._advanced(queue, clock))
        self._keep(queue, stored, {}, clock)
        yield _frame(key, seated)

    def close(self) -> None:
        pass

    def _stored(self) -> dict[str, tuple]:
        return {k[0]: (v[0], v[1]) for k, v in self.waiting.iterator()}

    def _keep(self, queue: Queue, stored: dict[str, tuple], came: dict[str, tuple], clock: int) -> None:
        """Write who came and who went, and set the next timer in place of the last."""
        for p in stored:
            if p not in queue.rating:
                self.waiting.removeKey((p,))
        for p in came:
            if p in queue.rating:
                self.waiting.updateValue((p,), (queue.rating[p], _micros(queue.since[p])))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wake = self._wake(queue)
        if wake is not None:
            self.handle.registerTimer(-(-max(wake, clock + 1) // 1000))

    def _step(self, queue: Queue, now: int) -> list[tuple]:
        """Forget who has waited too long, and seat what parties there are at this time."""
        at = _from_micros(now)
        for p in [p for p, t in queue.since.items() if at - t > self.wait_limit]:
            queue.remove(p)
        return [(*row, now) for party in queue.parties(self.size, at, self.window) for row in party]

    def _advanced(self, queue: Queue, clock: int) -> Iterator[tuple]:
        """What happens up to a time, at the times when it happens."""
        while (wake := self._wake(queue)) is not None and wake <= clock:
            yield from self._step(queue, wake)

    def _wake(self, queue: Queue) -> int | None:
        """When the longest-waiting player can be matched with those now waiting, or is forgotten."""
        anchor = queue.longest_waiting()
        if anchor is None:
            return None
        since, rating, cap = _micros(queue.since[anchor]), queue.rating[anchor], self.window.cap
        forgotten = since + self.wait_limit // timedelta(microseconds=1) + 1000
        others = [p for p in queue.nearest(rating - cap, rating + cap, self.size) if p != anchor][: self.size - 1]
        if len(others) < self.size - 1:
            return forgotten
        reach = max((abs(queue.rating[p] - rating) for p in others), default=0)
        seconds = self.window.seconds_to(reach)
        return forgotten if seconds is None else min(forgotten, since + seconds * 1_000_000)


def parties(players: DataFrame, size: int, window: ExpandingWindow | None = None, wait_limit: timedelta = WAIT_LIMIT, clock: str = "event") -> DataFrame:
    """Parties from a stream of ``game_id, region, player_id, rating, enqueued_at``.

    ``clock`` says what time it is.  With ``event`` it is the latest ``now`` of the rows, a further
    column: a replay of the same rows forms the same parties at the same times, and
    queues without rows move on when others' rows do.  With ``processing`` it is the
    cluster's clock: queues move on by themselves, at every trigger.

    A batch first does what was due before its clock, then adds its players and forms what
    parties it can.  Of rows with one player the last counts.  A player who has waited
    beyond ``wait_limit`` is forgotten, with rows or without.  ``formed_at`` is the time at
    which the window was wide enough, or that of the batch which brought the players.
    A queue is one sequence of matches, so its waiting players meet in one task; the limit of
    waiting bounds them by what arrives within it.
    """
    if size < 1:
        raise ValueError("a party has at least one player")
    if clock not in ("event", "processing"):
        raise ValueError("the clock is event or processing")
    keep_map_states(players.sparkSession)
    event_time = clock == "event"
    if event_time:
        players = players.withColumn("now", F.col("now").cast("timestamp")).withWatermark("now", "0 seconds")
    micros = {f"{c}_us": F.unix_micros(F.col(c).cast("timestamp")) for c in ("enqueued_at", *(["now"] if event_time else []))}
    rows = players.withColumns(micros).select(*QUEUE, "player_id", F.col("rating").cast("double").alias("rating"), *micros, *(["now"] if event_time else []))
    maker = Matchmaker(size, window or ExpandingWindow(), wait_limit, event_time)
    found = rows.groupBy(*QUEUE).transformWithStateInPandas(maker, PARTIES, "Append", "EventTime" if event_time else "ProcessingTime")
    return found.withColumn("formed_at", F.timestamp_micros("formed_us")).drop("formed_us")


def _queue(players: dict[str, tuple]) -> Queue:
    return Queue((p, r, _from_micros(t)) for p, (r, t) in players.items())


def _frame(key: tuple, seated: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *row) for row in seated], columns=[f.split()[0] for f in PARTIES.split(", ")])


def _from_micros(us: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us)


def _micros(at: datetime) -> int:
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
