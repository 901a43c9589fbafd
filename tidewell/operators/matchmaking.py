"""Forming parties from queues of waiting players.

A queue is a (game_id, region).  Players have ``player_id, rating, enqueued_at``;
a missing rating counts as the default.  Ties are broken by rating, then id, so
every form of the same question has one answer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from datetime import datetime
from heapq import merge
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import DEFAULT_RATING, ExpandingWindow, rating_or_default
from tidewell.operators.ranking import group_rank

QUEUE = ("game_id", "region")
#: Candidates that an attempt looks at, as a multiple of the party's size.
CANDIDATES = 3


def longest_waiting(players: DataFrame) -> DataFrame:
    """The player at the head of each queue: earliest, then smallest id."""
    fields = [c for c in players.columns if c not in QUEUE]
    head = F.min_by(F.struct(*fields), F.struct("enqueued_at", "player_id"))
    return players.groupBy(*QUEUE).agg(head.alias("head")).select(*QUEUE, "head.*")


def nearest(players: DataFrame, middle: DataFrame, k: int, width: Column) -> DataFrame:
    """The k players of each queue nearest to its middle rating, bounds inclusive.

    ``middle`` has a row per queue: the queue's columns, ``middle_rating``, and
    whatever ``width`` needs.  Adds ``place`` (from 1) and ``distance``.
    """
    rated = players.withColumn("rating", rating_or_default(F.col("rating")))
    near = rated.join(middle, list(QUEUE)).withColumn("distance", F.abs(F.col("rating") - F.col("middle_rating")))
    order = Window.partitionBy(*QUEUE).orderBy("distance", "rating", "player_id")
    return near.where(F.col("distance") <= width).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def attempt(players: DataFrame, size: int, now: datetime | Column, window: ExpandingWindow | None = None) -> DataFrame:
    """One attempt per queue: the party around its longest-waiting player, or nothing.

    Returns ``game_id, region, seat, player_id, rating, anchor_wait_seconds``;
    seat 1 is the longest-waiting player.  A queue without enough compatible
    players gives no rows.  The top candidates of a large queue are cut per task
    before they meet.
    """
    if size < 1:
        raise ValueError("a party has at least one player")
    window = window or ExpandingWindow()
    now = F.lit(now) if isinstance(now, datetime) else now
    anchors = longest_waiting(players).select(
        *QUEUE,
        F.col("player_id").alias("anchor_id"),
        rating_or_default(F.col("rating")).alias("middle_rating"),
        F.greatest(F.lit(0), F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("enqueued_at").cast("timestamp"))).alias("waited_us"),
    )
    anchors = anchors.withColumn("wait", F.floor(F.col("waited_us") / 1_000_000))
    near = nearest(players, anchors, size * CANDIDATES, window.width_column(F.col("wait")))
    seat = F.row_number().over(Window.partitionBy(*QUEUE).orderBy(F.col("player_id") != F.col("anchor_id"), "distance", "rating", "player_id"))
    seated = near.withColumn("seat", seat).where(F.col("seat") <= size)
    whole = F.count(F.lit(1)).over(Window.partitionBy(*QUEUE))
    return seated.withColumn("n", whole).where(F.col("n") == size).select(*QUEUE, "seat", "player_id", "rating", F.col("wait").cast("long").alias("anchor_wait_seconds"))


def without(players: DataFrame, matched: DataFrame) -> DataFrame:
    """The players that are still waiting."""
    return players.join(matched.select(*QUEUE, "player_id"), [*QUEUE, "player_id"], "left_anti").select(*players.columns)


def depth(players: DataFrame) -> DataFrame:
    return players.groupBy(*QUEUE).agg(F.count(F.lit(1)).alias("waiting"))


def fifo_parties(players: DataFrame, size: int) -> DataFrame:
    """Parties of consecutive players by time of arrival; an incomplete last one is left out.

    Adds ``party`` (from 0) and ``seat`` (from 1) within each queue.
    """
    if size < 1:
        raise ValueError("a party has at least one player")
    ranked = group_rank(players, QUEUE, ["enqueued_at", "player_id"], "place")
    full = players.groupBy(*[F.col(q).alias(f"of_{q}") for q in QUEUE]).agg((F.floor(F.count(F.lit(1)) / size) * size).alias("seated"))
    match = ranked["game_id"].eqNullSafe(full["of_game_id"]) & ranked["region"].eqNullSafe(full["of_region"])
    placed = ranked.join(full, match).where(F.col("place") <= F.col("seated"))
    return placed.select(*players.columns, F.floor((F.col("place") - 1) / size).alias("party"), ((F.col("place") - 1) % size + 1).alias("seat"))


def fifo_match(players: DataFrame, sessions: DataFrame) -> DataFrame:
    """The head of each queue with the first open session that has room.

    ``sessions`` has ``session_code, game_id, region, state, player_count,
    max_players, created_at``; only waiting ones count.  ``session_code`` is null
    where the player gets a session of their own.
    """
    room = sessions.where((F.col("state") == "WAITING") & (F.col("player_count") < F.col("max_players")))
    first = room.groupBy(*QUEUE).agg(F.min_by("session_code", F.struct("created_at", "session_code")).alias("session_code"))
    return longest_waiting(players).join(first, list(QUEUE), "left").select(*QUEUE, "player_id", "session_code")


def party_quality(members: DataFrame) -> DataFrame:
    """Per queue and party: rating spread, size and the anchor's wait."""
    keys = [*QUEUE, *(["party"] if "party" in members.columns else [])]
    more = [F.max("anchor_wait_seconds").alias("anchor_wait_seconds")] if "anchor_wait_seconds" in members.columns else []
    return members.groupBy(*keys).agg((F.max("rating") - F.min("rating")).alias("spread"), F.count(F.lit(1)).alias("size"), *more)


class Queue:
    """One queue in memory: players by rating and by time of arrival, sorted once.

    A player who leaves is skipped from then on by links that shorten as they are
    followed, so leaving and finding stay near a logarithm, and a queue is drained
    in about the time of its sort.
    """

    def __init__(self, players: Iterable[tuple[str, float | None, datetime]] = ()):
        """``players`` are (id, rating, time); of rows with one id the last counts."""
        self.rating: dict[str, int] = {}
        self.since: dict[str, datetime] = {}
        for player, rating, since in players:
            self.rating[player] = DEFAULT_RATING if rating is None or rating != rating else int(rating)
            self.since[player] = since
        self.by_rating = sorted((r, p) for p, r in self.rating.items())
        self.place = {p: k for k, (_, p) in enumerate(self.by_rating)}
        self.by_time = sorted((t, p) for p, t in self.since.items())
        self.head = 0
        # Places from 1 on; 0 and n + 1 are the ends, which never leave.
        self.up = list(range(len(self.by_rating) + 2))
        self.down = list(self.up)

    def remove(self, player_id: str) -> None:
        if self.rating.pop(player_id, None) is not None:
            at = self.place[player_id] + 1
            self.up[at], self.down[at] = at + 1, at - 1
            del self.since[player_id]

    def __len__(self) -> int:
        return len(self.rating)

    @staticmethod
    def _follow(links: list[int], at: int) -> int:
        while links[at] != at:
            links[at] = at = links[links[at]]
        return at

    def _upwards(self, at: int, high: float) -> Iterator[tuple[int, str]]:
        """Waiting players from a place on, up to a rating."""
        while (at := self._follow(self.up, at)) <= len(self.by_rating) and self.by_rating[at - 1][0] <= high:
            yield self.by_rating[at - 1]
            at += 1

    def _downwards(self, at: int, low: float) -> Iterator[tuple[int, str]]:
        """Waiting players below a place, down to a rating; those of one rating by id."""
        while (at := self._follow(self.down, at - 1)) >= 1 and (rating := self.by_rating[at - 1][0]) >= low:
            at = bisect_left(self.by_rating, (rating,)) + 1
            yield from self._upwards(at, rating)

    def nearest(self, low: int, high: int, k: int) -> list[str]:
        """The k players nearest to the middle of a band, bounds inclusive."""
        middle = (low + high) / 2
        at = bisect_left(self.by_rating, (middle,)) + 1
        both = merge(self._downwards(at, low), self._upwards(at, high), key=lambda x: (abs(x[0] - middle), *x))
        return [p for _, p in islice(both, k)]

    def longest_waiting(self) -> str | None:
        while self.head < len(self.by_time) and self.by_time[self.head][1] not in self.rating:
            self.head += 1
        return self.by_time[self.head][1] if self.head < len(self.by_time) else None

    def form(self, size: int, now: datetime, window: ExpandingWindow) -> tuple[list[str], float] | None:
        """The party around the longest-waiting player, or nothing."""
        anchor = self.longest_waiting()
        if anchor is None:
            return None
        since = self.since[anchor]
        waited = max(0.0, (now - since).total_seconds())
        width = window.width(waited)
        near = self.nearest(self.rating[anchor] - width, self.rating[anchor] + width, size * CANDIDATES)
        members = [anchor, *[p for p in near if p != anchor]][:size]
        return (members, waited) if len(members) == size else None

    def parties(self, size: int, now: datetime, window: ExpandingWindow) -> Iterator[list[tuple[int, str, int, int]]]:
        """Take parties until the head cannot be matched: rows of (seat, player, rating, seconds that the anchor waited)."""
        while found := self.form(size, now, window):
            members, waited = found
            yield [(seat, p, self.rating[p], int(waited)) for seat, p in enumerate(members, 1)]
            for p in members:
                self.remove(p)


def drain(players: DataFrame, size: int, now: datetime, window: ExpandingWindow | None = None) -> DataFrame:
    """All parties that repeated attempts form, until a queue's head cannot be matched.

    Each attempt depends on the one before, so a queue is one sequential loop;
    queues run side by side, each in one task that holds its waiting players.
    Returns ``game_id, region, party, seat, player_id, rating, anchor_wait_seconds``.
    """
    if size < 1:
        raise ValueError("a party has at least one player")
    rule = window or ExpandingWindow()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queue = Queue((p, r, t.to_pydatetime()) for p, r, t in zip(pdf["player_id"], pdf["rating"], pdf["enqueued_at"], strict=True))
        key = pdf["game_id"].iloc[0], pdf["region"].iloc[0]
        out = [(*key, party, *row) for party, rows in enumerate(queue.parties(size, now, rule)) for row in rows]
        return pd.DataFrame(out, columns=names)

    schema = "game_id string, region string, party long, seat int, player_id string, rating int, anchor_wait_seconds long"
    names = [f.split()[0] for f in schema.split(", ")]
    rows = players.select(*QUEUE, F.col("player_id").cast("string").alias("player_id"), F.col("rating").cast("double").alias("rating"), F.col("enqueued_at").cast("timestamp_ntz").alias("enqueued_at"))
    return rows.groupBy(*QUEUE).applyInPandas(run, schema)


def population(spark, players: int, now: datetime, queues: int = 1, seed: int = 7, mean: float = 1200, deviation: float = 300, longest: int = 120) -> DataFrame:
    """Synthetic waiting players: normal ratings from 0 up, waits of up to ``longest`` seconds."""
    rating = F.greatest(F.lit(0), F.round(F.randn(seed) * deviation + mean)).cast("int")
    waited = F.floor(F.rand(seed + 1) * longest)
    return spark.range(players).select(
        F.concat(F.lit("game-"), (F.col("id") % queues).cast("string")).alias("game_id"),
        F.lit("us-east-1").alias("region"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("player_id"),
        rating.alias("rating"),
        F.timestamp_micros(F.lit(int(now.timestamp() * 1_000_000)) - waited * 1_000_000).alias("enqueued_at"),
    )
