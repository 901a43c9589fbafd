"""Scalar expressions and helpers of the session domain."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RATING, LEAST_RATING, MOST_RATING = 1200, 0, 4000


def lenient_timestamp(value: Column) -> Column:
    """ISO text to timestamp; what does not parse is null."""
    return value.try_cast("timestamp")


def event_key(event_id: Column, raw: Column) -> Column:
    """The event's id, or a hash of its text if it has none."""
    return F.coalesce(event_id, F.sha2(raw, 256))


def count_of(event_type: str, column: str = "event_type") -> Column:
    """How many rows of a group have this event type."""
    return F.count_if(F.coalesce(F.col(column) == event_type, F.lit(False)))


def seconds_between(first: Column, last: Column) -> Column:
    """Difference of two times, each cut to whole seconds."""
    return F.unix_timestamp(last) - F.unix_timestamp(first)


def rating_or_default(rating: Column) -> Column:
    return F.coalesce(rating, F.lit(DEFAULT_RATING))


def rating_is_valid(rating: Column) -> Column:
    return F.coalesce(rating.between(LEAST_RATING, MOST_RATING), F.lit(True))


def player_total(players: Column) -> Column:
    """Players of a session; 0 if there is no list."""
    return F.when(players.isNull(), F.lit(0)).otherwise(F.size(players))


def is_full(players: Column, most: Column) -> Column:
    return player_total(players) >= most


def uptime_seconds(created: Column, now: Column) -> Column:
    """Whole seconds since creation; 0 without a creation time."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(created), F.lit(0).cast("long"))


def human_bytes(n: int | float) -> str:
    """Bytes in the largest unit that keeps the number at 1 or more; negative sizes keep their sign."""
    sign, n = ("-" if n < 0 else ""), abs(n)
    if n < 1024:
        return f"{sign}{n:.0f} B"
    k = min(4, int(math.log(n, 1024)))
    return f"{sign}{n / 1024**k:.1f} {('KB', 'MB', 'GB', 'TB')[k - 1]}"


@dataclass(frozen=True)
class ExpandingWindow:
    """How far from the anchor's rating a match may reach, by time waited."""

    start: int = 100
    per_second: int = 25
    cap: int = 600

    def __post_init__(self):
        if self.start < 0 or self.per_second < 0:
            raise ValueError("the window cannot start or grow below 0")
        if self.cap < self.start:
            raise ValueError("the window's cap is below its start")

    def width(self, seconds: float) -> int:
        """The width after some seconds; only whole seconds count, none below 0."""
        return min(self.cap, self.start + self.per_second * max(0, math.floor(seconds)))

    def width_column(self, seconds: Column) -> Column:
        return F.least(F.lit(self.cap), self.start + self.per_second * F.greatest(F.lit(0), F.floor(seconds))).cast("int")

    def seconds_to(self, width: int) -> int | None:
        """Whole seconds until the window is so wide; None if it never is."""
        if width <= self.start:
            return 0
        return None if width > self.cap or self.per_second == 0 else -(-(width - self.start) // self.per_second)

    def seconds_to_cap(self) -> int | None:
        """Seconds until the cap is reached; None if never."""
        if self.cap == self.start:
            return 0
        return None if self.per_second == 0 else -(-(self.cap - self.start) // self.per_second)
