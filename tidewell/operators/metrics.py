"""Counters over time: scraped samples, their rates, and quantiles of bucketed histograms.

A sample is a row of labels, a time and a value; equal labels are one series.
Counters only rise; a value below the one before it means that the counter
started anew from 0.  Times are split into panes that both the step and the range
are whole multiples of.  A pane of a series is one row, so a range is a few rows however many samples
it has, and a long series is spread over tasks by stretches of panes.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Panes of a series that one group holds at least, besides those carried over from the stretch before.
STRETCH = 1024
#: Samples that lie further than this many mean distances inside a range's edge are not extended to it.
REACH = 1.1


def _micros(d: timedelta) -> int:
    us = d // timedelta(microseconds=1)
    if us < 1:
        raise ValueError("a step or range is longer than nothing")
    return us


def _floor(value: Column, unit: int) -> Column:
    """Whole units in a long, rounded down; exact below 0 as well."""
    return ((value - F.pmod(value, F.lit(unit))) / F.lit(unit)).cast("long")


def _ceiling(value: Column, unit: int) -> Column:
    return _floor(value + F.lit(unit - 1), unit)


def _us(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _named(labels: Sequence[str]) -> tuple[list[Column], list[str], list[Column]]:
    """Labels under names that clash with none of the columns made here, and back again."""
    own = [f"label_{i}" for i in range(len(labels))]
    return [F.col(f"`{c}`").alias(n) for c, n in zip(labels, own, strict=True)], own, [F.col(n).alias(c) for c, n in zip(labels, own, strict=True)]


def _scraped(events: DataFrame, labels: Sequence[str], every: timedelta, restart: timedelta, counts: Sequence[Column], time: str) -> DataFrame:
    """Running counts at the end of every pane with events: ``label_*, at_us, totals``."""
    step, run = _micros(every), _micros(restart)
    if run % step:
        raise ValueError("a counter restarts at the end of a scrape")
    given, own, _ = _named(labels)
    rows = events.select(*given, _us(time).alias("us"), *[c.cast("int").alias(f"c{i}") for i, c in enumerate(counts)]).where("us IS NOT NULL")
    panes = rows.groupBy(*own, _ceiling(F.col("us"), step).alias("pane")).agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(counts))])
    # The scrape that ends a run belongs to it, as its range is open on the left.
    so_far = Window.partitionBy(*own, _floor(F.col("pane") - 1, run // step)).orderBy("pane")
    return panes.select(*own, (F.col("pane") * step).alias("at_us"), F.array(*[F.sum(f"c{i}").over(so_far) for i in range(len(counts))]).alias("totals"))


def counters(events: DataFrame, labels: Sequence[str], every: timedelta, restart: timedelta, time: str = "event_time") -> DataFrame:
    """Events as a counter per series: labels, ``at`` and ``value``, a row for each scrape with new events.

    The counter starts anew with every multiple of ``restart``.  Events without a
    time do not count.
    """
    _, own, back = _named(labels)
    rows = _scraped(events, labels, every, restart, [F.lit(1)], time)
    return rows.select(*back, F.timestamp_micros("at_us").alias("at"), F.get("totals", F.lit(0)).cast("double").alias("value"))


def buckets(events: DataFrame, labels: Sequence[str], of: str, bounds: Sequence[float], every: timedelta, restart: timedelta, time: str = "event_time") -> DataFrame:
    """Events as a histogram: a counter per series and bound ``le`` of the values up to it, with a last one for all.

    Values that are null count only in the last bucket.
    """
    if list(bounds) != sorted(set(bounds)):
        raise ValueError("bounds rise")
    _, own, back = _named(labels)
    ends = [*map(float, bounds), float("inf")]
    rows = _scraped(events, labels, every, restart, [*[F.coalesce(F.col(of) <= F.lit(b), F.lit(False)) for b in ends[:-1]], F.lit(1)], time)
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, ends)).alias("le"), F.col("totals").alias("value"))).alias("b")
    exploded = rows.select(*own, "at_us", pairs)
    return exploded.select(*back, F.col("b.le").alias("le"), F.timestamp_micros("at_us").alias("at"), F.col("b.value").cast("double").alias("value"))


def _growth(value: Column, before: Column) -> Column:
    """What a counter gained since the sample before it: all of it after a restart, nothing without such a sample."""
    return F.when(before.isNull(), F.lit(0.0)).when(value >= before, value - before).otherwise(value)


def _ranges(samples: DataFrame, labels: Sequence[str], step: int, span: int, time: str, value: str) -> DataFrame:
    """Per series and step: samples in the range up to it, their growth, and the first and last of them."""
    pane = gcd(step, span)
    wide, stride = span // pane, step // pane
    stretch = max(STRETCH, wide)
    given, own, _ = _named(labels)
    rows = samples.select(*given, _us(time).alias("us"), F.col(value).cast("double").alias("value")).where("us IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    # Of samples at one time the greatest counts.  Everything up to the pane's row is dealt out by series and pane once.
    rows = rows.withColumn("pane", _ceiling(F.col("us"), pane)).repartition(*own, "pane").groupBy(*own, "pane", "us").agg(F.max("value").alias("value"))
    before = F.lag("value").over(Window.partitionBy(*own, "pane").orderBy("us"))
    panes = rows.withColumn("grown", _growth(F.col("value"), before)).groupBy(*own, "pane").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("grown").alias("grown"),
        F.min("us").alias("first_us"),
        F.min_by("value", "us").alias("first_value"),
        F.max("us").alias("last_us"),
        F.max_by("value", "us").alias("last_value"),
    )
    # A stretch also holds the panes before it that its first ranges reach back to.
    stretches = F.array_distinct(F.array(_floor(F.col("pane"), stretch), _floor(F.col("pane") + (wide - 1), stretch)))
    held = panes.withColumn("stretch", F.explode(stretches))
    last = F.lag("last_value").over(Window.partitionBy(*own, "stretch").orderBy("pane"))
    held = held.withColumn("step_in", _growth(F.col("first_value"), last))
    first_end = F.greatest(F.col("pane"), F.col("stretch") * stretch)
    last_end = F.least(F.col("pane") + (wide - 1), F.col("stretch") * stretch + (stretch - 1))
    low, high = _ceiling(first_end, stride), _floor(last_end, stride)
    ends = held.where(low <= high).withColumn("end", F.explode(F.sequence(low, high)))
    return (
        ends.groupBy(*own, "stretch", "end")
        .agg(
            F.sum("n").alias("n"),
            # The step into the first pane comes from outside of the range.
            (F.sum(F.col("grown") + F.col("step_in")) - F.min_by("step_in", "pane")).alias("grown"),
            F.min("first_us").alias("first_us"),
            F.min_by("first_value", "pane").alias("first_value"),
            F.max("last_us").alias("last_us"),
        )
        .select(*own, (F.col("end") * step).alias("end_us"), "n", "grown", "first_us", "first_value", "last_us")
    )


def increase(samples: DataFrame, labels: Sequence[str], every: timedelta, over: timedelta, time: str = "at", value: str = "value") -> DataFrame:
    """How much each counter grew in the range up to each step: labels, ``at``, ``value``.

    A range is open at its start and closed at its end; it has a result if it holds
    two samples or more.  The growth between the first and the last sample is
    extended to the edges of the range: all the way to an edge that is no further than ``REACH``
    mean distances between samples, else by half of one; and at the start never beyond where the counter would have been 0.
    Samples without a time or value do not count; of samples of a series at one time
    the greatest does.
    """
    step, span = _micros(every), _micros(over)
    _, own, back = _named(labels)
    rows = _ranges(samples, labels, step, span, time, value).where("n >= 2")
    covered = (F.col("last_us") - F.col("first_us")).cast("double")
    mean = covered / (F.col("n") - 1)
    extended = lambda gap: F.when(gap >= mean * REACH, mean / 2).otherwise(gap)
    at_start = extended((F.col("first_us") - (F.col("end_us") - span)).cast("double"))
    at_end = extended((F.col("end_us") - F.col("last_us")).cast("double"))
    to_zero = F.when((F.col("grown") > 0) & (F.col("first_value") >= 0), covered * (F.col("first_value") / F.col("grown")))
    at_start = F.least(at_start, to_zero)
    whole = F.col("grown") * ((covered + at_start + at_end) / covered)
    return rows.select(*back, F.timestamp_micros("end_us").alias("at"), whole.alias("value"))


def rate(samples: DataFrame, labels: Sequence[str], every: timedelta, over: timedelta, time: str = "at", value: str = "value") -> DataFrame:
    """``increase`` per second."""
    return increase(samples, labels, every, over, time, value).withColumn("value", F.col("value") / over.total_seconds())


def sum_by(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values of one time added up over all series that agree in the labels ``by``."""
    return values.groupBy(*by, "at").agg(F.sum("value").alias("value"))


def histogram_quantiles(quantiles: Sequence[float], values: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Quantiles of histograms, by interpolation within the bucket that each falls into: ``quantile``, labels, ``at``, ``value``.

    ``values`` has a row per labels, ``at`` and ``le`` with the counts up to that bound; ``le`` is a number or its text.
    Several rows of one bound are added up, so labels left out are summed over.  The first bucket begins at 0, or if its bound is 0
    or less all of it lies there.  A quantile in the last bucket is the bound below it, one in a bucket without
    observations its bound.  Counts that fall from one bound to the next are taken as level.  Without a last bucket
    (``+Inf``), with it alone, or without observations the result is NaN.  A quantile below 0 or above 1 is an infinity.
    """
    given, own, back = _named(labels)
    bound = F.when(F.upper(F.col("le").cast("string")).isin("+INF", "INF", "INFINITY"), F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    rows = values.select(*given, "at", bound.alias("le"), "value").where("le IS NOT NULL AND value IS NOT NULL")
    summed = rows.groupBy(*own, "at", "le").agg(F.sum("value").alias("value"))
    held = summed.groupBy(*own, "at").agg(F.sort_array(F.collect_list(F.struct("le", "value"))).alias("b"))  # a row per bound
    empty = F.array().cast("array<double>")
    level = F.aggregate("b", empty, lambda a, x: F.array_append(a, F.greatest(x["value"], F.coalesce(F.get(a, F.size(a) - 1), x["value"]))))
    held = held.select(*own, "at", F.transform("b", lambda x: x["le"]).alias("le"), level.alias("count"), F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    held = held.withColumn("rank", F.element_at("count", -1) * F.col("quantile")).withColumn("last", F.size("le") - 1)
    held = held.withColumn("i", F.size(F.filter(F.slice("count", F.lit(1), F.col("last")), lambda c: c < F.col("rank"))))
    of = lambda c, i: F.get(F.col(c), i)
    i, last, q = F.col("i"), F.col("last"), F.col("quantile")
    start, under = (F.when(i > 0, of(c, i - 1)).otherwise(0.0) for c in ("le", "count"))
    found = (
        F.when((last < 1) | (F.element_at("le", -1) != F.lit(float("inf"))) | (F.element_at("count", -1) <= 0), F.lit(float("nan")))
        .when(q < 0, F.lit(float("-inf")))
        .when(q > 1, F.lit(float("inf")))
        .when(i >= last, of("le", last - 1))
        .when(((i == 0) & (of("le", i) <= 0)) | (of("count", i) <= under), of("le", i))
        .otherwise(start + (of("le", i) - start) * ((F.col("rank") - under) / (of("count", i) - under)))
    )
    return held.select("quantile", *back, "at", found.alias("value"))


def histogram_quantile(quantile: float, values: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One of ``histogram_quantiles``: labels, ``at``, ``value``."""
    return histogram_quantiles([quantile], values, labels).drop("quantile")
