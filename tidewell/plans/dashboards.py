"""Dashboard queries over counters and histograms that are derived from ``events``.

Events are counted per type and region, and their values put into buckets, as a scrape would
see them every five minutes; counters start anew each day.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import metrics
from tidewell.plans.driver import query, session_events, sql_events

SCRAPE, DAY, HOUR = timedelta(minutes=5), timedelta(days=1), timedelta(hours=1)
BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
LABELS = ("event_type", "region")

_SAMPLES = f"""WITH {sql_events}, panes AS (
  SELECT event_type, region, (epoch_us(event_time) + 299999999) // 300000000 AS pane, count(*) AS n, {{counts}} FROM timed GROUP BY ALL),
running AS (SELECT *, (pane - 1) // 288 AS run FROM panes)"""
_RANGE = """grid AS (SELECT unnest(range((SELECT min(us) // {step} FROM samples), (SELECT (max(us) + {span}) // {step} + 1 FROM samples))) * {step} AS t),
placed AS (SELECT s.*, t, lag(v) OVER (PARTITION BY {labels}, t ORDER BY us) AS before FROM samples s JOIN grid ON t >= us AND t < us + {span}),
ranges AS (
  SELECT {labels}, t, count(*) AS n, min(us) AS first_us, max(us) AS last_us, arg_min(v, us) AS first_v,
         sum(CASE WHEN before IS NULL THEN 0 WHEN v >= before THEN v - before ELSE v END) AS grown
  FROM placed GROUP BY ALL HAVING count(*) >= 2),
gaps AS (
  SELECT *, (last_us - first_us)::DOUBLE AS covered, (last_us - first_us)::DOUBLE / (n - 1) AS mean, (first_us - (t - {span}))::DOUBLE AS head, (t - last_us)::DOUBLE AS tail FROM ranges),
reached AS (
  SELECT *, least(CASE WHEN head >= mean * 1.1::DOUBLE THEN mean / 2 ELSE head END, CASE WHEN grown > 0 AND first_v >= 0 THEN covered * (first_v / grown) END) AS at_start,
         CASE WHEN tail >= mean * 1.1::DOUBLE THEN mean / 2 ELSE tail END AS at_end
  FROM gaps),
increased AS (SELECT {labels}, t AS at_us, grown * ((covered + at_start + at_end) / covered) AS value FROM reached)"""


def _timed(spark, sf_dir) -> DataFrame:
    """The session events with the value that the event table has for them."""
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), "value")
    return session_events(spark, sf_dir).select("n", "event_time", *LABELS).join(values, "n")


def _counter_sql(step: timedelta, span: timedelta, labels: str = "event_type, region") -> str:
    us = [d // timedelta(microseconds=1) for d in (step, span)]
    samples = "samples AS (SELECT event_type, region, pane * 300000000 AS us, (sum(n) OVER (PARTITION BY event_type, region, run ORDER BY pane))::DOUBLE AS v FROM running)"
    head = _SAMPLES.replace(", {counts}", "")
    return f"{head}, {samples}, {_RANGE.format(step=us[0], span=us[1], labels=labels)}"


def _bucket_sql(step: timedelta, span: timedelta) -> str:
    us = [d // timedelta(microseconds=1) for d in (step, span)]
    counts = ", ".join(f"count(*) FILTER (value <= {b}) AS c{i}" for i, b in enumerate(BOUNDS))
    ends = [*(f"{b}::DOUBLE" for b in BOUNDS), "'infinity'::DOUBLE"]
    each = ", ".join(f"{{'le': {e}, 'c': {f'c{i}' if i < len(BOUNDS) else 'n'}}}" for i, e in enumerate(ends))
    samples = f"""exploded AS (SELECT event_type, region, pane, run, unnest([{each}]) AS b FROM running),
samples AS (SELECT event_type, region, b.le AS le, pane * 300000000 AS us, (sum(b.c) OVER (PARTITION BY event_type, region, b.le, run ORDER BY pane))::DOUBLE AS v FROM exploded)"""
    return f"{_SAMPLES.format(counts=counts)}, {samples}, {_RANGE.format(step=us[0], span=us[1], labels='event_type, region, le')}"


def _shown(values: DataFrame, *labels: str) -> DataFrame:
    return values.select(*labels, F.unix_micros("at").alias("at_us"), F.round("value", 6).alias("value"))


def _samples(spark, sf_dir) -> DataFrame:
    return metrics.counters(session_events(spark, sf_dir), LABELS, SCRAPE, DAY)


@query("metric_increase", f"{_counter_sql(HOUR, 6 * HOUR)} SELECT event_type, region, at_us, round(value, 6) AS value FROM increased")
def metric_increase(spark, sf_dir):
    """Growth of each counter over six hours, by the hour; the range meets a restart every day."""
    return _shown(metrics.increase(_samples(spark, sf_dir), LABELS, HOUR, 6 * HOUR), *LABELS)


@query("metric_rate", f"{_counter_sql(timedelta(minutes=40), timedelta(hours=1))} SELECT event_type, region, at_us, round(value / 3600 * 60, 6) AS value FROM increased")
def metric_rate(spark, sf_dir):
    """Events a minute over an hour, every 40 minutes: step and range share panes of 20 minutes."""
    found = metrics.rate(_samples(spark, sf_dir), LABELS, timedelta(minutes=40), HOUR)
    return _shown(found.withColumn("value", F.col("value") * 60), *LABELS)


@query("metric_rate_by_type", f"{_counter_sql(HOUR, 6 * HOUR)} SELECT event_type, at_us, round(sum(value / 21600 * 60), 6) AS value FROM increased GROUP BY 1, 2")
def metric_rate_by_type(spark, sf_dir):
    """Events a minute by type, summed over regions after the rate."""
    found = metrics.sum_by(metrics.rate(_samples(spark, sf_dir), LABELS, HOUR, 6 * HOUR), ["event_type"])
    return _shown(found.withColumn("value", F.col("value") * 60), "event_type")


_QUANTILE = """counted AS (SELECT {by}at_us, le, sum(value / {seconds}) AS c FROM increased GROUP BY ALL),
level AS (SELECT *, max(c) OVER (PARTITION BY {by}at_us ORDER BY le) AS up, max(c) OVER (PARTITION BY {by}at_us) AS whole, lag(le) OVER (PARTITION BY {by}at_us ORDER BY le) AS low FROM counted),
steps AS (SELECT *, lag(up) OVER (PARTITION BY {by}at_us ORDER BY le) AS under FROM level),
wanted AS (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile),
hit AS (SELECT *, row_number() OVER (PARTITION BY {by}at_us, quantile ORDER BY le) AS rn FROM steps, wanted WHERE whole > 0 AND (up >= whole * quantile OR isinf(le)))
SELECT quantile, {by}at_us, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * ((whole * quantile - coalesce(under, 0)) / (up - coalesce(under, 0))) END, 6) AS value FROM hit WHERE rn = 1
UNION ALL SELECT quantile, {by}at_us, 'nan'::DOUBLE FROM steps, wanted WHERE isinf(le) AND NOT whole > 0"""


def _bucket_rates(spark, sf_dir) -> DataFrame:
    samples = metrics.buckets(_timed(spark, sf_dir), LABELS, "value", BOUNDS, SCRAPE, DAY)
    return metrics.rate(samples, [*LABELS, "le"], HOUR, 6 * HOUR)


@query("metric_quantiles", f"{_bucket_sql(HOUR, 6 * HOUR)}, {_QUANTILE.format(by='event_type, region, ', seconds=21600)}")
def metric_quantiles(spark, sf_dir):
    """Median, 95th and 99th percentile of each series' values over six hours, from its buckets."""
    return _shown(metrics.histogram_quantiles([0.5, 0.95, 0.99], _bucket_rates(spark, sf_dir), LABELS), "quantile", *LABELS)


@query("metric_quantiles_by_region", f"{_bucket_sql(HOUR, 6 * HOUR)}, {_QUANTILE.format(by='region, ', seconds=21600)}")
def metric_quantiles_by_region(spark, sf_dir):
    """The same by region: buckets of all types are added up before the quantile."""
    return _shown(metrics.histogram_quantiles([0.5, 0.95, 0.99], _bucket_rates(spark, sf_dir), ["region"]), "quantile", "region")
