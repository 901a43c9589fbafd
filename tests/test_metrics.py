"""Rates and quantiles against plain loops over one series at a time."""

import math
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import metrics

SCHEMA = "le string, pane string, at timestamp, value double"
SECOND = timedelta(seconds=1)


def at(seconds):
    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)


def plain_increase(series, step, span):
    """Results by step of one series of (seconds, value)."""
    held = {}
    for t, v in series:
        if t is not None and v is not None and not math.isnan(v):
            held[t] = max(v, held.get(t, v))
    points = sorted(held.items())
    out = {}
    if not points:
        return out
    for k in range(math.floor(points[0][0] / step), math.ceil((points[-1][0] + span) / step) + 1):
        end = k * step
        inside = [(t, v) for t, v in points if end - span < t <= end]
        if len(inside) < 2:
            continue
        grown = sum(b - a if b >= a else b for (_, a), (_, b) in zip(inside, inside[1:], strict=False))
        covered = inside[-1][0] - inside[0][0]
        mean = covered / (len(inside) - 1)
        head, tail = (mean / 2 if gap >= 1.1 * mean else gap for gap in (inside[0][0] - (end - span), end - inside[-1][0]))
        if grown > 0 and inside[0][1] >= 0:
            head = min(head, covered * inside[0][1] / grown)
        out[end] = grown * (covered + head + tail) / covered
    return out


def made_series():
    rnd = random.Random(11)
    out = {}
    for k in range(12):
        t, v, points = rnd.choice((-5000, 0, 70_000)), 0.0, []
        for _ in range(rnd.choice((1, 2, 5, 60, 200))):
            t += rnd.choice((1, 15, 15, 15, 15, 400, 3000))
            v = rnd.choice((v, v + 1, v + rnd.random() * 9, v + 30, 0.0 if rnd.random() < 0.2 else v, rnd.random() * 3 if rnd.random() < 0.2 else v))
            points.append((t, v))
        points += [points[0], (points[-1][0], points[-1][1] - 1), (None, 5.0), (t, None), (t + 3, float("nan"))]
        rnd.shuffle(points)
        out[f"s{k}" if k else None] = points
    return out


@pytest.mark.parametrize(("step", "span"), [(60, 60), (15, 300), (60, 90), (300, 60), (7, 7000)])
def test_increase_is_that_of_a_plain_loop(spark, monkeypatch, step, span):
    monkeypatch.setattr(metrics, "STRETCH", 8)
    series = made_series()
    rows = [(s, "x", None if t is None else at(t), v) for s, points in series.items() for t, v in points]
    found = metrics.increase(spark.createDataFrame(rows, SCHEMA), ["le", "pane"], step * SECOND, span * SECOND).collect()
    got = {(r["le"], round(r["at"].replace(tzinfo=UTC).timestamp())): r["value"] for r in found}
    want = {(s, end): v for s, points in series.items() for end, v in plain_increase(points, step, span).items()}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_rate_sums_and_empty_samples(spark):
    rows = [(s, "x", at(t), float(t * f)) for s, f in (("a", 1), ("b", 3), (None, 2)) for t in range(0, 601, 15)]
    frame = spark.createDataFrame(rows, SCHEMA)
    rates = metrics.rate(frame, ["le", "pane"], 60 * SECOND, 300 * SECOND)
    one = {(r["le"], r["at"]): r["value"] for r in rates.where(F.unix_seconds("at").between(300, 600)).collect()}
    assert len(one) == 18 and all(v == pytest.approx({"a": 1, "b": 3, None: 2}[s]) for (s, _), v in one.items())
    total = metrics.sum_by(rates, ["pane"]).where(F.unix_seconds("at").between(300, 600)).collect()
    assert len(total) == 6 and all(r["value"] == pytest.approx(6) for r in total)
    assert metrics.rate(frame.limit(0), ["le"], SECOND, SECOND).count() == 0
    with pytest.raises(ValueError, match="longer"):
        metrics.rate(frame, ["le"], SECOND, timedelta(0))


def test_a_hot_series_is_spread_over_stretches(spark):
    """No window or group of the plan is by series alone."""
    frame = spark.createDataFrame([("a", "x", at(0), 1.0)], SCHEMA)
    plan = metrics.increase(frame, ["le"], SECOND, 5 * SECOND)._jdf.queryExecution().executedPlan().toString()
    keys = [line[line.index("hashpartitioning(") :] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and all("pane" in k or "stretch" in k for k in keys)


HISTOGRAMS = {
    "even": ([("1", 10.0), ("2", 20.0), ("4", 40.0), ("+Inf", 40.0)], {0.5: 2.0, 0.25: 1.0, 0.75: 3.0, 1.0: 4.0, -0.1: float("-inf"), 1.1: float("inf")}),
    "tail": ([("1", 1.0), ("2", 2.0), ("+Inf", 100.0)], {0.5: 2.0, 0.01: 1.0, 1.0: 2.0}),
    "negative": ([("-5", 4.0), ("5", 8.0), ("+Inf", 8.0)], {0.25: -5.0, 0.75: 0.0}),
    "unsorted": ([("+Inf", 8.0), ("2", 8.0), ("1", 4.0)], {0.25: 0.5, 0.75: 1.5}),
    "falls": ([("1", 6.0), ("2", 5.0), ("4", 8.0), ("+Inf", 8.0)], {0.5: 4 / 6, 1.0: 4.0}),
    "halves": ([("1", 2.0), ("1", 2.0), ("2", 8.0), ("+Inf", 3.0), ("+Inf", 5.0)], {0.25: 0.5, 0.75: 1.5}),
    "no last": ([("1", 2.0), ("2", 4.0)], {0.5: float("nan")}),
    "last alone": ([("+Inf", 4.0)], {0.5: float("nan")}),
    "nothing": ([("1", 0.0), ("+Inf", 0.0)], {0.5: float("nan")}),
    "empty first": ([("1", 0.0), ("2", 4.0), ("+Inf", 4.0)], {0.5: 1.5, 0.0: 1.0}),
}


def test_quantiles_of_histograms(spark):
    rows = [(name, le, at(0), v) for name, (bounds, _) in HISTOGRAMS.items() for le, v in bounds] + [("even", None, at(0), 9.0), ("even", "9", at(0), None)]
    frame = spark.createDataFrame(rows, "name string, le string, at timestamp, value double")
    quantiles = sorted({q for _, want in HISTOGRAMS.values() for q in want})
    got = {(r["name"], r["quantile"]): r["value"] for r in metrics.histogram_quantiles(quantiles, frame, ["name"]).collect()}
    assert len(got) == len(HISTOGRAMS) * len(quantiles)
    for name, (_, want) in HISTOGRAMS.items():
        for q, v in want.items():
            assert got[name, q] == pytest.approx(v, nan_ok=True), (name, q)
    assert metrics.histogram_quantile(0.5, frame.limit(0), ["name"]).columns == ["name", "at", "value"]


def test_scrapes_of_events(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), at(rnd.randrange(1, 4000)), rnd.choice((None, 0.5, 1.0, 3.0, 50.0))) for _ in range(300)] + [("a", None, 1.0)]
    frame = spark.createDataFrame(rows, "s string, event_time timestamp, v double")
    got = {(r.s, r.at.replace(tzinfo=UTC)): r.value for r in metrics.counters(frame, ["s"], 60 * SECOND, 1800 * SECOND).collect()}
    found = {(r.s, r.at.replace(tzinfo=UTC), r.le): r.value for r in metrics.buckets(frame, ["s"], "v", (1, 10), 60 * SECOND, 1800 * SECOND).collect()}
    assert len(found) == 3 * len(got)
    for (s, end), value in got.items():
        t = end.timestamp()
        run = math.floor((t / 60 - 1) / 30) * 1800
        inside = [v for x, e, v in rows if x == s and e is not None and run < e.timestamp() <= t]
        assert value == len(inside) == found[s, end, float("inf")]
        for le in (1.0, 10.0):
            assert found[s, end, le] == sum(v is not None and v <= le for v in inside)
    with pytest.raises(ValueError, match="scrape"):
        metrics.counters(frame, ["s"], 60 * SECOND, 90 * SECOND)
    with pytest.raises(ValueError, match="rise"):
        metrics.buckets(frame, ["s"], "v", (2, 1), 60 * SECOND, 60 * SECOND)
