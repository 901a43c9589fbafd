"""Sketches against sets of shingles."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprint as fp


def words(rnd, n):
    return [rnd.choice("abcdefghijklmnopqrst") + rnd.choice("abcdefghij") for _ in range(n)]


def sets(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(60):
        a = words(rnd, rnd.choice((0, 1, 3, 6, 20, 40, 400, 1500)))
        b = list(a) if k % 3 else words(rnd, 30)
        for _ in range(len(b) // 20):
            b[rnd.randrange(len(b))] = "edit"
        rows.append((k, " ".join(a), " ".join(b + (words(rnd, 200) if k % 5 == 0 else []))))
    return rows


def sketched(spark, rows, k):
    df = spark.createDataFrame(rows, "id long, a string, b string")
    return fp.with_sketch(fp.with_sketch(df, F.col("a"), "sa", k), F.col("b"), "sb", k)


def test_a_large_sketch_is_the_set(spark, pairs):
    k = 100_000
    df = sketched(spark, pairs, k).select("id", "sa", fp.resemblance(F.col("sa"), F.col("sb"), k).alias("r"), fp.containment(F.col("sa"), F.col("sb"), k).alias("c"), fp.distinct_shingles(F.col("sa"), k).alias("d"))
    got = {r.id: r for r in df.collect()}
    for i, a, b in pairs:
        x, y = sets(a), sets(b)
        assert got[i].d == len(x) == len(got[i].sa)
        assert got[i].r == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        assert got[i].c == pytest.approx(len(x & y) / len(x) if x else 1.0)


def test_a_small_sketch_estimates_within_its_error(spark, pairs):
    df = sketched(spark, pairs, 64).select("id", "sa", fp.resemblance(F.col("sa"), F.col("sb")).alias("r"), fp.distinct_shingles(F.col("sa")).alias("d"))
    off = []
    for r in df.collect():
        x, y = sets(pairs[r.id][1]), sets(pairs[r.id][2])
        assert len(r.sa) == min(64, len(x)) and r.sa == sorted(r.sa)
        assert abs(r.r - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.3
        off.append(abs(r.d - len(x)) / max(1, len(x)))
    assert max(off) < 0.5 and sum(off) / len(off) < 0.1


def test_sketches_of_parts_merge_into_that_of_the_whole(spark):
    rnd = random.Random(2)
    w = words(rnd, 900)
    # Parts that overlap by a shingle less one word hold together all shingles.
    parts = [(0, " ".join(w[:404]), " ".join(w[400:]), " ".join(w))]
    df = spark.createDataFrame(parts, "id long, a string, b string, c string")
    for name in "abc":
        df = fp.with_sketch(df, F.col(name), f"s{name}")
    row = df.select(fp.merged(F.col("sa"), F.col("sb")).alias("m"), "sc").first()
    assert row.m == row.sc and len(row.m) == fp.SIZE


def test_empty_single_repeated_and_null_documents(spark):
    schema = "doc_id long, text string, th string, __words int, tail string"
    frame = spark.createDataFrame([(5, "alone here", "x", 1, "y")], schema)
    assert fp.fingerprints(frame.limit(0)).count() == 0
    one = fp.fingerprints(frame).first()
    assert one.near_next == 1.0 and one.n_chars == 10
    rows = [(1, "a b c d e f g", "", 1, ""), (1, "a b c d e f g", "", 1, ""), (2, None, "", 1, ""), (None, "null id", "", 1, ""), (3, "w " * 30_000, "", 1, "")]
    got = fp.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and len({(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_next) for r in got}) == 4
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
