"""Bit-sliced weights and the draw against plain counting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import importance, queries

SF = "/root/testdata/sf0.001"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, order=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain_draw(docs, target, percent=5, least=20, seed=42, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for rows, count in ((docs, s), (target, t)):
        for _, text in rows:
            count.update(map(bucket, plain_features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in docs:
        words, found = plain_features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts():
    rnd = random.Random(8)
    vocabulary = ["A", "bb", "Été", "ccc", "dd4", "日本", "x" * 64, "y" * 65, "z" * 200, "Q"]
    out = ["", "a", "A-b_c", "é" * 90, "w" * 3000, "a b", " a b c "]
    return out + ["".join(rnd.choice(vocabulary) + rnd.choice((" ", "-", "\n", ". ")) for _ in range(rnd.choice((3, 50, 400)))) for _ in range(40)]


def test_features_are_those_of_plain_splitting():
    rows = texts()
    data = "".join(rows).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in rows])))
    for order in (1, 2, 3, 4):
        doc, bucket, words = importance.features(np.frombuffer(data, np.uint8), offsets, order)
        for i, t in enumerate(rows):
            w, found = plain_features(t, order)
            assert words[i] == len(w) and sorted(bucket[doc == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in found)


def test_weights_of_planes_are_dot_products():
    rnd = np.random.default_rng(2)
    for width in (1, 63, 64, 65, 10_000):
        for spread in (0, 1, 5, 40_000):
            gain = rnd.integers(-spread, spread + 1, width)
            counts = rnd.integers(0, 5000, (7, width)) * (rnd.random((7, width)) < 0.2)
            counts[0] = 0
            assert importance.weights(counts, importance.gain_planes(gain)).tolist() == (counts @ gain).tolist()
    assert importance.weights(np.array([[3, 1]]), importance.gain_planes(np.array([-8, 7]))).tolist() == [-17]


def test_the_query_is_the_plain_draw(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()]
    got = drawn(queries.QUERIES["op13_importance_resampling"](spark, SF))
    assert got == plain_draw(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert any(r[4] for r in got)


def test_ties_nulls_repeated_rows_and_clashing_names(spark):
    rows = list(enumerate(texts())) + [(500, "same " * 30)] * 3 + [(None, "same " * 30)] * 2 + [(501, None), (None, None)]
    target = [(1, "a bb ccc"), (2, None), (None, "same same")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_words", "weight", "score", "able", "rank", "bucket")})
    goal = spark.createDataFrame(target, "item_id long, text string")
    want = plain_draw(rows, target, percent=40)
    assert drawn(importance.resampled(frame, goal, percent=40)) == want
    kept = importance.drawn_documents(frame, goal, percent=40)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[4]}


def test_empty_tables(spark):
    goal = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"word{k} " * 25) for k in range(40)], "doc_id long, text string")
    assert importance.resampled(docs.limit(0), goal).count() == 0
    assert importance.drawn_documents(docs.limit(0), goal).columns == docs.columns
    some = importance.resampled(docs, goal.limit(0)).collect()
    assert len(some) == 40 and sum(r.rank is not None for r in some) == 2


def test_documents_like_the_target_are_drawn(spark):
    rnd = random.Random(1)
    common, rare = [f"c{k}" for k in range(50)], [f"r{k}" for k in range(50)]
    docs = [(k, " ".join(rnd.choices(rare if k % 20 == 0 else common, k=60))) for k in range(400)]
    goal = spark.createDataFrame([(k, " ".join(rnd.choices(rare, k=60))) for k in range(10)], "item_id long, text string")
    picked = importance.drawn_documents(spark.createDataFrame(docs, "doc_id long, text string"), goal)
    assert sorted(r.doc_id for r in picked.collect()) == list(range(0, 400, 20))


@pytest.mark.parametrize("size", [1, 1000])
def test_no_result_depends_on_how_texts_are_split_up(spark, monkeypatch, size):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    goal = spark.createDataFrame([(1, "a bb ccc")], "item_id long, text string")
    whole = drawn(importance.resampled(frame, goal, percent=30))
    gain = importance.gains(frame, goal)
    assert whole == plain_draw(rows, [(1, "a bb ccc")], percent=30)
    import pyarrow as pa

    monkeypatch.setattr(importance, "SPLIT_BYTES", size)
    column = pa.array([t.encode() for _, t in rows], pa.binary())
    seen = []
    for a, b, data, offsets in importance._parts(column, 3):
        assert 1 <= b - a <= 3
        doc, bucket, _ = importance.features(data, offsets)
        seen += importance.weights(np.bincount(doc * 10_000 + bucket, minlength=(b - a) * 10_000).reshape(b - a, -1), importance.gain_planes(gain)).tolist()
    assert seen == [w for _, _, w, *_ in sorted(whole)]
