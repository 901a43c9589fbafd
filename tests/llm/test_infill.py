"""Cuts and their matrix against plain scans."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import infill


def test_ranks_are_counts():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        seq = rnd.integers(0, 8, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(seq)
        at = np.arange(n + 1)
        for c in range(8):
            assert matrix.rank(c, at).tolist() == np.concatenate(([0], np.cumsum(seq == c))).tolist()


def texts():
    rnd = random.Random(4)
    out = ["", "a", "é", "🙂", "\n", "two words", "a\nb\n\nc", "  lead", "日本 語\n"]
    return out + ["".join(rnd.choice("ab é日🙂 \n\t") for _ in range(rnd.choice((5, 60, 700)))) for _ in range(60)]


def plain_cut(text, unit, k):
    """Characters before the k-th next unit, by a scan."""
    begins = {
        "character": list(range(len(text))),
        "word": [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)],
        "line": [i for i in range(len(text)) if i == 0 or text[i - 1] == "\n"],
    }[unit]
    return len(begins), begins[k] if k < len(begins) else len(text)


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_cuts_are_those_of_a_scan(unit, size):
    rows = texts()
    rnd = np.random.default_rng(7)
    h = rnd.integers(0, 2**32, (2, len(rows)))
    found = infill.cut_places(pa.array([t.encode() for t in rows], pa.binary()), (h[0], h[1]), unit, size)
    for t, n, one, two, b1, b2, x, y in zip(rows, *found, *h, strict=True):
        assert n == plain_cut(t, unit, 0)[0]
        assert (one, two) == tuple(sorted((x % (n + 1), y % (n + 1))))
        for k, b in ((one, b1), (two, b2)):
            assert b == len(t[: plain_cut(t, unit, k)[1]].encode())


def test_cuts_of_a_slice():
    rows = pa.array([b"xx", b"abc", b"de f", b""], pa.binary()).slice(1)
    zero = np.zeros(3, np.int64)
    assert infill.cut_places(rows, (zero + 1, zero + 2))[3].tolist() == [1, 1, 0]


def by_hand(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in infill.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_documents_by_hand(spark):
    more = [None, "with <M> in it", "<<P", "x<S", "<" * 50, "<M<M<M" * 9, "w " * 40_000, "é\r\n\x00z" * 30]
    rows = list(enumerate(texts() + more)) + [(3, "again"), (3, "again"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("cut", "form", "h1", "prefix", "output")})
    made = infill.infilled(frame).withColumn("back", infill.restored(F.col("form"), F.col("output"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.output) for r in made) == sorted((i is None, i or 0, by_hand(i, t)[4]) for i, t in rows)
    texts_of = {}
    for i, t in rows:
        texts_of.setdefault(i, set()).add(t or "")
    for r in made:
        assert r.back in texts_of[r.doc_id]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == by_hand(r.doc_id, r.back)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert infill.infilled(frame.limit(0)).count() == 0


def test_other_units_shares_and_markers(spark):
    frame = spark.createDataFrame([(k, "one two  three\nfour five " * (k % 4)) for k in range(40)], "doc_id long, text string")
    own = ("[pre]", "[suf]", "[mid]")
    made = infill.infilled(frame, "word", seed=9, transformed=100, suffix_first=100, markers=own)
    for r in made.withColumn("back", infill.restored(F.col("form"), F.col("output"), own)).collect():
        text = "one two  three\nfour five " * (r.doc_id % 4)
        assert r.back == text and r.form == ("spm" if text else "plain")
        if text:
            assert r.prefix + r.middle + r.suffix == text and r.n == len(text.split())
            assert r.prefix_units == len(r.prefix.split()) and r.middle_units == len(r.middle.split())
    assert infill.infilled(frame, transformed=0).where("form <> 'plain'").count() == 0


@pytest.mark.parametrize("markers", [("<P>", "<P>", "<M>"), ("ab", "bc", "xx"), ("aba", "q", "z"), ("a", "bab", "c"), ("", "x", "y")])
def test_markers_that_could_be_mistaken_are_refused(spark, markers):
    with pytest.raises(ValueError, match="markers"):
        infill.infilled(spark.createDataFrame([], "doc_id long, text string"), markers=markers)


def test_unknown_units_are_refused(spark):
    with pytest.raises(ValueError, match="unit"):
        infill.infilled(spark.createDataFrame([], "doc_id long, text string"), "page")
