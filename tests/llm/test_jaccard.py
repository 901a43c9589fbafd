"""N-gram Jaccard join: recall of the candidates, large classes, components, awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import jaccard
from tidewell.llm.components import components
from tidewell.llm.sets import mixed


@pytest.mark.parametrize("percent, size, both", [(85, 37, 34), (80, 90, 80), (85, 740, 680)])
def test_pairs_at_the_threshold_meet_in_a_band(percent, size, both):
    """Pairs that are just linked: all meet, and they share bands as often as ideal min-hashes would."""
    assert 100 * both >= percent * (2 * size - both) > 100 * (both - 1)
    bands = jaccard.bands_for(percent)
    rnd = np.random.default_rng(3)
    tries, met = (3000 if size < 100 else 300), []
    for k in range(tries):
        # Runs of numbers are the structured input that weak hashes fail on; they pass through the shingles' finalizer.
        tokens = mixed(np.arange(2 * size - both, dtype=np.uint64) + np.uint64(k << 20) if k % 2 else rnd.integers(0, 2**63, 2 * size - both).astype(np.uint64))
        a, b = np.sort(tokens[:size]), np.sort(tokens[size - both :])
        met.append(int((jaccard.band_keys(a, bands) == jaccard.band_keys(b, bands)).sum()))
    assert min(met) > 0
    want = (both / (2 * size - both)) ** jaccard.ROWS_PER_BAND
    assert abs(np.mean(met) / bands - want) < 0.03
    assert np.var(met) < 1.5 * bands * want * (1 - want)


def chain(rnd, n, words=40):
    """Texts of which each is near to the ones before and after it, and far from those further away."""
    w = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w[(7 * k) % words] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def plain(texts, n, percent):
    sets = [frozenset(zip(*(t.split()[i:] for i in range(n)), strict=False)) for t in texts]
    links = [0] * len(sets)
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (find(k), links[k]) for k in range(len(sets))}


@pytest.mark.parametrize("block", [16, jaccard.BLOCK])
def test_a_class_of_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rnd = random.Random(4)
    texts = chain(rnd, 300, 60) + chain(rnd, 40, 30)
    rnd.shuffle(texts)
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4, percent=85).collect()
    assert {r.doc_id: (r.component_id, r.n_links) for r in got} == plain(texts, 4, 85)


@pytest.mark.parametrize("heavy", [3, 1000])
def test_components_of_stars_chains_and_random_edges(spark, heavy):
    rnd = random.Random(5)
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5000, 399)] + [(rnd.randrange(2000, 2600), rnd.randrange(2000, 2600)) for _ in range(500)] + [(7, 7)]
    root = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(frame, heavy).collect()} == {v: find(v) for v in root}
    assert components(frame.limit(0), heavy).count() == 0


def test_long_awkward_and_repeated_texts(spark):
    long = " ".join(f"t{k}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (2, long + " end"), (3, "\u00a0 \u2003x é"), (4, "A b"), (5, "a B"), (6, None), (7, "\t\n"), (None, long), (None, None)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, node int, first string").withColumn("bands", F.lit(0))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.n_links) for r in jaccard.jaccard_components(frame, n=4, percent=85).collect())
    assert got == sorted([(1, 1, 3), (2, 1, 3), (2, 1, 3), (-1, 1, 3), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0), (-1, -1, 0)])
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0
    kept = jaccard.without_near_duplicates(frame, n=4, percent=85)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4, 6, 7]
