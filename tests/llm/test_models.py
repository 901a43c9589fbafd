"""The two classifiers against plain loops, and their awkward inputs."""

import random
from bisect import bisect_right
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import quality, toxicity

MARKS = ["^idiot", "scum", "^worthless", "tras"]


def plain_kernel(s, t, order, decay):
    """The sum over all pairs of equal subsequences of the discount of the spans of both."""
    total = 0.0
    for i in combinations(range(len(s)), order):
        for j in combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def common(s, t):
    """Length of the longest common subsequence."""
    last = [0] * (len(t) + 1)
    for c in s:
        row = [0]
        for j, d in enumerate(t):
            row.append(last[j] + 1 if c == d else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def plain_values(word, kernel):
    """The greatest likeness of a word's windows with each landmark."""
    word, out = toxicity.START + word, {}
    step = toxicity.WINDOW // 2
    windows = [word] if len(word) <= toxicity.WINDOW else [word[a : a + toxicity.WINDOW] for a in range(0, max(1, len(word) - step), step)]
    for w in windows:
        for k, z in enumerate(kernel.landmarks):
            covered = common(w, z)
            if covered >= kernel.need[k]:
                like = min(covered / len(z), plain_kernel(w, z, kernel.order, kernel.decay) / plain_kernel(z, z, kernel.order, kernel.decay))
                out[k] = max(out.get(k, 0.0), like)
    return out


@pytest.mark.parametrize("marks", [MARKS, [], ["abc"]])
def test_kernel_values_are_those_of_all_subsequences(marks):
    kernel = toxicity.LandmarkKernel(marks)
    rnd = random.Random(1)
    words = ["idiot", "i-d-i-o-t", "idxiot", "idi", "scummy", "sc.um", "wworthlesss", "trash", "é中\U0001f600", "a", "id" * 20 + "idiot", "x" * 30 + "worth-less"]
    words += ["".join(rnd.choice("idotscum") for _ in range(rnd.randrange(1, 12))) for _ in range(60)]
    got: dict = {w: {} for w in range(len(words))}
    for w, z, x in zip(*(v.tolist() for v in kernel.values(words)), strict=True):
        got[w][z] = max(got[w].get(z, 0.0), x)
    for k, w in enumerate(words):
        assert got[k] == pytest.approx(plain_values(w, kernel)), w
    if marks == MARKS:
        assert all(got[k] for k in (0, 1, 2, 4, 5, 6, 7)) and not got[3]


def plain_sentences(tokens, kernel):
    """Kernel maxima of each sentence with a word that takes part, token by token."""
    out, began, row = [], 0, None
    for at, w in enumerate(tokens):
        if at and tokens[at - 1][-1] in ".!?":
            began, row = at, None
        found = plain_values(w, kernel)
        if found:
            if row is None or at - began >= toxicity.SENTENCE_WORDS:
                began = at if at - began >= toxicity.SENTENCE_WORDS else began
                out.append(row := np.zeros(len(kernel.landmarks)))
            for z, x in found.items():
                row[z] = max(row[z], x**toxicity.SHARPNESS)
    return out or [np.zeros(len(kernel.landmarks))]


def test_sentences_are_those_of_a_plain_walk():
    kernel = toxicity.LandmarkKernel(MARKS)
    model = toxicity.ToxicityModel(kernel, np.ones(len(MARKS)), -0.5, np.array([1.0, 0.5, 0.5, 0.0]))
    rnd = random.Random(2)
    texts = [None, "", " \n", "idiot", "no mark here.", "Idiot! scum. i d i o t ?"]
    texts += [" ".join(rnd.choice(["idiot", "scum", "worthless!", "end.", *["word", "other", "plain"] * rnd.choice((2, 30))]) for _ in range(rnd.randrange(1, 300))) for _ in range(40)]
    bags, words = model.features(texts)
    for text, bag, n in zip(texts, bags, words, strict=True):
        tokens = toxicity.words_of(text)
        assert n == len(tokens)
        assert bag == pytest.approx(np.array(plain_sentences(tokens, kernel)))
    # The memo of words does not change a score, nor do the texts beside one.
    together = model.scores(texts)
    assert [model.scores([t])[0] for t in texts] == pytest.approx(together)


def test_the_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "_MEMO_MOST", 20)
    model = toxicity.ToxicityModel(toxicity.LandmarkKernel(MARKS), np.ones(len(MARKS)), -0.5, np.array([1.0, 0.5, 0.5, 0.0]))
    texts = [f"idiot w{k} v{k} scum{k}. u{k} worthless" for k in range(12)]
    want = [toxicity.ToxicityModel(model.kernel, model.weights, model.bias, model.scale).scores([t])[0] for t in texts]
    assert [model.scores([t])[0] for t in texts] == pytest.approx(want)
    assert model.scores(texts) == pytest.approx(want)


def test_table_look_ups_are_sums_of_plain_entries():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = quality.fit(x, y)
    assert len(model.pairs) == quality.PAIRS and (1, 2) in model.pairs
    fresh = np.vstack([rnd.normal(size=(50, 5)) * 3, x[:50]])
    for row, got in zip(fresh, model.scores(fresh), strict=True):
        total = model.base
        for j, edges in enumerate(model.edges):
            total += model.tables[j][bisect_right(edges.tolist(), row[j])]
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            total += table[bisect_right(model.pair_edges[a].tolist(), row[a])][bisect_right(model.pair_edges[b].tolist(), row[b])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
@pytest.mark.parametrize("only", ["false", "{} = 1", "{} = 0"])
def test_labels_of_one_class_or_none(tables, module, label, only):
    docs, labels = tables
    model = module.train(docs, labels.where(only.format(label)))
    scores = {r.score for r in module.score(docs, model).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1


@pytest.mark.parametrize("module, label, keep", [(toxicity, "toxic", toxicity.without_toxic), (quality, "quality", quality.good_documents)])
def test_repeated_rows_and_clashing_names(tables, module, label, keep):
    docs, labels = tables
    model = module.train(docs, labels)
    text = docs.where("length(text) > 100").first().text
    rows = docs.sparkSession.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (2, None), (5, "long " * 50_000)], "doc_id long, text string")
    clash = rows.withColumns({c: F.lit("x") for c in ("score", "held_out", "predicted", "label_id", "y", label)})
    got = module.score(clash, model)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == 7
    assert len({r.score for r in got if r.doc_id in (1, None)}) == 1 and len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    kept = keep(clash, model)
    assert kept.columns == clash.columns
    passed = (lambda s: s < 0.5) if module is toxicity else (lambda s: s >= quality.THRESHOLD)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if passed(r.score))
    assert keep(clash.limit(0), model).count() == 0
    assert module.train(docs.withColumns({c: F.lit("x") for c in ("label_id", "y", label)}), labels) is not None


def test_altered_insults_are_flagged_nearly_as_often_as_plain_ones():
    """Clean held-out texts with insults put in: as they are, with marks between letters, a letter doubled, a letter put in."""
    import zlib

    import duckdb

    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, text, toxic, lang FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL ORDER BY doc_id").fetchall()
    kept_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    model = toxicity.fit([(t, y) for i, t, y, _ in rows if not kept_out(i)])
    clean = [t for i, t, y, lang in rows if kept_out(i) and y == 0 and lang == "en" and len(t.split()) > 60]
    clean = [t for t, s in zip(clean, model.scores(clean), strict=True) if s < 0.5][:60]
    insults = ["idiot", "clown", "pathetic", "worthless", "moron", "stupid"]
    ways = {
        "plain": lambda w, rnd: w,
        "dots": lambda w, rnd: ".".join(w),
        "doubled": lambda w, rnd: w[: (k := rnd.randrange(1, len(w)))] + w[k - 1] + w[k:],
        "letter": lambda w, rnd: w[: (k := rnd.randrange(1, len(w)))] + "x" + w[k:],
    }
    flagged = {}
    for name, way in ways.items():
        rnd = random.Random(6)
        texts = []
        for t in clean:
            words = t.split(" ")
            for w in insults:
                words.insert(rnd.randrange(1, len(words)), way(w, rnd))
            texts.append(" ".join(words))
        flagged[name] = float((model.scores(texts) >= 0.5).mean())
    assert flagged["plain"] >= 0.85
    assert min(flagged["dots"], flagged["doubled"]) >= flagged["plain"] - 0.05 and flagged["letter"] >= flagged["plain"] - 0.12


def test_alterations_touch_only_words_with_a_landmark():
    rnd = random.Random(1)
    for _ in range(50):
        words = toxicity.altered("An Idiot, i.d.i.o.t and idle folk", ["^idiot"], rnd).split()
        assert [words[0], words[3:]] == ["an", ["and", "idle", "folk"]]
        assert all(w[0] == "i" and len(w.rstrip(",")) == 6 and w.rstrip(",")[-1] == "t" for w in words[1:3])
    assert toxicity.altered("", ["^x"], rnd) == ""
