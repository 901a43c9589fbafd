"""The corpus operators against brute force, libraries, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm import fingerprint, jaccard, mixing, packing, quality, tokens, toxicity
from tidewell.llm.chat import reply_ordered

SF = "/root/testdata/sf0.01"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = [None, "", " ", "a", "tie tie tie tie", "tie tie tie tie", "é中\U0001f600 x y", "<|endoftext|>it's", "\n\n  \t", "z" * 20_000, "w " * 9_000]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "x", None, "clash") for i, t in enumerate(AWKWARD)] + [(None, "no id", None, "s", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string")


def auc(pairs):
    ranked = sorted(pairs)
    ones = [i for i, (_, y) in enumerate(ranked) if y]
    zeros = len(ranked) - len(ones)
    return (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * zeros)


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.75)])
def test_held_out_ranking(documents, labels, module, label, least):
    model = module.train(documents, labels)
    scored = module.score(documents, model)
    assert scored.count() == documents.count()
    held = scored.where("held_out").join(labels, "doc_id").select("score", label).collect()
    assert all(0 <= s <= 1 for s, _ in held)
    assert auc([tuple(r) for r in held]) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_awkward_texts_are_scored(documents, labels, awkward, module):
    model = module.train(documents, labels)
    got = module.score(awkward, model).collect()
    assert len(got) == len(AWKWARD) + 1
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert module.score(awkward.limit(0), model).count() == 0


def test_tokens_are_the_librarys(documents, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    for frame in (documents.limit(200), awkward):
        rows = frame.select("doc_id", "text").collect()
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
        got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in tokens.token_counts(frame, VOCAB).collect())
        assert got == want


def test_packing_loses_no_id(documents, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCAB)
    frame = documents.limit(150).select("doc_id", "text").union(awkward.where("doc_id >= 0").select(F.col("doc_id") + 10**9, "text"))
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    pieces = packing.pack(frame, VOCAB, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == p.length
        assert zlib.crc32(np.asarray(p.ids, "<u4").tobytes()) == p.ids_crc32
    for doc_id, text in texts.items():
        joined = [i for p in sorted(by_doc[doc_id], key=lambda p: p.start) for i in p.ids]
        assert joined == library.encode(text, add_special_tokens=False).ids + [1]
    for inside in by_seq.values():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_best_fit_takes_the_tightest_window():
    # Remaining rooms are 4 and 2 when the last item comes; it goes to the tighter one.
    window, offset = packing.best_fit([8, 6, 2], 10)
    assert window[0] != window[1]
    assert window[2] == window[0] and offset[2] == 8


def shingle_set(text, n):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(zip(*(w[i:] for i in range(n)), strict=False))


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_links_are_those_of_brute_force(spark, n, percent):
    rnd = random.Random(3)
    texts = ["", None, "one two", "one two", "One TWO"]
    for _ in range(12):
        base = [rnd.choice("abcdefghijklmnop") * 3 for _ in range(60)]
        for edits in range(5):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(60)] = "edit"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}


def test_one_of_each_near_group_stays(spark):
    words = [f"w{i}" for i in range(100)]
    near = words[:99] + ["other"]
    rows = [(1, " ".join(words), "c"), (2, " ".join(near), "c"), (3, "quite another text of seven words", "c"), (4, " ".join(words), "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    kept = jaccard.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == 2 and 3 in ids


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    words = [f"w{i}" for i in range(100)]
    first, near = " ".join(words), " ".join(words[:99] + ["other"])
    lone, bare = "a text that nothing else is like at all", " ".join(f"v{i}" for i in range(60))
    rows = [(7, first), (7, near), (5, lone), (5, bare), (None, bare), (None, near), (9, first), (None, "no id but this text twice here"), (None, "no id but this text twice here")]
    rows += [(None, " ".join(f"u{i}" for i in range(80))), (None, " ".join([*(f"u{i}" for i in range(79)), "other"])), (3, bare), (None, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.n_links) for r in jaccard.jaccard_components(frame).collect())
    u = [(-1, 76, -1, 1)] * 2
    want = [(7, 96, 7, 3), (7, 96, 7, 3), (9, 96, 7, 3), (-1, 96, 7, 3), (5, 5, 5, 0), (5, 56, 3, 2), (-1, 56, 3, 2), (3, 56, 3, 2), *u]
    want += [(-1, 3, -1, 1)] * 2 + [(-1, 0, -1, 0)] * 2
    assert got == sorted(want)
    kept = [(r.doc_id, r.text) for r in jaccard.without_near_duplicates(frame).collect()]
    assert len(kept) == 7
    assert (5, lone) in kept and (3, bare) in kept and kept.count((None, None)) == 2
    assert sum(i == 7 for i, _ in kept) == 1 and kept.count((None, "no id but this text twice here")) == 1
    assert sum(i is None and (t or "").startswith("u0 ") for i, t in kept) == 1


def test_mix_meets_the_targets(spark, documents, awkward):
    rows = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    total, taken, target, size = sum(r["size"] for r in rows), defaultdict(int), {}, {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(target))}
    open_, left, want = set(weight), 1.5 * total, {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in over}
        left -= sum(2.0 * size[s] for s in over)
        open_ -= over
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert mixing.mix(awkward).count() == awkward.count()
    assert mixing.mixed_documents(awkward).columns == awkward.columns


def test_fingerprints_follow_the_contract(spark, awkward):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, " ".join(f"other{i}" for i in range(150))), (4, None), (5, "short")]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = {i: t or "" for i, t in rows}
    for i in text:
        n, after = len(text[i]), text[i % 5 + 1]
        edited = text[i][: n - n // 2] + after[: n // 2]
        assert got[i].n_chars == n
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[2].near_next == 0.0
    assert fingerprint.fingerprints(awkward).count() == awkward.count()


def test_quoted_messages_are_linked_and_cut(spark):
    rows = [
        (1, 0, "user", "How do I sort a list in place?"),
        (1, 1, "assistant", "> How do I sort a list in place?\n\nCall its sort method."),
        (1, 2, "user", "> Call its sort method.\n>> How do I sort a list in place?\n\nThat works, thanks."),
        (1, 3, "user", None),
        (None, 0, "user", "alone"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in reply_ordered(frame).collect()}
    assert len(got) == len(rows)
    assert got[1, 1].reply_to == 0 and got[1, 1].text.strip() == "Call its sort method."
    assert got[1, 2].reply_to == 1 and ">" not in got[1, 2].text
    assert got[1, 0].reply_to is None
    assert reply_ordered(frame.limit(0)).count() == 0


def test_quotes_that_nobody_said_stay(spark):
    rows = [
        (1, 0, "user", "What of this?\n> a saying from a book\n>\n> and its end\n>>> print(1)\nNo idea."),
        (1, 1, "assistant", "U wrote:\n> No idea.\n>> a saying from a book\n\nA proverb.\n> new words"),
        (2, 0, "user", "> alone"),
    ]
    got = {(r.conv_id, r.turn): r for r in reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 0].text == rows[0][3] and got[2, 0].text == "> alone"
    assert got[1, 1].text == "A proverb.\n> new words"
    assert (got[1, 1].reply_to, got[1, 0].n_linked) == (0, 0)


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        assert docs.count() > 0, name
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    assert pieces.where("offset + length > 2048").count() == 0


def test_pipeline_stages_are_those_of_brute_force(spark):
    import corpus_pipeline

    sf_dir = SF
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    marked = {r.doc_id: r for r in labels.collect()}
    rows = [r.asDict() for r in docs.collect()]
    toxic = [r for r in rows if r["doc_id"] in marked and marked[r["doc_id"]].toxic][:5]
    poor = [r for r in rows if r["doc_id"] in marked and not marked[r["doc_id"]].quality][:5]
    near = [r for r in rows if len((r["text"] or "").split()) > 60][:10]
    planted = [dict(r, doc_id=10**6 + i) for i, r in enumerate(toxic + poor)] + [dict(r, doc_id=2 * 10**6 + i, text=r["text"] + " planted") for i, r in enumerate(near)]
    docs = spark.createDataFrame(rows + planted, docs.schema).cache()
    stages = dict(corpus_pipeline.STAGES)

    def pairs(frame):
        return sorted((r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect())

    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    model = toxicity.train(docs, labels)
    assert pairs(clean) == [x for x in pairs(docs) if model.scores([x[1]])[0] < 0.5]
    assert 0 < clean.count() < docs.count()

    good = stages["quality"](spark, clean, sf_dir).cache()
    model = quality.train(clean, labels)
    assert pairs(good) == [x for x in pairs(clean) if model.scores(quality.features([x[1]]))[0] >= quality.THRESHOLD]
    assert 0 < good.count() < clean.count()

    single = stages["near_duplicates"](spark, good, sf_dir).cache()
    sets = {i: shingle_set(t, 5) for i, t in pairs(good)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(1, len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert pairs(single) == [x for x in pairs(good) if root[x[0]] == x[0]]
    assert 0 < single.count() < good.count()

    mixed = stages["mixing"](spark, single, sf_dir)
    taken = defaultdict(int)
    for r in mixed.select("source", "text").collect():
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    planned = {r.source: r.taken for r in mixing.mix(single).join(single.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in planned.items() if n}
