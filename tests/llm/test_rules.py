"""Quality rules against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import rules

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lettered", "n_stop_words")


def plain(text):
    """The counts of one text by loops."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    places = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), len(lines),
        sum(w.lower() != w.upper() for w in words), sum(w.lower() in rules.STOP_WORDS for w in words),
    )


def texts():
    rnd = random.Random(5)
    vocabulary = ["the", "of", "Haus", "über", "été", "€", "x", "1.5", "##", "<b>", "|", "ALL", "!!", "日本", "🙂"]
    out = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "a a a", "a a a a", "same\nsame\n\nsame\r\n", "w " * 30_000]
    for _ in range(150):
        n = rnd.choice((3, 20, 80, 300))
        out.append("".join(rnd.choice(vocabulary[: rnd.choice((2, 4, 15))]) + rnd.choice((" ", "  ", "\n", "\t", "\x0b", "\xa0 ")) for _ in range(n)))
    return out


def test_counts_are_those_of_plain_loops(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COUNTS) for r in rules.judged(frame).select("doc_id", *COUNTS).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_verdicts(spark):
    prose = " ".join(f"the word{k} of house{k}" for k in range(40))
    cases = {
        prose: "",
        "short text of the kind": "few_words",
        "the of and " * 60: "repetition",
        prose + " ###" * 20: "symbols",
        prose.replace("the", "zzz").replace(" of ", " qqq "): "stop_words,stop_word_share",
        " ".join(f"THE WORD{k}X OF HOUSE{k}X" for k in range(40)): "upper_words",
        "\n".join(f"- the word{k} of it{k}" for k in range(40)): "bullet_lines",
        "\n".join(f"the word{k} of it{k}..." for k in range(40)): "ellipsis_lines",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in rules.judged(frame).collect()}
    assert [got[i].broken for i in range(len(cases))] == list(cases.values())
    assert all(r.kept == (r.broken == "") and (not r.base_failed or not r.kept) for r in got.values())


def test_a_table_of_ones_own(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "a b c d e f")], "doc_id long, text string")
    own = (rules.Rule("long", "words", high=4),)
    assert {r.doc_id: r.broken for r in rules.judged(frame, own, base=()).collect()} == {1: "", 2: "long"}
    assert rules.judged(frame, (), base=()).where("kept").count() == 2
    with pytest.raises(ValueError, match="no such measure"):
        rules.Rule("x", "beauty", low=1)
    with pytest.raises(ValueError, match="no bound"):
        rules.Rule("x", "words")
    with pytest.raises(ValueError, match="allows nothing"):
        rules.Rule("x", "words", low=2, high=1)


def test_the_projection_has_no_user_function_and_no_shuffle(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = rules.judged(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_tables_clashing_names_nulls_and_repeated_rows(spark):
    prose = " ".join(f"the word{k} of house{k}" for k in range(40))
    rows = [(1, prose), (1, prose), (None, prose), (2, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("body", "words", "lines", "windows", "n_words", "kept", "broken")})
    assert rules.judged(frame.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.kept) for r in rules.judged(frame).collect()) == [(0, True), (1, True), (1, True), (2, False)]
    kept = rules.kept_documents(frame)
    assert kept.columns == frame.columns and kept.count() == 3 and rules.kept_documents(frame.limit(0)).columns == frame.columns
