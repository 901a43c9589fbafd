"""Quality rules: a table of thresholds compiled into one projection.

A text is measured by built-in functions only: its words, characters, symbols,
stop words, lines and repeated windows of words.  ``RULES`` names for each measure the
least and the greatest value that a good text has; ``compiled`` turns any such table into
columns of the same projection, so a text is read once and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, free_name

#: ASCII white space, between words.
SPACE = " \t\n\x0b\x0c\r"
#: Within a character class.
SYMBOLS = "#*$%&|<>"
#: Marks that open an item of a list.
BULLETS = ("-", "*", "•", "‣", "·")
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "was", "on", "are", "as", "this",
    "der", "die", "das", "und", "ist", "nicht", "von", "mit", "den", "ein", "eine", "zu", "auf", "sich", "dem", "für",
    "le", "la", "les", "et", "de", "des", "un", "une", "est", "que", "pour", "dans", "en", "du", "qui", "pas", "sur",
    "el", "los", "las", "y", "con", "del", "por", "una", "para", "no", "se", "su", "al", "lo", "es",
)
#: Words in a window whose repetition counts.
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range that it lies in for a good text; None is no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if self.measure not in MEASURES:
            raise ValueError(f"no such measure: {self.measure}")
        if self.low is None and self.high is None:
            raise ValueError(f"rule {self.name} has no bound")
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError(f"rule {self.name} allows nothing")


def _per(part: str, whole: str) -> Callable[[Callable[[str], Column]], Column]:
    """A ratio of two counts; null where the whole is 0, which no rule objects to."""
    return lambda of: F.when(of(whole) > 0, of(part).cast("double") / of(whole))


#: What a rule can measure, as columns over the counts of ``counted``.
MEASURES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "words": lambda of: of("n_words").cast("double"),
    "word_length": _per("word_chars", "n_words"),
    "symbols_per_word": _per("n_symbols", "n_words"),
    "exclamations_per_word": _per("n_exclamations", "n_words"),
    "lettered_words": _per("n_lettered", "n_words"),
    "upper_words": _per("n_upper", "n_words"),
    "stop_words": lambda of: of("n_stop_words").cast("double"),
    "stop_word_share": _per("n_stop_words", "n_words"),
    "bullet_lines": _per("n_bullet_lines", "n_lines"),
    "ellipsis_lines": _per("n_ellipsis_lines", "n_lines"),
    "duplicate_lines": _per("n_dup_lines", "n_lines"),
    "repeated_words": _per("n_repeat_words", "n_words"),
}

#: Too short, or mostly repetition: rules that hold whatever table is chosen.
BASE = (Rule("few_words", "words", low=50), Rule("repetition", "repeated_words", high=0.5))
#: The production table.
RULES = (
    Rule("word_length", "word_length", low=2.0, high=14.0),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("exclamations", "exclamations_per_word", high=0.3),
    Rule("lettered_words", "lettered_words", low=0.7),
    Rule("upper_words", "upper_words", high=0.5),
    Rule("stop_words", "stop_words", low=2),
    Rule("stop_word_share", "stop_word_share", low=0.02),
    Rule("bullet_lines", "bullet_lines", high=0.9),
    Rule("ellipsis_lines", "ellipsis_lines", high=0.3),
    Rule("duplicate_lines", "duplicate_lines", high=0.5),
)


def windows(words: Column, size: int = WINDOW) -> Column:
    """Every window of an array of words as (hash, place), sorted, so that equal windows meet.

    A window is known by a hash of 64 bits: two different windows of a text of 20,000 words
    are taken for one with a chance of about 1e-11.
    """
    heads = F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - size + 1))
    rest = lambda i: [F.get(words, i + j) for j in range(1, size)]
    return F.sort_array(F.transform(heads, lambda w, i: F.struct(F.xxhash64(w, *rest(i)).alias("h"), i.alias("at"))))


def covered(sorted_windows: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows that come twice or more, the first ones included."""
    equal = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twins = F.filter(sorted_windows, lambda x, i: equal(F.get(sorted_windows, i - 1), x) | equal(F.get(sorted_windows, i + 1), x))
    start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sort_array(F.transform(twins, lambda x: x["at"])),
        start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(size), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def counted(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """The kept columns and the counts that measures are made of, all longs.

    A null or blank text counts 0 of everything.  Words, lines and windows stand as columns of
    their own for a moment, so that each is made once.
    """
    body, words, lines, wins = (free_name(docs.select(*keep, text), c) for c in ("body", "words", "lines", "windows"))
    held = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body)).withColumns(
        {
            words: F.regexp_extract_all(F.col(body), F.lit(WORD), F.lit(0)),
            lines: F.filter(F.split(F.col(body), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        }
    )
    held = held.withColumn(wins, windows(F.col(words)))
    b, w, x = F.col(body), F.col(words), F.col(lines)
    matches = lambda pattern: F.regexp_count(b, F.lit(pattern))
    size = lambda items, test: F.size(F.filter(items, test))
    counts = {
        "n_words": F.size(w),
        "word_chars": F.char_length(b) - matches(r"[\x20\x09-\x0D]"),
        "n_symbols": matches(f"[{SYMBOLS}]"),
        "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
        "n_repeat_words": covered(F.col(wins)),
        "n_lines": F.size(x),
        "n_exclamations": F.char_length(b) - F.char_length(F.replace(b, F.lit("!"), F.lit(""))),
        "n_lettered": size(w, lambda v: F.lower(v) != F.upper(v)),
        "n_upper": size(w, lambda v: (F.upper(v) == v) & (F.lower(v) != v) & (F.char_length(v) > 1)),
        "n_stop_words": size(w, lambda v: F.lower(v).isin(*STOP_WORDS)),
        "n_bullet_lines": size(x, lambda v: F.substring(F.ltrim(v), 1, 1).isin(*BULLETS)),
        "n_ellipsis_lines": size(x, lambda v: F.btrim(v, F.lit(SPACE)).rlike("(?:\\.\\.\\.|…)$")),
    }
    return held.select(*keep, *[c.cast("long").alias(n) for n, c in counts.items()])


def breaks(rule: Rule, of: Callable[[str], Column] = F.col) -> Column:
    """Whether the counts break a rule; a measure that does not exist breaks none."""
    value = MEASURES[rule.measure](of)
    out = F.lit(False)
    if rule.low is not None:
        out |= value < F.lit(float(rule.low))
    if rule.high is not None:
        out |= value > F.lit(float(rule.high))
    return F.coalesce(out, F.lit(False))


def compiled(rules: Sequence[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """The names of the rules that the counts break, in the table's order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(breaks(r, of), F.lit(r.name)) for r in rules]))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with its counts, the rules that it breaks, and whether it is kept.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, broken`` and the further counts, one row per input row.  ``broken``
    lists base rules first.  A null text counts as empty and fails the base rule on
    words; null ids and repeated rows are rows like others.
    """
    rows = counted(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    failed = F.lit(False)
    for r in base:
        failed |= breaks(r)
    held = rows.withColumns({"base_failed": failed, "broken": F.concat(compiled(base), compiled(rules))})
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = [c for c in rows.columns if c not in first]
    return held.select(*first, (F.size("broken") == 0).alias("kept"), F.array_join("broken", ",").alias("broken"), *rest)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, text: str = "text") -> DataFrame:
    """The documents that break no rule, with all their columns."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    rows = counted(moved, list(own.values()), own[text])
    return rows.where(F.size(compiled([*base, *rules])) == 0).select(*[F.col(n).alias(c) for c, n in own.items()])
