"""Text quality by a generalised additive model with pairwise interactions.

Shape statistics of a text (no words are learnt) go into quantile bins.  Trees of
at most four leaves are boosted on one feature at a time, in cycles, each adding
a small step to that feature's lookup table; the pairs of features that explain
most of what is left get two-dimensional tables in the same way.  A score is the
sum of table entries, one gather and one addition per table for a whole batch.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out, in_small_batches
from tidewell.llm.training import labelled_sample

#: Labelled rows that a fit uses at most.
SAMPLE_ROWS = 4000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
CYCLES, PAIR_CYCLES, RATE, LEAST_IN_LEAF, SHRINK = 150, 80, 0.1, 8, 2.0
#: A text is good from this score on.
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "distinct", "top_word", "repeated_next", "upper", "digits", "exclamations", "bars",
    "symbols", "stops", "commas", "other_marks", "lines", "line_words", "spaces", "longest_word", "distinct_letters",
)


def _marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


#: One row per counted group of bytes: capitals, digits, marks of several kinds, white space.
_GROUPS = np.stack(
    [
        _marked(bytes(range(65, 91))), _marked(b"0123456789"), _marked(b"!"), _marked(b"|"), _marked(b"#$%&*@^~<>{}[]\\_=+"),
        _marked(b".?"), _marked(b",;:"), _marked(b"\"'()/-`"), _marked(b"\n"), _marked(b" \t\r\x0b\x0c"), _marked(bytes(range(97, 123))),
    ]
)


def features(texts: list[str | None]) -> np.ndarray:
    """The feature row of each whole text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)), np.float64)
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        bytes_seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, digits, excl, bars, symbols, stops, commas, marks, lines, spaces, lower = _GROUPS @ bytes_seen
        words = text.split() if text else []
        n, size = len(words), max(1, len(raw))
        uses = Counter(words)
        letters = bytes_seen[97:123] + bytes_seen[65:91]
        out[k] = (
            math.log1p(n),
            (size - lines - spaces) / max(1, n),
            len(uses) / max(1, n),
            max(uses.values(), default=0) / max(1, n),
            sum(map(eq, words, islice(words, 1, None))) / max(1, n),
            upper / max(1.0, upper + lower),
            digits / size, excl / size, bars / size, symbols / size, stops / max(1, n), commas / max(1, n), marks / size,
            lines / max(1, n),
            math.log1p(n / (lines + 1)),
            spaces / size,
            math.log1p(max(map(len, uses), default=0)),
            float((letters > 0).sum()),
        )
    return out


@dataclass
class AdditiveModel:
    """Lookup tables of single features and of pairs, on a logistic scale."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edge, tab) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += tab[np.searchsorted(edge, x[:, j], side="right")]
        for (a, b), tab in zip(self.pairs, self.pair_tables, strict=True):
            at = [np.searchsorted(self.pair_edges[j], x[:, j], side="right") for j in (a, b)]
            total += tab[at[0], at[1]]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a histogram, or (0, -1)."""
    if len(g) < 2:
        return 0.0, -1
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
    gain[(nl < LEAST_IN_LEAF) | (nt - nl < LEAST_IN_LEAF)] = 0
    at = int(gain.argmax())
    return (float(gain[at]), at) if gain[at] > 1e-9 else (0.0, -1)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with up to three cuts."""
    parts = [(0, len(g))]
    for _ in range(3):
        cuts = [(*_best_cut(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if at < 0:
            break
        parts.remove((a, b))
        parts += [(a, a + at + 1), (a + at + 1, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of one cut along the first axis and one along the second on either side."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh, nn = (x.T if flip else x for x in (g, h, n))
        for at in range(1, gg.shape[0]):
            value, gain = np.zeros_like(gg), -(gg.sum() ** 2) / (hh.sum() + SHRINK)
            for rows in (slice(0, at), slice(at, None)):
                gs, hs, ns = gg[rows].sum(0), hh[rows].sum(0), nn[rows].sum(0)
                _, cut = _best_cut(gs, hs, ns)
                for cols in (slice(0, cut + 1), slice(cut + 1, None)):
                    if gs[cols].size:
                        gain += gs[cols].sum() ** 2 / (hs[cols].sum() + SHRINK)
                        value[rows, cols] = gs[cols].sum() / (hs[cols].sum() + SHRINK)
            if gain > best[0]:
                best = (float(gain), value.T if flip else value)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables.  Without rows of both classes the model is the share of label 1."""
    rate = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = math.log(rate / (1 - rate))
    if not 0 < y.sum() < len(y):
        return AdditiveModel(base)
    m = AdditiveModel(base, [_edges(x[:, j], BINS) for j in range(x.shape[1])])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    counts = [np.bincount(a, minlength=len(t)) for a, t in zip(at, m.tables, strict=True)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for j, tab in enumerate(m.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[j], g, len(tab)), np.bincount(at[j], h, len(tab)), counts[j])
            tab += step
            total += step[at[j]]
    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    wide = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]

    def grid(a: int, b: int, v: np.ndarray | None) -> np.ndarray:
        shape = len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1
        return np.bincount(wide[a] * shape[1] + wide[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {(a, b): _pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))[0] for a, b in combinations(range(x.shape[1]), 2)}
    m.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    m.pair_tables = [np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)) for a, b in m.pairs]
    for _ in range(PAIR_CYCLES):
        for (a, b), tab in zip(m.pairs, m.pair_tables, strict=True):
            g, h = slopes()
            _, step = _pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))
            tab += RATE * step
            total += RATE * step[wide[a], wide[b]]
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, **columns) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents outside the held-out part."""
    sample = labelled_sample(docs, labels, label, rows, **columns)
    return fit(features([t for t, _ in sample]), np.array([v for _, v in sample], float))


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; no shuffle.

    Null and empty texts are scored as texts without words.  Repeated rows score
    alike; a null id is not held out; an empty table gives an empty result.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return in_small_batches(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text reaches the threshold.

    Null and empty texts are scored as texts without words; repeated rows share one fate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(features(batch.column(at).to_pylist())) >= THRESHOLD))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
