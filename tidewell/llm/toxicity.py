"""Toxicity by a subsequence string kernel SVM over Nystroem landmarks.

The kernel is the gap-weighted subsequence kernel: it sums over all common
subsequences of a fixed order, each discounted by ``decay`` for every character
it spans.  A word with inserted characters or a new ending keeps most of its
likeness to the insult it stems from.

* Landmarks come from the labelled sample: the strings whose words are
  over-represented in toxic documents beyond chance, each taken for the documents
  it newly covers, and a few ordinary words.
* A sentence is mapped to its words' greatest kernel value with each landmark,
  and from there through the inverse square root of the landmarks' kernel matrix
  (the Nystroem map).  A word takes part where its longest common subsequence
  with a landmark covers ``overlap`` of it; bit-parallel arithmetic finds these
  words for all landmarks at once.
* A linear SVM (squared hinge) is trained on sentences.  Only documents carry
  labels, so a toxic document speaks through the sentences that hold a landmark
  and its most toxic one, chosen anew after each fit.  Copies of the toxic documents with
  a letter inserted into each insult are learnt as well, so that altered insults count.  A document's score is logistic in its worst sentence, in the
  sum of all, and in that sum by length.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held_out, in_small_batches
from tidewell.llm.tokens import text_groups
from tidewell.llm.training import labelled_sample

#: Labelled rows that a fit uses at most.
SAMPLE_ROWS = 4000
#: A word's likeness to a landmark is raised to SHARPNESS.
ORDER, DECAY, OVERLAP, SHARPNESS = 3, 0.5, 0.75, 1.5
#: What a copy of a toxic document with altered insults weighs beside a document as it is, and the seed of the alterations.
ALTERED_WEIGHT, ALTERED_SEED = 0.25, 7
LANDMARKS, ORDINARY = 32, 8
#: Longer tokens are looked at through windows of this width.
WINDOW = 24
#: A landmark's over-representation must be this unlikely by chance, in nats.
EVIDENCE = 14.0
#: Occurrences in clean documents that a landmark may have, against those in toxic ones, and its longest length.
CLEAN_SHARES, MARK_MOST = (0.005, 0.35), 11
#: Share of the toxic documents that a landmark must newly cover, so that a copied passage makes none.
COVER_SHARE = 0.015
#: A sentence without an end is cut after so many words.
SENTENCE_WORDS = 30
_SPELLED = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
#: Marks inside a word, as in ``i.d.i.o.t``.
_INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
_MEMO_MOST = 150_000
#: Stands before every word, so that a landmark can say where a word begins.
START = "^"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without marks inside; runs of single characters such as ``i d i o t`` are joined to one."""
    return _SPELLED.sub(lambda m: re.sub(r"\s", "", m[0]), _INNER.sub("", text.lower())).split() if text else []


def altered(text: str, marks: list[str], rnd: random.Random) -> str:
    """A text with a letter put into every word that has a landmark, somewhere inside that landmark."""
    out = []
    for w in words_of(text):
        hit = next((z for z in marks if z in START + w), None)
        if hit:
            first = max(0, (START + w).index(hit) - 1)
            at = first + rnd.randrange(1, max(2, len(hit.removeprefix(START))))
            w = w[:at] + rnd.choice(ascii_lowercase) + w[at:]
        out.append(w)
    return " ".join(out)


def _windows(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Words, marked at their start, cut to windows, and the word each window is of."""
    out = [START + w for w in words]
    of = np.arange(len(out))
    long = [k for k, w in enumerate(out) if len(w) > WINDOW]
    if long:
        cuts = [(k, out[k][a : a + WINDOW]) for k in long for a in range(0, max(1, len(out[k]) - WINDOW // 2), WINDOW // 2)]
        short = np.delete(of, long)
        out = [out[k] for k in short.tolist()] + [c for _, c in cuts]
        of = np.r_[short, [k for k, _ in cuts]]
    return out, of


class LandmarkKernel:
    """Kernel values of words with a fixed list of landmark strings."""

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY, overlap: float = OVERLAP):
        self.landmarks, self.order, self.decay = landmarks, order, decay
        chars = sorted({c for z in landmarks for c in z})
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.longest = max(map(len, landmarks), default=1)
        self.z = np.zeros((len(landmarks), self.longest), np.int16)
        self.masks = np.zeros((len(chars) + 1, len(landmarks)), np.uint16)
        for j, z in enumerate(landmarks):
            self.z[j, : len(z)] = [self.code[c] for c in z]
            for i, c in enumerate(z):
                self.masks[self.code[c], j] |= np.uint16(1 << i)
        self.lengths = np.array([len(z) for z in landmarks])
        self.need = np.array([max(order, math.ceil(overlap * len(z))) for z in landmarks])
        self.own = np.maximum(self._kernel(self.z, self.z), 1e-12) if landmarks else np.zeros(0)

    def codes(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), max(map(len, words), default=1) or 1), np.int16)
        table = np.zeros(0x110000, np.int16)
        for c, k in self.code.items():
            table[ord(c)] = k
        flat = table[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        lens = np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(len(words)), lens)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        return out

    def _kernel(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Subsequence kernels of paired rows; code 0 matches nothing."""
        a, b, lam = s.shape[1], t.shape[1], self.decay
        match = lam * lam * ((s.T[:, :, None] == t[None]) & (s.T[:, :, None] > 0))
        # Discounts of the gaps along t; those along s are added up row by row.
        gaps = np.triu(lam ** np.maximum(np.arange(b)[None] - np.arange(b)[:, None], 0.0))
        found = match
        for _ in range(1, self.order):
            ends = (found.reshape(-1, b) @ gaps).reshape(found.shape)
            for i in range(1, a):
                ends[i] += lam * ends[i - 1]
            found = np.zeros_like(match)
            np.multiply(match[1:, :, 1:], ends[:-1, :, :-1], out=found[1:, :, 1:])
        return found.sum(axis=(0, 2))

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse kernel values over the landmark's value with itself: word, landmark, value.

        Repeated matches count up to the share of the landmark that the longest
        common subsequence covers.
        """
        if not words or not self.landmarks:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        cut, of = _windows(words)
        order = np.argsort(np.fromiter(map(len, cut), np.int64, len(cut)), kind="stable")
        out = []
        for at in range(0, len(order), 4_000):
            part = order[at : at + 4_000]
            code = self.codes([cut[i] for i in part])
            # Bit-parallel longest common subsequence of each word with every landmark.
            v = np.full((len(part), len(self.landmarks)), np.uint16(0xFFFF))
            for t in range(code.shape[1]):
                u = v & self.masks[code[:, t]]
                v = (v + u) | (v - u)
            common = np.bitwise_count(~v)
            w, z = np.nonzero(common >= self.need)
            shortest = np.argsort(self.lengths[z], kind="stable")
            w, z = w[shortest], z[shortest]
            covered = common[w, z] / self.lengths[z]
            for a in range(0, len(w), 1024):
                wi, zi = w[a : a + 1024], z[a : a + 1024]
                like = self._kernel(code[wi], self.z[zi, : self.lengths[zi[-1]]]) / self.own[zi]
                out.append((of[part[wi]], zi, np.minimum(like, covered[a : a + 1024])))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class ToxicityModel:
    """Landmarks with their weights, and the scale of a document's evidence."""

    kernel: LandmarkKernel
    weights: np.ndarray  # of raw kernel values: the Nystroem map folded into the SVM's weights
    bias: float
    scale: np.ndarray  # logistic weights of a document's evidence, the constant last

    def __post_init__(self):
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo", "_rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        """Start with no words: ``_memo`` has twice a word's row in ``_rows``, and 1 more if it ends a sentence; row 0 is empty."""
        self._memo: dict[str, int] = {}
        self._rows = np.zeros((1, len(self.kernel.landmarks)))

    def learn_words(self, fresh: set[str]) -> None:
        """Add the kernel rows of words not met before; most have none."""
        new = [w for w in fresh if w not in self._memo]
        if len(self._memo) + len(new) > _MEMO_MOST:
            self._forget()
            new = list(fresh)
        word, mark, value = self.kernel.values(new)
        marked, at = np.unique(word, return_inverse=True)
        rows = np.zeros((len(marked), self._rows.shape[1]))
        np.maximum.at(rows, (at, mark), value**SHARPNESS)
        place = np.zeros(len(new), np.int64)
        place[marked] = 2 * (len(self._rows) + np.arange(len(marked)))
        self._rows = np.vstack([self._rows, rows])
        place += np.fromiter((w[-1] in ".!?" for w in new), bool, len(new))
        self._memo.update(zip(new, place.tolist(), strict=True))

    def features(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's sentences in which a word takes part, as kernel maxima, and its number of words.

        A text without such a sentence has one empty row.
        """
        found = [self._sentences(texts[a:b]) for a, b in text_groups(texts)]
        return [bag for bags, _ in found for bag in bags], np.concatenate([sizes for _, sizes in found] or [np.zeros(0)])

    def _sentences(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """The same of a few texts, whose words are held all at once."""
        tokens = [words_of(t) for t in texts]
        self.learn_words(set().union(*tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        code = np.fromiter(map(self._memo.__getitem__, chain.from_iterable(tokens)), np.int64, sizes.sum())
        first = np.zeros(len(code), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        first[1:] |= code[:-1] % 2 == 1
        at = np.flatnonzero(code > 1)
        began = np.maximum.accumulate(np.where(first, np.arange(len(code)), 0))[at]
        new = np.r_[True, began[1:] != began[:-1]][: len(at)]
        # Sentences without an end are cut where a word that takes part stands too far from their start.
        sentence, start = -1, 0
        for k in np.flatnonzero(at - began >= SENTENCE_WORDS).tolist():
            if began[k] != sentence or at[k] - start >= SENTENCE_WORDS:
                sentence, start, new[k] = began[k], at[k], True
        heads = np.flatnonzero(new)
        maxima = np.maximum.reduceat(self._rows[code[at] // 2], heads) if len(heads) else self._rows[:0]
        per_text = np.bincount(np.repeat(np.arange(len(tokens)), sizes)[at[heads]], minlength=len(tokens))
        bags = np.split(maxima, np.cumsum(per_text)[:-1])
        return [b if len(b) else self._rows[:1] for b in bags], sizes.astype(float)

    def evidence(self, bags: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        """Of each text: the worst sentence, all sentences together, these by length, and 1."""
        out = np.ones((len(bags), 4))
        for k, b in enumerate(bags):
            v = b @ self.weights
            out[k, 0], total = v.max() + self.bias, np.maximum(v, 0).sum()
            out[k, 1], out[k, 2] = math.log1p(total), math.log1p(100 * total / (100 + words[k]))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.evidence(*self.features(texts)) @ self.scale, -50, 50)))


def choose_landmarks(sample: list[tuple[str, int]], most: int = LANDMARKS) -> list[str]:
    """Strings that mark toxic documents, then some ordinary words."""
    bags = [({START + w for w in words_of(t)}, y) for t, y in sample]
    share = max(1e-6, sum(len(b) for b, y in bags if y) / max(1, sum(len(b) for b, _ in bags)))

    def grams(w: str, k: int) -> set[str]:
        return {w[a : a + k] for a in range(len(w) - k + 1)}

    def evidence(t: int, c: int) -> float:
        p = t / (t + c)
        return 0.0 if p <= share else t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0)

    toxic, clean = [b for b, y in bags if y], [b for b, y in bags if not y]

    def counted(strings) -> tuple[Counter, Counter]:
        """Occurrences in toxic documents, where they can be enough to stand out, and in clean ones."""
        t = Counter(g for bag in toxic for w in bag for g in strings(w))
        t = Counter({g: n for g, n in t.items() if n * math.log(1 / share) >= EVIDENCE})
        return t, Counter(g for bag in clean for w in bag for g in strings(w) if g in t)

    # Strings of four characters first; longer ones only where such a string stands out.
    t4, c4 = counted(lambda w: grams(w, 4))
    base = {g for g, t in t4.items() if c4[g] <= 3 * t and evidence(t, c4[g]) >= EVIDENCE}

    def around(w: str) -> set[str]:
        """The substrings of a word that hold a string that stands out."""
        out = set()
        for i in (i for i in range(len(w) - 3) if w[i : i + 4] in base):
            out.update(w[a:b] for a in range(max(0, i + 4 - MARK_MOST), i + 1) for b in range(i + 4, min(len(w), a + MARK_MOST) + 1))
        return out

    t_all, c_all = counted(around)
    good = {g for g, t in t_all.items() if c_all[g] <= max(CLEAN_SHARES) * t and evidence(t, c_all[g]) >= EVIDENCE}
    covers: dict[str, set[int]] = {g: set() for g in good}
    inside: dict[str, set[str]] = {g: set() for g in good}
    for d, bag in enumerate(toxic):
        for w in bag:
            for g in around(w) & good:
                covers[g].add(d)
                inside[g].add(w)
    # Each document has to be covered several times: insults rarely come alone, and held-out ones vary.
    left = Counter(dict.fromkeys(range(len(toxic)), 4))
    least = max(3, math.ceil(COVER_SHARE * len(left)))
    chosen: list[str] = []
    # Strings that clean documents hardly use first, then those that they use less.
    for share_limit in CLEAN_SHARES:
        pool = {g: ds for g, ds in covers.items() if c_all[g] <= share_limit * t_all[g]}
        while pool and len(chosen) < most:
            gain = {g: sum(1 for d in ds if left[d] > 0) for g, ds in pool.items()}
            best = max(pool, key=lambda g: (gain[g], len(g), g))
            if gain[best] < least:
                break
            # The longest string that says almost the same is the most specific.
            best = max((g for g in pool if best in g and gain[g] >= 0.85 * gain[best]), key=lambda g: (len(g), gain[g], g))
            chosen.append(best)
            for d in covers[best]:
                left[d] -= 1
            pool, covers = ({g: ds for g, ds in x.items() if len(inside[g] & inside[best]) < 0.5 * len(inside[g])} for x in (pool, covers))
    ordinary = Counter(w for bag in clean for w in bag if 5 <= len(w) <= MARK_MOST)
    plain = sorted(ordinary, key=lambda w: (-ordinary[w], w))
    return chosen + plain[:ORDINARY] if chosen else []


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """A linear SVM in the primal by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        inside = 1 - y * (x @ w) > 0
        xi, ci = x[inside], weight[inside]
        hess = (xi * ci[:, None]).T @ xi + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, (xi * ci[:, None]).T @ y[inside]) - w
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> ToxicityModel:
    """Train on labelled texts.  With one class or no landmark, every score is the share of label 1."""
    y = np.array([v for _, v in sample], float)
    marks = choose_landmarks(sample) if 0 < y.sum() < len(y) else []
    if not marks:
        rate = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return ToxicityModel(LandmarkKernel([]), np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, math.log(rate / (1 - rate))]))
    kernel = LandmarkKernel(marks)
    model = ToxicityModel(kernel, np.zeros(len(marks)), 0.0, np.zeros(4))
    rnd = random.Random(ALTERED_SEED)
    copies = [altered(t, marks[: max(1, len(marks) - ORDINARY)], rnd) for t, v in sample if v]
    bags, words = model.features([*[t for t, _ in sample], *copies])
    count = np.r_[np.ones(len(y)), np.full(len(copies), ALTERED_WEIGHT)]
    y = np.r_[y, np.ones(len(copies))]
    gram = np.zeros((len(marks), len(marks)))
    word, mark, value = LandmarkKernel(marks, overlap=0).values([z.removeprefix(START) for z in marks])
    np.maximum.at(gram, (word, mark), (value * np.sqrt(kernel.own[mark] / kernel.own[word])) ** SHARPNESS)
    gram = (gram + gram.T) / 2
    vals, vecs = np.linalg.eigh(gram)
    root = vecs @ np.diag(np.where(vals > 1e-6, 1 / np.sqrt(np.maximum(vals, 1e-6)), 0)) @ vecs.T
    n_toxic = max(1, len(marks) - ORDINARY)
    toxic, clean = [b for b, v in zip(bags, y, strict=True) if v], [b for b, v in zip(bags, y, strict=True) if not v]
    negatives = np.unique(np.vstack(clean).round(6), axis=0)
    strong = [b[b[:, :n_toxic].max(axis=1) >= 0.9] for b in toxic]
    pick = [b[b[:, :n_toxic].max(axis=1).argmax()] for b in toxic]
    for _ in range(4):
        positives = np.vstack([*strong, np.array(pick)])
        x = np.vstack([positives, negatives]) @ root
        side = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        cost = np.r_[np.full(len(positives), 1 / len(positives)), np.full(len(negatives), 1 / len(negatives))] * 100
        w = _squared_hinge(x, side, cost)
        model.weights, model.bias = root @ w[:-1], float(w[-1])
        pick = [b[(b @ model.weights).argmax()] for b in toxic]
    model.scale = _logistic(model.evidence(bags, words), y, count)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression of weighted rows by damped Newton steps; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.r_[np.full(len(w) - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (count * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        step = np.clip(np.linalg.solve(hess, x.T @ (count * (y - p)) - shrink * w), -2, 2)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; no shuffle.

    Null, empty and blank texts get the score of a text without any word that
    resembles a landmark.  Repeated rows score alike; a null id is not held out;
    an empty table gives an empty result.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        mine = shared.value
        for batch in batches:
            s = mine.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return in_small_batches(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, **columns) -> ToxicityModel:
    """Fit on at most ``rows`` labelled documents outside the held-out part."""
    return fit(labelled_sample(docs, labels, label, rows, **columns))


def without_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below one half.

    Null and empty texts are scored as texts without words; repeated rows share one fate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))

    def run(batches):
        mine = shared.value
        for batch in batches:
            yield batch.filter(pa.array(mine.scores(batch.column(at).to_pylist()) < 0.5))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
