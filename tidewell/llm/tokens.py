"""Token counts and ids of whole texts under a byte-level BPE vocabulary.

The merge loop is written for numpy: all distinct pre-tokens of a batch that
have not been seen yet lie end to end in one ragged symbol array.  In each round
every sequence applies its own lowest-ranked pair, all sequences at once, and
sequences without a mergeable pair leave the array.  What survives are the
tokens.  Texts are split into pre-tokens first, and a bounded memo per Python
worker holds the ids of pre-tokens met before.

The vocabulary is a parameter (the path of a ``tokenizers`` JSON file); every
executor has the library, so only the path travels with the tasks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_small_batches

_SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Up to this code point the character classes below are those of every Unicode version in use.
_SAFE_END = 0x24F
_UNSAFE = re.compile(rf"[^\x00-{chr(_SAFE_END)}\u2010-\u2027\u2030-\u205e\u20ac]")
#: About so many bytes of new pre-tokens are merged at once, which bounds the size of the arrays.
MERGE_BYTES = 1_000_000
_NO_RANK = np.iinfo(np.int32).max


def _char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SAFE_END + 1) if unicodedata.category(chr(c))[0] == kind)


@lru_cache(1)
def _splitter() -> re.Pattern:
    """The byte-level pre-token pattern, with letters and numbers spelled out for the safe range."""
    let, num, spc = _char_class("L"), _char_class("N"), re.escape(_SPACES)
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{let}]+| ?[{num}]+| ?[^{spc}{let}{num}]+|[{spc}]+(?![^{spc}])|[{spc}]+"
    )


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    spare = iter(range(256, 512))
    out |= {chr(next(spare)): b for b in range(256) if b not in set(plain)}
    return out


class BatchBPE:
    """Encoder of one vocabulary file; see the module's text for the method."""

    def __init__(self, path: str, memo: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._path, self._library = path, None
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._bytes_of = _byte_alphabet()
        self._byte_id = np.zeros(256, np.int32)
        for ch, b in self._bytes_of.items():
            self._byte_id[b] = vocab[ch]
        self._base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self._base + vocab[b] for a, b in merges], np.int64)
        self._made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int32)
        self._special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self._special_at = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True)))) if self._special else None
        self._memo: dict[str, bytes] = {}
        self._again: set[str] = set()  # keys of the memo that were needed again
        self._memo_most = memo

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self._base + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each piece has."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        sym = self._byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(n, dtype=np.int32), lens)
        rank = np.full(len(sym), _NO_RANK)
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        done_seq, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(sym)]))
            over = lowest == _NO_RANK
            if over.any():
                done_seq.append(seq[over])
                done_sym.append(sym[over])
                keep = ~over
                sym, seq, rank, lowest = sym[keep], seq[keep], rank[keep], lowest[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == lowest)
            # In a run of one repeated symbol the pairs overlap: every second one counts, from the left.
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1)]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self._made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            # Only the pairs that a merged symbol takes part in have another rank now.
            now = hit - np.arange(len(hit))
            now = np.concatenate([now, now[now > 0] - 1])
            rank[now] = _NO_RANK
            now = now[now + 1 < len(sym)]
            now = now[seq[now] == seq[now + 1]]
            rank[now] = self._rank(sym[now], sym[now + 1])
        if not done_seq:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=n)

    def _pre_tokens(self, text: str) -> list[str]:
        if not _UNSAFE.search(text):
            return _splitter().findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        split = self._library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in split]

    def _segments(self, text: str) -> Iterator[str | int]:
        """The text between special strings, and the ids of these."""
        if self._special_at is None:
            yield text
            return
        at = 0
        for m in self._special_at.finditer(text):
            yield text[at : m.start()]
            yield self._special[m[0]]
            at = m.end()
        yield text[at:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        split: list[list] = []
        fresh: set[str] = set()
        for text in texts:
            parts = []
            for piece in self._segments(text) if text else ():
                if isinstance(piece, int):
                    parts.append(piece)
                elif piece:
                    parts.append(toks := self._pre_tokens(piece))
                    fresh.update(toks)
            split.append(parts)
        known = fresh.intersection(self._memo)
        if len(self._memo) + len(fresh) - len(known) > self._memo_most:
            # What was needed more than once since the last time stays, if it is not too much itself.
            keep = known | self._again if len(known) + len(self._again) < self._memo_most // 2 else known
            self._memo, self._again = {k: self._memo[k] for k in keep}, set()
        self._again |= known
        memo = self._memo
        new = list(fresh - known)
        if new:
            pieces = [t.encode("utf-8", "surrogatepass") for t in new]
            sizes = np.cumsum([len(p) for p in pieces])
            cuts = np.searchsorted(sizes, np.arange(MERGE_BYTES, sizes[-1], MERGE_BYTES))
            for lo, hi in pairwise(np.unique(np.r_[0, cuts, len(new)]).tolist()):
                ids, counts = self.merge(pieces[lo:hi])
                raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                for tok, a, b in zip(new[lo:hi], [0, *ends], ends, strict=False):
                    memo[tok] = raw[a:b]
        for parts in split:
            yield b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(memo.__getitem__, p)) for p in parts)


@lru_cache(2)
def encoder(path: str) -> BatchBPE:
    """One encoder per Python worker and vocabulary."""
    return BatchBPE(path)


#: Texts are encoded in groups of about so many characters, which bounds the memory of a task.
GROUP_CHARS = 2_000_000


def text_groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about GROUP_CHARS characters together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > GROUP_CHARS:
            yield start, i
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def token_counts(docs: DataFrame, vocab: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns ``doc_id, n_bytes, n_tokens, over_limit``, one row per input row:
    repeated rows stay repeated, a null or empty text has no bytes and no tokens,
    a null ``doc_id`` is kept, other columns are ignored.  ``over_limit`` tells
    whether a text has more than ``limit`` tokens.  No shuffle.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        bpe = encoder(vocab)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_tok = np.zeros(len(texts), np.int64)
            n_byte = np.zeros(len(texts), np.int64)
            for a, b in text_groups(texts):
                n_tok[a:b] = [len(x) // 4 for x in bpe.encode(texts[a:b])]
                n_byte[a:b] = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_byte), pa.array(n_tok), pa.array(n_tok > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_small_batches(src).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
