"""Resampling documents towards a target distribution of hashed n-grams.

A bucket's gain is the logarithm of its share in the target over its share in the
corpus; a document's weight is the sum of its features' gains, and documents are
drawn by weight with Gumbel noise.  The sums are exact: the counts of a document's buckets are held as
bit planes (plane j has the buckets whose count has bit j), gains as bit planes of
their two's complement, and a weight is the sum of the common bits of every pair
of planes times their powers of two.

Features are runs of 1 to ``order`` consecutive words; words are runs of ASCII letters
(A-Z lower-cased), digits and characters beyond ASCII.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import drawn_numbers, in_small_batches, stored
from tidewell.operators.ranking import group_rank

BUCKETS, ORDER, SEED = 10_000, 3, 42
#: Of documents with so many words, so many in 100 are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Scores are whole thousandths of a natural logarithm.
SCALE = 1000
#: Bytes of the texts that are split at a time, and documents whose counts are held side by side.
SPLIT_BYTES, SIDE_BY_SIDE = 4 << 20, 256
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[0x80:] = True


def _byte_steps() -> np.ndarray:
    """The remainder that each byte leaves under the reflected CRC-32 polynomial."""
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, np.uint32(0xEDB88320) ^ (r >> 1), r >> 1).astype(np.uint32)
    return r


_STEP = _byte_steps()


def _shift_tables() -> np.ndarray:
    """What each byte of a checksum becomes when 0 to ``LONG_WORD + 1`` bytes follow: [bytes, place, value]."""
    out = np.empty((LONG_WORD + 2, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, len(out)):
        out[k] = _STEP[out[k - 1] & 255] ^ (out[k - 1] >> 8)
    return out


_SHIFT = _shift_tables()


def _followed(crc: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Checksums moved on by so many bytes each, to be combined with those bytes' own."""
    out = _SHIFT[more, 0, crc & 255]
    for k in range(1, 4):
        out ^= _SHIFT[more, k, crc >> (8 * k) & 255]
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of words, a byte of all of them at a time; long words one by one."""
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG_WORD) :]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    at, left = starts[order], sizes[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # words with more than k bytes
        crc[:n] = _STEP[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> 8)
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def features(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts end to end: the text and the bucket of every feature, and the words of every text.

    The checksum of a run comes from that of the run without its last word and the word's own.
    """
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its text
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sizes = last - first
    doc = np.searchsorted(offsets, first, "right") - 1
    words = np.bincount(doc, minlength=len(offsets) - 1)
    crc = _checksums(data, first, sizes)
    # A blank and a word behind a run.
    blank = _followed(np.full(len(crc), zlib.crc32(b" "), np.uint32), np.minimum(sizes, LONG_WORD)) ^ crc
    docs, found, run = [doc], [crc % np.uint32(buckets)], crc
    for n in range(1, order):
        tail = np.arange(n, len(crc))
        head = run[: len(tail)]
        run = _followed(head, np.minimum(sizes[tail], LONG_WORD) + 1) ^ blank[tail]
        for i in np.flatnonzero(sizes[tail] > LONG_WORD):
            run[i] = zlib.crc32(b" " + data[first[i + n] : last[i + n]].tobytes(), int(head[i]))
        whole = doc[tail] == doc[: len(tail)]
        docs.append(doc[tail][whole])
        found.append((run % np.uint32(buckets))[whole])
    return np.concatenate(docs), np.concatenate(found).astype(np.int64), words


def planes(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes of rows of numbers, packed: [bit, row, word of 64]; negative numbers as their two's complement."""
    rows, width = numbers.shape
    out = np.zeros((bits, rows, -(-width // 64)), np.uint64)
    for j in range(bits):
        packed = np.packbits((numbers >> j & 1).astype(bool), axis=1, bitorder="little")
        out[j].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def gain_planes(gains: np.ndarray) -> np.ndarray:
    """Planes of signed gains; the last one is the sign's."""
    bits = int(np.abs(gains).max(initial=0)).bit_length() + 1
    return planes(gains[None, :], bits)[:, 0]


def weights(counts: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sums of counts times gains, by common bits of planes alone; ``gains`` are planes."""
    powers = np.left_shift(np.int64(1), np.arange(len(gains), dtype=np.int64))
    powers[-1] = -powers[-1]
    most = counts.max(axis=1, initial=0)
    out = np.zeros(len(counts), np.int64)
    for j in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> j)  # smaller counts have no such bit
        plane = planes(counts[rows] >> j, 1)[0]
        common = np.stack([np.bitwise_count(plane & g).sum(axis=1, dtype=np.int64) for g in gains], axis=1)
        out[rows] += (common @ powers) << j
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = column.buffers()[2]
    return (np.frombuffer(whole, np.uint8) if whole is not None else np.zeros(0, np.uint8)), offsets


def _parts(column: pa.Array, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A binary column in parts of up to ``rows`` texts and ``SPLIT_BYTES``, one text at least."""
    data, offsets = _texts(column)
    a = 0
    while a < len(column):
        b = int(np.searchsorted(offsets, offsets[a] + SPLIT_BYTES, "right")) - 1
        b = min(max(a + 1, b), a + rows, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all documents fall into each bucket.

    A task sums up its own documents; a row per task and bucket is shuffled.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in _parts(batch.column(0), SPLIT_BYTES):
                total += np.bincount(features(data, offsets, order, buckets)[1], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["bucket", "n"])

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    parts = in_small_batches(docs).select(body.alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, in whole thousandths; a row per bucket comes to the driver."""
    held = []
    for frame in (corpus, target):
        counts = np.zeros(buckets, np.int64)
        for r in bucket_counts(frame, text, order, buckets).collect():
            counts[r.bucket] = r.n
        held.append(counts)
    (s, t), (all_s, all_t) = held, [float(int(c.sum()) + buckets) for c in held]
    return np.array([math.floor(SCALE * math.log(float(y + 1) * all_s / (float(x + 1) * all_t))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, n_features, weight``, one row per input row; a text without words weighs 0."""
    buckets, signed = len(gain), gain_planes(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for a, b, data, offsets in _parts(batch.column(1), SIDE_BY_SIDE):
                doc, bucket, words = features(data, offsets, order, buckets)
                counts = np.bincount(doc * buckets + bucket, minlength=(b - a) * buckets).reshape(b - a, buckets)
                out[:, a:b] = words, counts.sum(axis=1), weights(counts, signed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = in_small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that a seed and an id give, in whole thousandths rounded down."""
    share = (drawn_numbers(doc_id, seed)[0] + F.lit(0.5)) / F.lit(float(2**32))
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(share)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    order: int = ORDER,
    buckets: int = BUCKETS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Every document with its weight and score, and its rank if it is drawn.

    Returns ``doc_id, n_words, n_features, weight, score, rank``, one row per input row.  Of
    the N documents with ``least_words`` words or more the ``percent * N / 100`` (rounded down) with
    the highest scores are drawn, ties to the smaller id, null ids first; ``rank`` is null for all
    others.  Null texts have no words.  Repeated rows are documents of their own with one score,
    and rank one after another.  An empty target or corpus has equal shares.
    """
    gain = gains(docs, target, text, order, buckets)
    rows = weighed(docs, gain, text, doc_id, order)
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("able", F.col("n_words") >= least_words))
    able = rows.where("able").count()
    ranked = group_rank(rows, ["able"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "rank")
    drawn = F.when(F.col("able") & (F.col("rank") <= percent * able // 100), F.col("rank"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", drawn.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that are drawn, with all their columns; rows of one id go together."""
    drawn = resampled(docs, target, text=text, doc_id=doc_id, **options).where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    own = docs.select(*[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(docs.columns)])
    key = F.col(f"own_{docs.columns.index(doc_id)}").cast("long")
    return own.join(drawn, key.eqNullSafe(F.col("drawn_id")), "left_semi").select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
