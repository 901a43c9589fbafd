"""Best-fit-decreasing packing of token sequences into fixed windows.

Documents are tokenised where they lie.  Overlong ones are first cut into full
windows; what is left of each goes, longest first, into the open window with the
least room that still suffices.  A segment tree indexed by remaining room finds
that window in logarithmic time.  The packing runs in shards of about a fixed number
of documents; a task sorts its shards (on disk if need be) and holds the open windows
of one.  Only piece records are shuffled, never texts or ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_small_batches
from tidewell.llm.tokens import encoder, text_groups

#: Documents in a shard on average.  A shard leaves a window or two partly open.
SHARD_DOCS = 2048


class RoomTree:
    """Open windows by remaining room; finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_id: int) -> None:
        if not room:
            return
        self.open[room].append(window_id)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= need."""
        at = need + self.leaves
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


class Packing:
    """Windows of one shard, filled by pieces that come longest first."""

    def __init__(self, window: int):
        self.tree, self.window, self.windows = RoomTree(window), window, 0

    def place(self, n: int) -> tuple[int, int]:
        """Window and offset of a piece of n tokens."""
        found = self.tree.take(n) if n < self.window else None
        if found is None:
            found = self.window, self.windows
            self.windows += 1
        room, at = found
        self.tree.add(room - n, at)
        return at, self.window - room


def best_fit(lengths: Iterable[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; pieces must come longest first."""
    packing = Packing(window)
    placed = [packing.place(n) for n in lengths]
    return [w for w, _ in placed], [o for _, o in placed]


def pack(
    docs: DataFrame,
    vocab: str,
    window: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """Pack whole documents, each followed by ``end_id``, into windows.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` and, if asked for, ``ids`` (array of int).  Every id of
    a document lies in exactly one piece.  A null or empty text is its end id
    alone.  Repeated rows are packed as often as they occur; a null ``doc_id`` is
    kept; other columns are ignored; an empty table gives an empty result.
    """
    n_docs = docs.count()
    shards = max(1, math.ceil(n_docs / SHARD_DOCS))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "doc_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids

    def cut(batches):
        bpe = encoder(vocab)
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in text_groups(texts):
                out: list[list] = [[] for _ in names]
                for key, raw in zip(keys[a:b], bpe.encode(texts[a:b]), strict=True):
                    raw += end
                    n, whole = len(raw) // 4, zlib.crc32(raw)
                    for start in range(0, n, window):
                        part = raw[4 * start : 4 * (start + window)]
                        row = [key, start, len(part) // 4, zlib.crc32(part), n, whole]
                        if with_ids:
                            row.append(np.frombuffer(part, "<u4").astype(np.int32))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    more = ", ids array<int>" if with_ids else ""
    pieces = in_small_batches(src).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, doc_crc32 long" + more)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "doc_crc32", "doc_tokens"), F.lit(shards)))

    out_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def fill(batches):
        # Shards arrive one after another, longest pieces first; only a shard's open windows are held.
        held, packing = None, None
        for batch in batches:
            at, offset = [], []
            for shard, n in zip(batch.column("shard").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if shard != held:
                    held, packing = shard, Packing(window)
                w, o = packing.place(n)
                at.append(w * shards + shard)
                offset.append(o)
            found = {"sequence_id": pa.array(at, pa.int64()), "offset": pa.array(offset, pa.int64())}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in out_names], names=out_names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + more
    order = ["shard", F.col("length").desc(), "doc_id", "start", "doc_crc32", "ids_crc32"]
    return pieces.repartition("shard").sortWithinPartitions(*order).mapInArrow(fill, schema)
