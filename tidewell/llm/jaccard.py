"""Exact n-gram Jaccard join with signature trees, and near-duplicate removal on top.

1. Every text becomes the set of its word shingles.  Texts with equal sets are
   one node from here on; copies are never expanded into pairs.
2. Nodes are brought together by banded min-hashes.  Bands are chosen from the
   threshold so that a pair exactly at the threshold meets in no band with a
   probability below ``MISS``.  A pair that meets lies in one candidate class;
   classes come from :func:`tidewell.llm.components.components`.
3. Each task puts the sets it is given under a signature tree: a node holds the
   OR of its sets' token bitmaps, their size range, their class range, and the
   largest excess of a set over its bits.  Traversing the tree against itself
   discards node pairs whose greatest possible overlap is too small.  Sets in
   leaf pairs that remain are first held against each other by bitmap, then
   counted exactly.
4. A large class is dealt out as pairs of bounded blocks, so that a group that
   holds a third of all rows is spread over many tasks, and every pair of its
   sets is still compared.

Links are decided in integers: ``100 * |A & B| >= percent * |A | B|``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed, in_small_batches, stored, word_count
from tidewell.llm.components import components
from tidewell.llm.sets import mixed, shingles

#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-9
ROWS_PER_BAND = 6
#: A class with more sets, or more shingles in them, is compared as pairs of blocks of about this many.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: With more candidate sets than this, their texts are fetched by a shuffle instead of a broadcast of their ids.
BROADCAST_IDS = 200_000
LEAF, FANOUT, BITMAP_WORDS = 16, 8, 32


def bands_for(percent: int, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands that leave a pair at the threshold apart with a probability below ``miss``."""
    together = (percent / 100) ** rows
    return 1 if together >= 1 else math.ceil(math.log(miss) / math.log1p(-together))


def band_keys(sets: np.ndarray, bands: int, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit key per band from min-hashes of a shingle set."""
    rng = np.random.default_rng(7_919)
    factors = rng.integers(1, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = np.full(bands * rows, np.iinfo(np.uint32).max, np.uint32)
    tokens = (sets >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(tokens), 2048):
        np.minimum(low, (factors[:, None] * tokens[None, a : a + 2048]).min(axis=1), out=low)
    parts = low.reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def set_hash(sets: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(sets.tobytes())


class SignatureTree:
    """Sets in class order under OR-combined bitmaps; see the module's text."""

    def __init__(self, sets: list[np.ndarray], group: np.ndarray):
        first = np.array([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((first, group))
        self.sets = [sets[i] for i in self.order]
        self.group = group[self.order]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        bits = BITMAP_WORDS * 64
        n = len(self.sets)
        flags = np.zeros((n, bits), bool)
        for i, s in enumerate(self.sets):
            flags[i, (s & np.uint64(bits - 1)).astype(np.int64)] = True
        self.bitmap = np.packbits(flags, axis=1).view(np.uint64)
        self.excess = self.size - np.bitwise_count(self.bitmap).sum(axis=1)
        level = (self.bitmap, self.size, self.size, self.excess, self.group, self.group)
        self.levels = [level := self._above(level, LEAF)]
        while len(level[1]) > 1:
            self.levels.append(level := self._above(level, FANOUT))

    @staticmethod
    def _above(level, width: int):
        at = np.arange(0, len(level[1]), width)
        ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
        return tuple(f.reduceat(x, at, axis=0) for f, x in zip(ways, level, strict=True))

    @staticmethod
    def _may_link(level, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Node pairs between which a link is possible by class, size and overlap."""
        bitmap, low, high, excess, g_low, g_high = level
        ok = (g_low[x] <= g_high[y]) & (g_low[y] <= g_high[x]) & (100 * high[x] >= percent * low[y]) & (100 * high[y] >= percent * low[x])
        k = np.flatnonzero(ok)
        for a in range(0, len(k), 65536):
            part = k[a : a + 65536]
            i, j = x[part], y[part]
            most = np.bitwise_count(bitmap[i] & bitmap[j]).sum(axis=1).astype(np.int64) + np.minimum(excess[i], excess[j])
            most = np.minimum(most, np.minimum(high[i], high[j]))
            ok[part] = (100 + percent) * most >= percent * (low[i] + low[j])
        return ok

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (x <= y) that the traversal leaves over."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            if depth < len(self.levels) - 1:
                n = len(level[1])
                steps = np.arange(FANOUT)
                cx = (x[:, None, None] * FANOUT + steps[None, :, None] + 0 * steps[None, None, :]).ravel()
                cy = (y[:, None, None] * FANOUT + steps[None, None, :] + 0 * steps[None, :, None]).ravel()
                inside = (cx < n) & (cy < n) & (cx <= cy)
                x, y = cx[inside], cy[inside]
            ok = self._may_link(level, x, y, percent)
            x, y = x[ok], y[ok]
        return x, y

    def links(self, percent: int, side: np.ndarray | None = None):
        """Yield arrays (i, j) of linked sets, as positions in the input, each pair once.

        ``side`` tells the two blocks of a class apart; sets of one block are
        then only compared in the group that pairs the block with itself.
        """
        side = None if side is None else side[self.order]
        leaf_x, leaf_y = self.leaf_pairs(percent)
        n, held = len(self.sets), -1
        for lx, ly in zip(leaf_x.tolist(), leaf_y.tolist(), strict=True):
            a, b = np.arange(lx * LEAF, min(n, lx * LEAF + LEAF)), np.arange(ly * LEAF, min(n, ly * LEAF + LEAF))
            i, j = (v.ravel() for v in np.meshgrid(a, b, indexing="ij"))
            ok = (i < j) & (self.group[i] == self.group[j])
            if side is not None:
                ok &= (side[i] < 0) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            total = self.size[i] + self.size[j]
            most = np.bitwise_count(self.bitmap[i] & self.bitmap[j]).sum(axis=1).astype(np.int64) + np.minimum(self.excess[i], self.excess[j])
            ok = (100 + percent) * np.minimum(most, np.minimum(self.size[i], self.size[j])) >= percent * total
            i, j, total = i[ok], j[ok], total[ok]
            if not len(i):
                continue
            if len(i) < 4:
                both = np.array([len(np.intersect1d(self.sets[p], self.sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)])
            else:
                if held != lx:
                    held, known = lx, np.unique(np.concatenate([self.sets[p] for p in a]))
                    left = self._incidence(known, a)
                right = self._incidence(known, b)
                # At most LEAF x LEAF counts; every count is below 2**24, where float32 is exact.
                both = (left @ right.T)[i - a[0], j - b[0]].astype(np.int64)
            ok = (100 + percent) * both >= percent * total
            if ok.any():
                yield self.order[i[ok]], self.order[j[ok]]

    def _incidence(self, known: np.ndarray, which: np.ndarray) -> np.ndarray:
        tokens = np.concatenate([self.sets[p] for p in which])
        row = np.repeat(np.arange(len(which)), self.size[which])
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        found = known[at] == tokens
        out = np.zeros((len(which), len(known)), np.float32)
        out[row[found], at[found]] = 1
        return out


class _Roots:
    """For each of n nodes the node of least rank in its component, as links come in."""

    def __init__(self, rank: np.ndarray):
        self.parent, self.rank = list(range(len(rank))), rank.tolist()

    def find(self, v: int) -> int:
        parent = self.parent
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = self.find(a), self.find(b)
            if a != b:
                a, b = (a, b) if self.rank[a] <= self.rank[b] else (b, a)
                self.parent[b] = a

    def all(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.parent))), np.int64, len(self.parent))


def signatures(docs: DataFrame, n: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_hash, bands`` of every document; no shuffle."""
    bands = bands_for(percent)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def run(batches):
        for batch in batches:
            sizes, hashes, keys, ends = [], [], [], [0]
            for t in batch.column("text"):
                s = shingles(t.as_py(), n)
                sizes.append(len(s))
                hashes.append(set_hash(s) if len(s) else None)
                if len(s):
                    keys.append(band_keys(s, bands))
                ends.append(ends[-1] + bands * bool(len(s)))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "text_hash", "n_shingles", "set_hash", "bands"],
            )

    return in_small_batches(src).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_hash string, bands array<long>")


#: Sets that small groups are compared in together, and their shingles.
TREE_SETS, TREE_SHINGLES = 2048, 4_000_000


def _compare(percent: int, n: int):
    """Compare the sets of each group of a partition; groups arrive one after another, small ones share a signature tree."""

    def links(groups: list[list[tuple]]) -> pa.RecordBatch:
        rows = [(g, *row) for g, group in enumerate(groups) for row in group]
        group, sets, node, copies, side, whole = zip(*rows, strict=True)
        node, copies = np.array(node, np.int64), np.array(copies, np.int64)
        linked = np.zeros(len(sets), np.int64)
        roots = _Roots(node)
        for i, j in SignatureTree(list(sets), np.array(group)).links(percent, np.array(side)):
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
            roots.link(i, j)
        out = linked > 0
        return pa.RecordBatch.from_pydict(
            {
                "node": pa.array(node[out], pa.int64()),
                "root": pa.array(node[roots.all()[out]], pa.int64()),
                "linked": pa.array(linked[out], pa.int64()),
                "whole": pa.array(np.array(whole)[out], pa.bool_()),
            }
        )

    def run(batches):
        ready: list[list[tuple]] = []
        held, current, seen, size, weight = None, [], set(), 0, 0
        names = ("class", "i", "j", "node", "copies", "block", "blocks", "set_hash", "text")
        for batch in batches:
            for c, i, j, node, copies, block, blocks, h, text in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if (c, i, j) != held:
                    if len(current) > 1:
                        ready.append(current)
                    else:
                        size, weight = size - len(current), weight - sum(len(row[0]) for row in current)
                    if size >= TREE_SETS or weight >= TREE_SHINGLES:
                        yield links(ready)
                        ready, size, weight = [], 0, 0
                    held, current, seen = (c, i, j), [], set()
                if node in seen:
                    continue
                s = shingles(text, n)
                # Only a text with the node's set counts, and once.
                if len(s) and set_hash(s) == h:
                    seen.add(node)
                    current.append((s, node, copies, -1 if i == j else block, blocks == 1))
                    size, weight = size + 1, weight + len(s)
        if len(current) > 1:
            ready.append(current)
        if ready:
            yield links(ready)

    return run


def _linked(docs: DataFrame, n: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """``doc_id, text_hash, n_shingles, first, n_links``, a row per document.

    ``first`` (no_id, doc_id, text_hash) is the first document of the component;
    null for documents without shingles.
    """
    signed = stored(signatures(docs, n, percent, text, doc_id))
    # A node is a distinct set, numbered once and for all by being stored.
    nodes = stored(
        signed.where("n_shingles > 0")
        .groupBy("set_hash")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n_shingles"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    meets = keyed.join(shared, "key").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    classes = checkpointed(components(meets))

    sized = classes.join(nodes.select("node", "n_shingles"), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    per_class = sized.groupBy(F.col("component").alias("class")).agg(blocks.alias("blocks"))
    members = (
        classes.withColumnRenamed("component", "class")
        .join(per_class, "class")
        .join(nodes.select("node", "first", "set_hash", "copies"), "node")
        .select("class", "blocks", "node", "first", "set_hash", "copies", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    )
    members = checkpointed(members)
    fetch = members if members.count() > BROADCAST_IDS else F.broadcast(members)
    texts = docs.select(F.col(doc_id).cast("long").alias("fetch_id"), F.xxhash64(text).alias("fetch_hash"), F.col(text).alias("text"))
    by_id = (F.col("fetch_id") == F.col("first.doc_id")) & (F.col("fetch_hash") == F.col("first.text_hash"))
    rows = texts.join(fetch, by_id)
    if not members.where("first.no_id").isEmpty():
        # Texts that no document with an id has; copies are fetched once.
        bare = texts.where("fetch_id is null").dropDuplicates(["text"])
        rows = rows.union(bare.join(fetch.where("first.no_id"), F.col("fetch_hash") == F.col("first.text_hash")))
    rows = rows.drop("fetch_id", "fetch_hash", "first").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    found = checkpointed(in_small_batches(rows.repartition("class", "i", "j").sortWithinPartitions("class", "i", "j")).mapInArrow(_compare(percent, n), "node long, root long, linked long, whole boolean"))

    links = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    final = found.where("whole").select("node", F.col("root").alias("component"))
    across = found.where("not whole").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if not across.isEmpty():
        final = final.union(components(across))
    final = checkpointed(final)
    lowest = final.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("lowest"))
    final = final.join(lowest, "component").join(links, "node").select("node", "lowest", "linked")
    ids = nodes.select("set_hash", "node", "first", "copies").join(final, "node", "left")
    ids = checkpointed(ids.select("set_hash", F.coalesce("lowest", "first").alias("first"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    # Documents without shingles have no set; they take no part in the shuffle.
    bare = signed.where("set_hash is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast(ids.schema["first"].dataType).alias("first"), F.lit(None).cast("long").alias("n_links"))
    return signed.where("set_hash is not null").join(ids, "set_hash").select("doc_id", "text_hash", "n_shingles", "first", "n_links").union(bare)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Link documents whose shingle sets have a Jaccard index of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id, n_links``, one row per input row;
    ``component_id`` is the smallest id reachable by links, the own one included,
    and ``n_links`` counts the other documents that the document links with,
    copies included.  Null, empty and blank texts have no shingles and link with
    nothing.  Documents without an id take part like all others; the component is
    null if none of its documents has an id.  Rows that share an id are told apart
    by their sets.  An empty table gives an empty result.
    """
    return _linked(docs, n, percent, text, doc_id).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def without_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Keep the document with the smallest id of every component, all columns included.

    Documents that link with nothing stay.  Those without an id come after all that
    have one.  Of rows alike in id and text one stays; rows without both an id and
    words all stay.
    """
    found = stored(_linked(docs, n, percent, text, doc_id))
    drop = found.where("n_shingles > 0 and not (doc_id <=> first.doc_id and text_hash = first.text_hash)")
    drop = checkpointed(drop.select(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")).distinct())
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    kept = docs.join(drop, docs[doc_id].cast("long").eqNullSafe(drop["dropped_id"]) & (F.xxhash64(docs[text]) == drop["dropped_hash"]), "left_anti")
    repeated = found.where("doc_id is not null or n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    bare = F.col(doc_id).isNull() & (word_count(F.col(text)) == 0)
    return kept.where(~bare).dropDuplicates([doc_id, text]).union(kept.where(bare))
