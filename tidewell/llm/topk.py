"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector of n components is cut into segments.  With segment means m and
deviations s (population), ``sum(len * ((mq - mx)^2 + (sq - sx)^2))`` bounds the
squared distance of q and x from below, so

    q . x  <=  sum(len * (mq * mx + sq * sx)),

the same bound written for the inner product.  Finer segments bound it tighter.
Candidates go from the coarsest level to the finest; a level is only worked out for
the pairs that the levels before left over, only pairs whose bound still reaches the
query's k-th best score go on, and the survivors' scores are computed exactly, in
integers, those of the greatest bounds first.  A query starts with the k-th best score among some other queries, which
are candidates too.  A level that prunes less than it costs (vectors without
structure at its resolution) is left out for a while; that changes no result.

Queries travel in chunks of a bounded number of bytes; each chunk passes over the
candidates once, and each task keeps only its k best per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed

#: Bytes of query vectors that one pass broadcasts.
CHUNK_BYTES = 32 << 20
#: Segments of the levels, coarse to fine; levels finer than the vector are left out.
LEVELS = (1, 4, 16, 32)
#: Below any score.
NOTHING = -(1 << 63)
#: Pairs in a block of queries by candidates.
BLOCK_QUERIES, BLOCK_ROWS = 512, 2048
#: Candidates of the greatest bounds of a block that are worked out first.
BEST = 128
#: Blocks in which that is done; later ones start from the scores of these.
EARLY = 2
#: Below this share of pairs alive, bounds are worked out pair by pair.
SPARSE = 0.05
#: A level rests for so many blocks once it pruned less than this part of what it costs.
WORTH, REST = 0.2, 15


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component as array<long>, at most what a long holds; null if the vector can't take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that their dot product is the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    length = np.diff(cuts)
    total = np.add.reduceat(x, cuts[:-1], axis=1)
    square = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = total / length
    dev = np.sqrt(np.maximum(square / length - mean * mean, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.tile(length, 2))


class Exact:
    """Integer vectors with what exact products need: themselves, as floats, and their largest size."""

    def __init__(self, vectors: np.ndarray):
        self.whole = vectors.astype(np.int64, copy=False)
        self.floats = self.whole.astype(np.float64)
        self.most = float(np.abs(self.floats).max(initial=0.0))

    def products(self, q: np.ndarray, other: Exact, c: np.ndarray) -> np.ndarray:
        """Inner products of vectors ``q`` with the other's ``c``, pair by pair; beyond a long they are its limit."""
        out = np.empty(len(q), np.int64)
        most = self.most * other.most * self.whole.shape[1]
        for a in range(0, len(q), 16384):
            i, j = q[a : a + 16384], c[a : a + 16384]
            if most < 2**53:
                out[a : a + 16384] = np.einsum("ij,ij->i", self.floats[i], other.floats[j])
            elif most < 2**62:
                out[a : a + 16384] = np.einsum("ij,ij->i", self.whole[i], other.whole[j])
            else:
                info = np.iinfo(np.int64)
                whole = (self.whole[i].astype(object) * other.whole[j].astype(object)).sum(axis=1)
                out[a : a + 16384] = [min(max(x, info.min + 1), info.max) for x in whole]
        return out


class QueryBlock:
    """Queries of one dimension with their statistics and the best found so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS):
        self.ids, self.k = ids, k
        self.exact = Exact(vectors)
        x = self.exact.floats
        self.met = 0
        self.levels = [n for n in levels if n < x.shape[1]]
        self.stats = {n: segment_stats(x, n) for n in self.levels}
        # Pairs that each level was asked for and that it pruned, how long it is left out, and exact products.
        self.asked = dict.fromkeys(self.levels, 0)
        self.pruned = dict.fromkeys(self.levels, 0)
        self.idle = dict.fromkeys(self.levels, 0)
        self.computed = 0
        # (score, id) of the k best, as sorted pairs; missing ones are far below any score.
        self.score = np.full((len(ids), k), NOTHING)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reach = np.full(len(ids), NOTHING)
        self._seed()

    def _seed(self) -> None:
        """Start from the k-th best score among the other queries of the block; one of a pair of ids counts."""
        n = len(self.ids)
        if n <= self.k or len(np.unique(self.ids)) < n:
            return
        for a in range(0, n, 64):
            q, c = (v.ravel() for v in np.meshgrid(np.arange(a, min(n, a + 64)), np.arange(n), indexing="ij"))
            got = self.exact.products(q, self.exact, c).reshape(-1, n)
            got[np.arange(len(got)), np.arange(a, a + len(got))] = NOTHING
            self.reach[a : a + len(got)] = np.partition(got, n - self.k, axis=1)[:, n - self.k]

    def _raise(self, bound: np.ndarray, exact: Exact) -> None:
        """Work out the candidates of the greatest bounds first; their k-th best score is in reach of every query."""
        c = np.argpartition(bound, -BEST, axis=1)[:, -BEST:]
        q, at = np.nonzero(np.take_along_axis(bound, c, axis=1) >= self.reach.astype(np.float64)[:, None])
        got = np.full(c.shape, NOTHING)
        got[q, at] = self.exact.products(q, exact, c[q, at])
        self.computed += len(q)
        if self.k <= BEST:
            self.reach = np.maximum(self.reach, np.sort(got, axis=1)[:, -self.k])

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        exact = Exact(vectors)
        x = exact.floats
        self.met += 1
        self.reach = np.maximum(self.reach, self.score[:, -1])
        reach = self.reach.astype(np.float64)
        alive = self.ids[:, None] != ids[None, :]
        pairs = None  # (query, candidate) once few are left
        left = int(alive.sum())
        for n in self.levels:
            if self.idle[n]:
                self.idle[n] -= 1
                continue
            theirs = segment_stats(x, n)
            before = left
            # Rounding of the bound must not lose an equal score.
            slack = 1e-9 * (np.linalg.norm(self.stats[n], axis=1).max(initial=0.0) * np.linalg.norm(theirs, axis=1).max(initial=0.0) + 1)
            if pairs is None:
                bound = self.stats[n] @ theirs.T + slack
                if n == self.levels[-1] and len(ids) > BEST and self.met <= EARLY:
                    self._raise(np.where(alive, bound, -np.inf), exact)
                    reach = self.reach.astype(np.float64)
                alive &= bound >= reach[:, None]
                left = int(alive.sum())
                if left < SPARSE * alive.size:
                    pairs = np.nonzero(alive)
            else:
                q, c = pairs
                ok = np.einsum("ij,ij->i", self.stats[n][q], theirs[c]) + slack >= reach[q]
                pairs = q[ok], c[ok]
                left = len(pairs[0])
            self.asked[n] += before
            self.pruned[n] += before - left
            if n != self.levels[-1] and before - left < before * min(1, 2 * n / x.shape[1]) * WORTH:
                self.idle[n] = REST
        q, c = pairs if pairs is not None else np.nonzero(alive)
        if not len(q):
            return
        self.computed += len(q)
        got = self.exact.products(q, exact, c)
        ok = got >= self.reach[q]
        q, c, got = q[ok], c[ok], got[ok]
        # The best of old and new together, ties to the smaller id.
        rows = np.concatenate([np.repeat(np.arange(len(self.ids)), self.k), q])
        score = np.concatenate([self.score.ravel(), got])
        found = np.concatenate([self.found.ravel(), ids[c]])
        order = np.lexsort((found, ~score, rows))
        rows, score, found = rows[order], score[order], found[order]
        first = np.searchsorted(rows, np.arange(len(self.ids)))
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.score, self.found = (v[take].reshape(-1, self.k) for v in (score, found))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """The k best rows by integer inner product for every query row, its own left out.

    Returns ``query_id, rank, vec_id, score`` with ranks from 1, ties to the
    smaller id.  Vectors that are null or hold a null or non-finite component take
    no part, nor do rows without an id; vectors only meet vectors of their length.
    Repeated candidate rows rank as often as they occur; repeated query rows ask
    once.  A row never answers a query of its own id.  Fewer than k candidates
    give fewer ranks, an empty table none.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").select("vec_id", "v", "asks", F.size("v").alias("n"))
    asked = rows.where("asks").groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()
    parts = []
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    for dim, count in sorted((r["n"], r["rows"]) for r in asked):
        chunks = max(1, math.ceil(count * dim * 8 / chunk_bytes))
        same = rows.where(F.col("n") == dim)
        for part in range(chunks):
            wanted = same.where("asks").where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == part).groupBy("vec_id").agg(F.min("v").alias("v"))
            table = wanted.toArrow()
            if not table.num_rows:
                continue
            matrix = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            shared = spark.sparkContext.broadcast((table.column("vec_id").to_numpy(), matrix))

            def run(batches, shared=shared, dim=dim):
                ids, queries = shared.value
                blocks = [QueryBlock(ids[a : a + BLOCK_QUERIES], queries[a : a + BLOCK_QUERIES], k) for a in range(0, len(ids), BLOCK_QUERIES)]
                for batch in batches:
                    c_ids = batch.column("vec_id").to_numpy()
                    c_vec = batch.column("v").flatten().to_numpy().reshape(-1, dim)
                    for a in range(0, len(c_ids), BLOCK_ROWS):
                        for block in blocks:
                            block.meet(c_ids[a : a + BLOCK_ROWS], c_vec[a : a + BLOCK_ROWS])
                for block in blocks:
                    real = (block.score > NOTHING).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(block.ids, k)[real]), pa.array(block.found.ravel()[real]), pa.array(block.score.ravel()[real])],
                        names=["query_id", "vec_id", "score"],
                    )

            best = same.select("vec_id", "v").mapInArrow(run, schema)
            order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            parts.append(checkpointed(best) if chunks > 1 else best)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.select("query_id", "rank", "vec_id", "score")
