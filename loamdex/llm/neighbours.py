"""Approximate nearest neighbours by collision-counting hashing.

A shard of vectors keeps its values on many random lines as sorted arrays. Around a query's value on each line a
window is widened step by step (virtual rehashing), and every vector counts the windows that it lies in. Once
enough vectors have collided on enough lines they are verified with exact inner products. Largest inner
product becomes smallest distance by one more coordinate that brings all vectors of a shard to equal length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = 56
#: Share of the lines on which a vector must collide, and share of a shard's distinct vectors that may then be verified.
COLLIDE, VERIFY = 0.75, 0.3
#: Half a window's first width in units of a shard's median length, and its growth from step to step.
WIDTH, GROW = 1.0, 1.2
SHARD, QUERIES = 4096, 4096
#: Cells of (shard, block of queries) for which small tables are split too.
CELLS = 64
TOP = 20


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """One shard: distinct vectors with their ids, and each line's sorted values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES):
        order = np.argsort(ids, kind="stable")
        self.vectors, group = np.unique(vectors[order], axis=0, return_inverse=True)
        by_group = np.argsort(group.reshape(-1), kind="stable")
        self.ids = ids[order][by_group]
        self.ends = np.cumsum(np.bincount(group.reshape(-1), minlength=len(self.vectors)))
        norm = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.longest = np.sqrt(norm.max())
        rest = np.sqrt(np.maximum(self.longest**2 - norm, 0.0))
        self.lines = np.random.default_rng(self.vectors.shape[1]).normal(size=(self.vectors.shape[1] + 1, lines))
        values = (np.column_stack([self.vectors, rest]) @ self.lines).T
        self.order = np.argsort(values, axis=1).astype(np.uint16 if len(self.vectors) < 1 << 16 else np.uint32)
        self.values = np.take_along_axis(values, self.order.astype(np.int64), axis=1)
        self.flat, self.base = self.order.reshape(-1), np.arange(lines) * len(self.vectors)

    def collided(self, queries: np.ndarray, enough: float) -> list[np.ndarray]:
        """For each query the vectors that lie in enough of its windows, at the first step at which enough of them do.

        A step counts only what its windows have gained since the last one: each entry of a line is met once.
        """
        n, lines = self.order.shape[1], len(self.order)
        need = int(np.ceil(COLLIDE * lines))
        counts = np.zeros((len(queries), n), np.uint8 if lines < 256 else np.uint16)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        # a query of the shard's greatest length lies where its nearest vectors do
        at = (queries * (self.longest / np.linalg.norm(queries, axis=1))[:, None]) @ self.lines[:-1]
        low = np.stack([np.searchsorted(v, a) for v, a in zip(self.values, at.T)], axis=1)
        high, half, going = low.copy(), WIDTH * self.longest, np.arange(len(queries))
        while len(going):
            lower = np.stack([np.searchsorted(v, a - half) for v, a in zip(self.values, at[going].T)], axis=1)
            upper = np.stack([np.searchsorted(v, a + half, "right") for v, a in zip(self.values, at[going].T)], axis=1)
            begin = np.concatenate([self.base + lower, self.base + high[going]], axis=1)
            size = np.concatenate([low[going] - lower, upper - high[going]], axis=1)
            low[going], high[going], half, done = lower, upper, half * GROW, []
            for k, i in enumerate(going.tolist()):
                upto = np.cumsum(size[k])
                entries = self.flat[np.arange(upto[-1]) + np.repeat(begin[k] - upto + size[k], size[k])]
                counts[i] += np.bincount(entries, minlength=n).astype(counts.dtype)
                found = np.flatnonzero(counts[i] >= need)
                if len(found) >= enough or (upper[k] - lower[k] == n).all():
                    out[i] = found
                    done.append(k)
            going = np.delete(going, done)
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, top: int):
        """Yield (query_id, ids, scores) of the nearest verified vectors, nearest first, ties to the smaller id."""
        enough = VERIFY * len(self.vectors) + top + 1
        for begin in range(0, len(queries), 256):
            part = queries[begin : begin + 256]
            for name, q, found in zip(query_ids[begin : begin + 256], part, self.collided(part, enough)):
                scores = (self.vectors[found] * q).sum(axis=1)
                # no vector below the best top + 1 distinct ones can be among the nearest ids
                if len(found) > top + 1:
                    least = np.partition(scores, len(scores) - top - 1)[len(scores) - top - 1]
                    found, scores = found[scores >= least], scores[scores >= least]
                own = [self.ids[(self.ends[g - 1] if g else 0) : self.ends[g]] for g in found]
                sizes = [len(x) for x in own]
                ids, scores = np.concatenate(own), np.repeat(scores, sizes)
                keep = ids != name
                ids, scores = ids[keep], scores[keep]
                best = np.lexsort((ids, -scores))
                # a repeated id counts with its nearest vector
                _, first = np.unique(ids[best], return_index=True)
                best = best[np.sort(first)][:top]
                yield int(name), ids[best], scores[best]


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def search(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows by inner product, in double precision.

    Both tables hold vec_id and embedding and may hold anything else. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows without a vec_id; vectors meet those of
    their own size. A row never finds its own vec_id. Rows that repeat a vec_id count once, with the nearer
    vector; a query that repeats one is searched once, with its smallest vector. Empty tables give no row.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, asked = rows.count(), queries.count()
    shards = max(1, -(-n // SHARD))
    blocks = max(1, -(-asked // QUERIES), min(-(-CELLS // shards), -(-asked // 16)))
    size = F.size("embedding").alias("size")
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    held = rows.select("vec_id", "embedding", size, shard.alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    wanted = queries.select("vec_id", "embedding", size, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), block.alias("block"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            width = left.column("size")[0].as_py()
            index = Index(left.column("vec_id").to_numpy(), _matrix(left.column("embedding"), width))
            for name, found, score in index.search(right.column("vec_id").to_numpy(), _matrix(right.column("embedding"), width), top):
                names.append(np.full(len(found), name)), ids.append(found), scores.append(score)
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table({"query_id": join(names, pa.int64()), "vec_id": join(ids, pa.int64()), "score": join(scores, pa.float64())})

    keys = ["size", "shard", "block"]
    found = held.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
