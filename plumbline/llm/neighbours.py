"""Nearest vectors by inner product: a block matrix join over int8 codes.

Candidates are dealt by a hash of vec_id into strips, each of a bounded number of bytes and one
task; the queries go to every strip, once. In a strip, candidates and queries get int8 codes with one
scale each. The product of two tiles of codes, which is exact, gives all inner products of
the tile up to a bound from the norms of what the codes leave out. A query's k-th lower bound, or
k-th exact product so far, is what a pair's upper bound has to reach; the pairs that do
are computed again in doubles, and the k best stay in a heap for each query. Heaps of all strips are
merged by query. So the result is exact: the bounds only spare exact products.

Products are sums of doubles from the first component to the last. Rows whose vec_id or
vector is null, empty, all zero or holds null or non-finite components take no part. Only
vectors of equal length are compared. A vec_id and vector that repeat count once; a vec_id
with several vectors is a candidate with each, and as a query has the smallest. Of equal vectors
only those of the k + 1 smallest vec_ids can be among the k nearest, so a strip keeps no more,
however many copies there are. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import spread
from .common import table

#: Bytes of a strip's vectors, rows of a tile's queries and candidates, pairs computed again at once.
STRIP_BYTES, QUERIES, CANDIDATES, PAIRS = 64 << 20, 256, 4096, 1 << 16


def usable(vector: Column) -> Column:
    """Whether an array of doubles can be searched."""
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, infinite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, without losing small or large ones to their squares."""
    most = np.abs(rows).max(axis=1)
    return most * np.linalg.norm(rows / np.where(most > 0, most, 1)[:, None], axis=1)


class Codes:
    """Vectors with their int8 codes, and what bounds the error of a product of codes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        scale = np.abs(rows).max(axis=1) / 127
        codes = np.rint(rows / np.where(scale > 0, scale, 1)[:, None])
        self.scale, self.codes = scale, codes.astype(np.int8)
        self.norm, self.rest = norms(rows), norms(rows - codes * scale[:, None])

    def tile(self, start: int, n: int) -> Codes:
        out = object.__new__(Codes)
        out.__dict__ = {name: v[start : start + n] for name, v in self.__dict__.items()}
        return out

    def products(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """The inner products by codes, and a bound of their error, rounding included."""
        d = self.rows.shape[1]
        exact = np.float32 if d * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are whole numbers that it holds
        near = (self.codes.astype(exact) @ other.codes.astype(exact).T) * (self.scale[:, None] * other.scale)
        rounding, least = (d + 16) * 1e-15, d * np.finfo(float).tiny
        return near, self.norm[:, None] * (other.rest + rounding * other.norm) + self.rest[:, None] * (other.norm + other.rest) + least


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def candidates(ids: np.ndarray, rows: np.ndarray, k: int) -> Codes:
    """Codes of the distinct ids and vectors; of equal vectors those of the k + 1 smallest ids."""
    rows = np.ascontiguousarray(rows + 0.0)  # one zero
    same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    i, s = ids[order], same[order]
    order = order[np.concatenate([[True], (i[1:] != i[:-1]) | (s[1:] != s[:-1])])]
    s = same[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    order = order[np.arange(len(s)) - np.repeat(first, np.diff([*first, len(s)])) <= k]
    return Codes(ids[order], rows[order])


def nearest(queries: Codes, strip: Codes, k: int) -> list[list[tuple[float, int]]]:
    """The k best (score, id) of a strip for each query, best first, smaller ids first among equal scores."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
    for start in range(0, len(strip.ids), CANDIDATES):
        tile = strip.tile(start, CANDIDATES)
        near, error = queries.products(tile)
        own = queries.ids[:, None] == tile.ids
        least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        if len(tile.ids) > k and np.isneginf(least).any():
            low = np.where(own, -np.inf, np.nan_to_num(near - error, nan=-np.inf))
            least = np.maximum(least, np.partition(low, -k, axis=1)[:, -k])
        which, what = np.nonzero(~(near + error < least[:, None]) & ~own)
        for at in range(0, len(which), PAIRS):
            i, j = which[at : at + PAIRS], what[at : at + PAIRS]
            for q, score, name in zip(i.tolist(), inner(queries.rows[i], tile.rows[j]).tolist(), tile.ids[j].tolist(), strict=True):
                entry = (score, -name)
                if len(heaps[q]) < k:
                    heapq.heappush(heaps[q], entry)
                elif entry > heaps[q][0]:
                    heapq.heapreplace(heaps[q], entry)
    return [[(score, -name) for score, name in sorted(h, reverse=True)] for h in heaps]


def found(queries: dict, strips: dict, k: int) -> Iterator[pa.RecordBatch]:
    for d, (ids, rows) in queries.items():
        if d in strips:
            asked = Codes(np.array(ids), np.array(rows))
            best = nearest(asked, strips[d], k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[i for _, i in b] for b in best], pa.list_(pa.int64())), pa.array([[s for s, _ in b] for b in best], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])


def search_strips(k: int):
    """Over rows sorted by strip, candidates first: the best of the strip for each query."""

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, vectors = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("vector")
        sizes = np.diff(vectors.offsets.to_numpy())
        flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
        for d in np.unique(sizes):
            here = np.flatnonzero(sizes == d)
            yield int(d), ids[here], flat[starts[here][:, None] + np.arange(d)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, strips, asked = None, {}, {}, {}
        for whole in batches:
            keys = whole.column("strip").to_numpy(zero_copy_only=False) * 2 + whole.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a] // 2 != now:
                    yield from found(asked, strips, k)
                    now, held, strips, asked = keys[a] // 2, {}, {}, {}
                for d, ids, rows in by_length(whole.slice(a, b - a)):
                    if keys[a] % 2 == 0:
                        held.setdefault(d, []).append((ids, rows))
                        continue
                    if held:
                        strips = {d: candidates(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) for d, parts in held.items()}
                        held = {}
                    for start in range(0, len(ids), QUERIES):
                        i, r = asked.setdefault(d, ([], []))
                        i.extend(ids[start : start + QUERIES].tolist())
                        r.extend(rows[start : start + QUERIES])
                        if len(i) >= QUERIES:
                            yield from found({d: asked.pop(d)}, strips, k)
        yield from found(asked, strips, k)

    return run


def merge(k: int):
    """Over rows sorted by query_id: the k best of all strips' lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranked(query: int, lists: list) -> list[tuple]:
            return [(query, rank, name, score + 0.0) for rank, (score, name) in enumerate(islice(heapq.merge(*lists, key=lambda x: (-x[0], x[1])), k), 1)]

        def rows() -> Iterator[tuple]:
            now, lists = None, []
            for batch in batches:
                for query, ids, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if query != now:
                        yield from ranked(now, lists)
                        now, lists = query, []
                    lists.append(list(zip(scores, ids, strict=True)))
            yield from ranked(now, lists)

        made = rows()
        while part := list(islice(made, 10000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the largest inner products for each query.

    Both tables have columns vec_id and vector. A query's own vec_id is no candidate of it.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = clean(vectors)
    size = rows.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("n")).first().n
    # two strips for each core keep it busy; what a strip holds is bounded. A fixed number of strips would let their bytes grow
    strips = max(2 * spark.sparkContext.defaultParallelism, -(-size // STRIP_BYTES))
    rows = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(strips)).cast("int").alias("strip"), F.lit(0).alias("asks"), "vec_id", "vector")
    asked = clean(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("strip"), F.lit(1).alias("asks"), "vec_id", "vector")
    parts = rows.unionByName(asked).repartitionById(strips, "strip").sortWithinPartitions("strip", "asks")
    lists = parts.mapInArrow(search_strips(k), "query_id long, ids array<long>, scores array<double>")
    return spread(lists, "query_id").sortWithinPartitions("query_id").mapInArrow(merge(k), "query_id long, rank int, vec_id long, score double")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 20, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), q AS (
  SELECT vec_id AS query_id, min(x) AS y FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id
), s AS (
  SELECT query_id, vec_id, list_inner_product(y, x) AS score FROM q JOIN v ON vec_id <> query_id AND len(x) = len(y)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
