"""Exact top-k search by inner product of whole numbers: ball trees, one a shard, with branch and bound.

Each component x becomes floor(256 * x). Vectors are dealt by a hash of their id to shards of about SHARD rows and
queries to blocks of about BLOCK; a shard meets a block in one task, so neither is ever whole anywhere. A shard's
ball tree halves it along its widest axis down to leaves of LEAF rows. A node's inner product with q is at most
``q . centre + |q| radius``: from the root down, nodes below the query's current k-th score are left with all that
is under them, and the leaves that remain are scanned in descending order of that bound, the k-th score rising
on the way.

The k-th score is shared between shards too: about the square root of their number is searched first, for all
queries, and what was found there is where every other shard starts from.

Defined results: vectors that are null, hold a null or non-finite component, or one whose 256-fold is not finite,
and rows without id take no part; rows that repeat an id count once, with the least of their vectors; a shorter
vector counts as filled up with zeros, an empty one scores 0 everywhere; ties go to the smaller id; a query with
fewer than k candidates gets all of them. Scores are exact: in doubles where these hold every sum, in Python's
whole numbers elsewhere, and those beyond 64 bits are taken as the nearest long. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import table, written

SHARD, BLOCK, LEAF, SCALE = 2048, 1024, 64, 256.0
LONG = np.iinfo(np.int64)


def whole(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(256 * x) of a column of vectors as a matrix of doubles; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out


class BallTree:
    """points reordered so that every node is a slice of them; ids go along."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.spans, self.children, self.centres, self.radii = [(0, len(points))], [], [], []
        node = 0
        while node < len(self.spans):
            a, b = self.spans[node]
            own = points[order[a:b]]
            centre = own.mean(0) if b > a else np.zeros(points.shape[1])
            self.centres.append(centre)
            self.radii.append(np.sqrt(((own - centre) ** 2).sum(1).max(initial=0)))
            if b - a <= leaf:
                self.children.append(-1)
            else:
                half = (b - a) // 2
                wide = np.ptp(own, axis=0).argmax() if points.shape[1] else 0
                order[a:b] = order[a:b][np.argpartition(own[:, wide], half)] if points.shape[1] else order[a:b]
                self.children.append(len(self.spans))
                self.spans += [(a, a + half), (a + half, b)]
            node += 1
        self.points, self.ids = points[order], ids[order]
        self.centres, self.radii, self.children = np.array(self.centres), np.array(self.radii), np.array(self.children)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that the inner product of each query with a point of each node can be, with room for rounding."""
        norm, reach = np.sqrt((q * q).sum(1))[:, None], self.radii[None, :]
        most = q @ self.centres.T + norm * reach
        return most + 1e-9 * norm * (np.sqrt((self.centres**2).sum(1))[None, :] + reach) + 1e-6

    def leaves(self, bounds: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) of what the descent from the root does not leave, by query, the greatest bound first."""
        found, i, node = [], np.arange(len(bounds)), np.zeros(len(bounds), int)
        while len(i):
            stay = bounds[i, node] >= kth[i]
            i, node = i[stay], node[stay]
            end = self.children[node] < 0
            found.append((i[end], node[end]))
            i, node = np.repeat(i[~end], 2), np.column_stack([self.children[node[~end]], self.children[node[~end]] + 1]).ravel()
        i, node = (np.concatenate(c) for c in zip(*found)) if found else (i, node)
        order = np.lexsort((-bounds[i, node], i))
        return i[order], node[order]

    def scores(self, q: np.ndarray, a: int, b: int, exact: bool) -> np.ndarray:
        if exact:  # whole numbers below 2^53: no sum of doubles rounds
            return (q @ self.points[a:b].T).astype(np.int64)
        whole = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in self.points[a:b]] for u in q]
        return np.array([[min(max(s, LONG.min), LONG.max) for s in row] for row in whole], np.int64).reshape(len(q), b - a)

    def search(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best of these points at or above kth, its own id left out."""
        largest = max(np.abs(q).max(initial=0), np.abs(self.points).max(initial=0))
        exact = max(q.shape[1], 1) * largest**2 < 2.0**53
        bounds = self.bounds(q) if exact else np.full((len(q), len(self.spans)), np.inf)
        kth = kth.astype(np.int64)
        i, node = self.leaves(bounds, kth)
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin, count = 0, 1
        while begin <= rank.max(initial=-1):
            now = np.flatnonzero((rank >= begin) & (rank < begin + count) & (bounds[i, node] >= kth[i]))
            now = now[np.argsort(node[now], kind="stable")]
            found = [best]
            for part in np.split(now, np.flatnonzero(np.diff(node[now])) + 1):
                if len(part):
                    mine, (a, b) = i[part], self.spans[node[part[0]]]
                    score = self.scores(q[mine], a, b, exact)
                    x, y = np.nonzero((score >= kth[mine, None]) & (self.ids[None, a:b] != own[mine, None]))
                    found.append((mine[x], self.ids[a:b][y], score[x, y]))
            best = ranked(*(np.concatenate(c) for c in zip(*found)), k)
            place = np.arange(len(best[0])) - np.searchsorted(best[0], best[0])
            full = place == k - 1
            kth[best[0][full]] = np.maximum(kth[best[0][full]], best[2][full])
            begin, count = begin + count, 2 * count
        return best


def ranked(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, the highest first, ties by id."""
    order = np.lexsort((ids, ~score, query))  # ~x falls as x grows, over the whole range of a long
    query, ids, score = query[order], ids[order], score[order]
    stay = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[stay], ids[stay], score[stay]


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id."""
    x = F.col("vector")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(SCALE)) < float("inf"))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & F.forall(x, finite)).groupBy("id").agg(F.min("vector").alias("vector"))


def dealt(id_column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int")


def top_products(df: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): for each row of queries the k rows of df with the highest products, its own id left out."""
    items, asked = written(usable(df, id_column, vector), "ball-items"), written(usable(queries, id_column, vector), "ball-queries")
    shards, blocks = (max(1, -(-frame.count() // rows)) for frame, rows in ((items, shard), (asked, block)))
    items, asked = items.withColumn("shard", dealt("id", shards)), asked.withColumn("block", dealt("id", blocks))

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        best = [np.zeros(0, np.int64)] * 3
        if candidates.num_rows and wanted.num_rows:
            x, q = whole(candidates.column("vector")), whole(wanted.column("vector"))
            dim = max(x.shape[1], q.shape[1])
            x, q = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (x, q))
            own, kth = wanted.column("id").to_numpy(), wanted.column("kth").to_numpy()
            i, ids, score = BallTree(x, candidates.column("id").to_numpy()).search(q, own, kth, k)
            best = [own[i], ids, score]
        return pa.table(dict(zip(("query", "id", "score"), map(pa.array, best))))

    schema, keys = "query bigint, id bigint, score bigint", ["shard", "block"]
    found, first = None, min(shards, int(np.ceil(np.sqrt(shards))))
    for low, high in ((0, first), (first, shards)):
        if low == high:
            continue
        ready = asked.withColumn("kth", F.lit(int(LONG.min)))
        if found is not None:
            scores = found.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("reached"))
            ready = asked.join(scores.withColumnRenamed("query", "id"), "id", "left").withColumn("kth", F.coalesce("reached", F.lit(int(LONG.min)))).drop("reached")
        left = items.filter(F.col("shard").between(low, high - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = ready.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)
        hits = hits if found is None else hits.unionByName(found.select("query", "id", "score"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        found = written(hits.withColumn("rank", place).filter(F.col("rank") <= k), "ball-found")
    return found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).withColumnRenamed("id", "vec_id")


def oracle() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""
