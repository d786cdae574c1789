"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the
largest inner product is the smallest distance, and are turned by a random rotation. Lists come from
k-means on a bounded sample (SAMPLE vectors, by the smallest hashes of their ids); every vector goes to
its nearest list. A query probes as many lists as the sample itself needs for a recall of RECALL, and
takes from the sample its first answers and an upper bound of its k-th distance.

Inside a list, blocks of candidates meet blocks of queries. The rotated components come in blocks of
STEP columns: after each, a pair whose partial distance already fails the test
``partial > bound * t / D * (1 + EPSILON / sqrt(t))^2`` is abandoned. What is left is scored exactly on
the original vectors, in double precision.

Equal vectors are one class with its k + 1 smallest ids, so thousands of copies cost as much as one
vector and no list grows with them. Blocks are bounded: a list's candidates and queries are split by
hash into as many blocks as their counts ask for.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part as queries or candidates; a query with fewer than k candidates gets
all of them; ties go to the smaller id; rows that repeat an id count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import table, written

SAMPLE, LISTS, RECALL = 8192, 512, 0.985
BLOCK, CHUNK = 4096, 2048
STEP, EPSILON = 16, 2.1
SEED = 7


@dataclass
class Index:
    """What the sample gives: rotation, largest norm, rotated centroids and sample, lists to probe."""

    rotation: np.ndarray
    norm: float
    centroids: np.ndarray
    sample: np.ndarray
    vectors: np.ndarray
    ids: np.ndarray
    probes: int
    k: int

    def rotated(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def lists(self, x: np.ndarray, count: int) -> np.ndarray:
        d = distances(x, self.centroids)
        return np.argsort(d, axis=1, kind="stable")[:, :count]

    def bounds(self, q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """An upper bound of each query's k-th squared distance: its k-th in the sample, itself left out."""
        d = distances(q, self.sample)
        d[own[:, None] == self.ids[None, :]] = np.inf
        if d.shape[1] < self.k:
            return np.full(len(q), np.inf)
        return np.partition(d, self.k - 1, axis=1)[:, self.k - 1] * (1 + 1e-9) + 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def fitted(vectors: np.ndarray, ids: np.ndarray, total: int, norm: float, k: int) -> Index:
    """The index of a sample of the vectors; total: how many there are in all."""
    random = np.random.default_rng(SEED)
    dim = vectors.shape[1] + 1
    rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
    out = Index(rotation, norm, np.zeros((1, dim)), np.zeros((0, dim)), vectors, ids, 1, k)
    out.sample = out.rotated(vectors, False)
    count = int(np.clip(np.sqrt(total), 1, min(LISTS, max(1, len(ids) // 16))))
    centroids = out.sample[random.choice(len(ids), count, replace=False)]
    for _ in range(8):
        near = distances(out.sample, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, out.sample)
        n = np.bincount(near, minlength=count)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    out.centroids = centroids
    near = out.lists(out.sample, 1)[:, 0]
    trial = random.choice(len(ids), min(256, len(ids)), replace=False)
    q = out.rotated(vectors[trial], True)
    d = distances(q, out.sample)
    d[np.arange(len(trial)), trial] = np.inf
    best = np.argsort(d, axis=1)[:, : min(k, max(1, len(ids) - 1))]
    place = np.argsort(out.lists(q, count), axis=1)  # of each list in the order of probing
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    out.probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1
    return out


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector array<double>) of the rows that take part."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))


def columns(part: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = part.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scanned(index: Index, x: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons. x, q: original vectors; own: whose class is the query's."""
    rx, rq = index.rotated(x, False), index.rotated(q, True)
    dim = rx.shape[1]

    def limit(t: int, b: np.ndarray) -> np.ndarray:
        return b if t >= dim else b * (t / dim) * (1 + EPSILON / np.sqrt(t)) ** 2

    part = distances(rq[:, :STEP], rx[:, :STEP])
    i, j = np.nonzero(part <= limit(STEP, bound)[:, None])
    part = part[i, j]
    for t in range(STEP, dim, STEP):
        end = min(t + STEP, dim)
        gap = rq[i, t:end] - rx[j, t:end]
        part = part + np.einsum("ij,ij->i", gap, gap)
        stay = part <= limit(end, bound[i])
        i, j, part = i[stay], j[stay], part[stay]
    return i, j


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row of queries its k nearest rows of df, itself left out.

    queries are rows of df (same columns). Both are read more than once.
    """
    spark = df.sparkSession
    rows, asked = usable(df, id_column, vector), usable(queries, id_column, vector)
    result = "query_id bigint, rank int, id bigint, score double"
    lengths = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    rows, asked = (x.filter(F.size("vector") == lengths["length"]) for x in (rows, asked))
    # the smallest ids of each distinct vector, each once; the limit acts before the shuffle
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    smallest = rows.dropDuplicates(["vector", "id"]).withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = written(smallest.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.get("ids", F.lit(0))), "nearest-classes")
    asked = asked.select("id", "vector")
    wanted = asked.groupBy("vector").agg(F.min("id").alias("query"))

    total, norm = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))).first()
    # SAMPLE rows at most come to the driver
    sample = classes.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    index = fitted(np.array(sample["vector"].tolist(), float), sample["id"].to_numpy(), total, norm, k)
    held = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            if batch.num_rows:
                x = index.rotated(columns(batch, "vector"), False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.lists(x, 1)[:, 0].astype("<i4"))], [*batch.schema.names, "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q = index.rotated(columns(part, "vector"), True)
                own = part.column("own").to_numpy(zero_copy_only=False)
                lists, bound = index.lists(q, index.probes), index.bounds(q, own)
                n = lists.shape[1]
                repeated = part.take(pa.array(np.repeat(np.arange(len(q)), n)))
                yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(lists.ravel().astype("<i4")), pa.array(np.repeat(bound, n))], [*repeated.schema.names, "list", "bound"])

    items = written(classes.mapInArrow(assign, "vector array<double>, ids array<bigint>, id bigint, list int"), "nearest-items")
    probes = wanted.join(classes.select("vector", F.col("id").alias("own")), "vector").mapInArrow(probe, "vector array<double>, query bigint, own bigint, list int, bound double")
    probes = written(probes, "nearest-probes")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q = columns(part, "vector")
                near = distances(index.rotated(q, True), index.sample)
                n = min(k + 1, near.shape[1])
                best = np.argpartition(near, n - 1, axis=1)[:, :n]
                i, j = np.repeat(np.arange(len(q)), n), best.ravel()
                score = np.einsum("ij,ij->i", q[i], index.vectors[j])
                yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(i)), pa.array(index.ids[j]), pa.array(score)], ["query", "id", "score"])

    # the best of the sample itself, so that every query finds k rows where there are k
    seeds = wanted.mapInArrow(seed, "query bigint, id bigint, score double").join(classes.select("id", "ids"), "id")
    split = lambda frame, rows, to: frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(to))
    # one row a list, LISTS at most
    parts = F.broadcast(split(items, BLOCK, "blocks").join(split(probes, CHUNK, "chunks"), "list"))
    spread = lambda frame, key, mine, other, kept, lost: frame.join(parts, "list").withColumns(
        {kept: F.pmod(F.xxhash64(key), F.col(mine)).cast("int"), lost: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
    ).drop("blocks", "chunks")
    left = spread(items, "id", "blocks", "chunks", "block", "chunk")
    right = spread(probes, "query", "chunks", "blocks", "chunk", "block")

    def scan(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        index, out = held.value, []
        if candidates.num_rows and queries.num_rows:
            x, q = columns(candidates, "vector"), columns(queries, "vector")
            own, ids = queries.column("own").to_numpy(), candidates.column("id").to_numpy()
            query = queries.column("query").to_numpy()
            bound = queries.column("bound").to_numpy()
            for at in range(0, len(q), 256):
                mine = slice(at, at + 256)
                i, j = scanned(index, x, q[mine], own[mine], bound[mine])
                score = np.einsum("ij,ij->i", q[mine][i], x[j]) if len(i) else np.zeros(0)
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                best = rank <= k
                out.append((query[mine][i[best]], j[best], score[best]))
        query, j, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0))
        return pa.table({"query": pa.array(query, pa.int64()), "id": candidates.column("id").take(pa.array(j.astype("<i8"))), "ids": candidates.column("ids").take(pa.array(j.astype("<i8"))), "score": pa.array(score, pa.float64())})

    keys = ["list", "block", "chunk"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query bigint, id bigint, ids array<bigint>, score double")
    hits = hits.unionByName(seeds).dropDuplicates(["query", "id"])
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    found = F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))))
    top = hits.withColumn("first", first).filter(F.col("first") <= k + 1).groupBy("query").agg(F.slice(F.array_sort(found), 1, k + 1).alias("top"))
    answers = wanted.join(top, "query", "left").select("vector", "top")
    mine = F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k)
    out = asked.dropDuplicates(["id"]).join(answers, "vector").select(F.col("id").alias("query_id"), F.posexplode(mine).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0)).withColumnRenamed("id", "vec_id")
