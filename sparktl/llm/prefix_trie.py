"""Prefix trie of conversations: sorted shards, and a broadcast skeleton of the paths between them.

A conversation is one row: its path, the SHA-256 digests of its turns (32 bytes each) in a row, and its turns' word
counts. Paths sort as the sequences of turns do, and a node's members are neighbours in that order. A bounded sample
of conversations gives the splitters between shards, each cut off after the turn that parts it from the sampled
path before. Only prefixes of splitters can have members in two shards: these are the skeleton, a trie that is broadcast. Each
shard is sorted by path and id and walked once with a stack: a node outside the skeleton lies whole in it and
is finished there; skeleton nodes get partial sums, which are added by node. What is left, the skeleton itself, is
settled from its leaves up, and a node outside it whose parent is inside takes the parent's smallest member by a
broadcast join. Equal paths are parted by their ids, so thousands of copies are several shards too.

Defined results: rows without conv_id take no part; null roles and texts are empty; turns that tie are ordered by role
and text, and repeated rows are turns of their own; a conversation without turns is a member of the root and ends
there; an empty table has no nodes, not even the root. A remainder has the sign of its conv_id. Other columns are
not read. A conversation is one row of 32 bytes a turn in one task, however many turns it has.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import WORD, table, written

DIGEST = 32
#: Turns of a shard, conversations sampled for one, most nodes of the skeleton, and ids in one piece of a list.
SHARD, SAMPLED, SKELETON, PIECE = 200_000, 20, 500_000, 4096
GROUP, HEADS = 20, 4

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
#: kind 0: a finished node (parent_conv_id or the number of its skeleton parent); 1: sums of a skeleton node; 2: ids that end there.
PART = "kind int, node bigint, " + NODE + ", shard int, piece bigint, ids string"


def head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path binary, words array<int>) of every conversation; texts go no further than this."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("words"), F.struct(role, text).alias("_said"))
    ordered = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "_said")
    placed = turns.withColumn("place", F.row_number().over(ordered)).drop("_said", "turn")
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = placed.withColumn("digest", F.when((F.col("conv_id") == base) | (F.col("place") > head(F.col("conv_id"))), F.col("digest")))
    # every conversation has a first turn, so these are all their ids
    takers = placed.filter("place = 1").select("conv_id", base.alias("base"), head(F.col("conv_id")).alias("h")).filter("conv_id <> base AND h > 0")
    given = placed.filter((F.col("conv_id") == base) & (F.col("place") < HEADS)).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    taken = takers.join(given, "base").filter("place <= h").select("conv_id", "digest", "words", "place")
    turn = F.struct("place", "digest", "words")
    said = F.filter(F.array_sort(F.collect_list(turn)), lambda t: t["digest"].isNotNull())
    whole = own.select("conv_id", "digest", "words", "place").unionByName(taken).groupBy("conv_id").agg(said.alias("said"))
    return whole.select("conv_id", F.unhex(F.array_join(F.col("said.digest"), "")).alias("path"), F.col("said.words").alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * DIGEST] == b[: mid * DIGEST] else (low, mid - 1)
    return low


@dataclass
class Skeleton:
    """Splitters in order, and the trie of their paths; a node's number is above its parent's."""

    splitters: list[tuple[bytes, int]]
    numbers: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parents: list[int] = field(default_factory=lambda: [-1])

    @staticmethod
    def of(sample: list[tuple[bytes, int]], shards: int, most: int = SKELETON) -> Skeleton:
        sample = sorted(set(sample))
        step = max(1, len(sample) // max(1, shards))
        while True:
            out = Skeleton([])
            for k in range(step, len(sample), step):
                (path, conv), before = sample[k], sample[k - 1][0]
                out.splitters.append((path, conv) if path == before else (path[: DIGEST * (common(path, before) + 1)], -(1 << 63)))
                node = 0
                for at in range(0, len(out.splitters[-1][0]), DIGEST):
                    key = (node, path[at : at + DIGEST])
                    if key not in out.numbers:
                        out.numbers[key] = len(out.parents)
                        out.parents.append(node)
                    node = out.numbers[key]
            if len(out.parents) <= most or not out.splitters:
                return out
            step *= 2  # fewer shards, and so fewer paths to hold

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv))


@dataclass
class Open:
    """A node on the way down to the conversation at hand."""

    number: int  # in the skeleton, or -1
    depth: int
    words: int
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: hashlib._hashlib.HASH | None = None
    ids: list[int] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)  # finished children, which wait for this node's smallest member


class Walk:
    """The nodes of one shard, from its conversations in order of path and id."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.before, self.open = skeleton, shard, b"", [Open(0, 0, 0)]
        self.out: list[tuple] = []
        self.pieces = 0

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        same = common(self.before, path)
        while len(self.open) > same + 1:
            self.close()
        for depth in range(len(self.open), len(path) // DIGEST + 1):
            top = self.open[-1]
            number = -1 if top.number < 0 else self.skeleton.numbers.get((top.number, path[DIGEST * (depth - 1) : DIGEST * depth]), -1)
            self.open.append(Open(number, depth, words[depth - 1]))
        end = self.open[-1]
        end.n += 1
        end.least = conv if end.least is None else min(end.least, conv)
        if end.number < 0:
            end.ends = end.ends or hashlib.sha256()
            end.ends.update(f"{',' if end.ids else ''}{conv}".encode())
            end.ids = [conv]
        else:
            end.ids.append(conv)
            if len(end.ids) >= PIECE:
                self.piece(end)
        self.before = path

    def piece(self, node: Open) -> None:
        if node.ids:
            self.out.append((2, node.number, *[None] * 8, self.shard, self.pieces, ",".join(map(str, node.ids))))
            self.pieces += 1
            node.ids = []

    def close(self) -> None:
        node = self.open.pop()
        up = self.open[-1] if self.open else None
        if node.number >= 0:  # its sums are added to those of other shards
            self.piece(node)
            # words of its last turn go in the place of the parent's member
            self.out.append((1, node.number, node.least, node.depth, node.words, node.n, node.children, node.leaves, node.saved, None, self.shard, None, None))
        else:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.words
            for row in node.rows:
                row[4] = node.least
            self.out += map(tuple, node.rows)
            row = [0, None, node.least, node.depth, None, node.n, node.children, node.leaves, node.saved, (node.ends or hashlib.sha256()).hexdigest(), self.shard, None, None]
            if up.number >= 0:
                row[1] = up.number
                self.out.append(tuple(row))
            else:
                up.rows.append(row)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
        if up is not None:
            up.n += node.n
            if node.least is not None:
                up.least = node.least if up.least is None else min(up.least, node.least)

    def rest(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def trie(conversations: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a node, with the columns of NODE."""
    spark = conversations.sparkSession
    paths = written(rebuilt(conversations), "trie-paths")
    count, turns = paths.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not count:
        return spark.createDataFrame([], NODE)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard))
    # SAMPLED rows a shard come to the driver, the same ones whenever it is run
    sample = paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLED * shards).collect()
    skeleton = Skeleton.of([(bytes(r["path"]), r["conv_id"]) for r in sample], shards)
    held = spark.sparkContext.broadcast(skeleton)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = [held.value.shard(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where, pa.int32())], [*batch.schema.names, "shard"])

    names = [c.split(" ")[0] for c in PART.split(", ")]

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(walk: Walk) -> pa.RecordBatch:
            columns = [*zip(*walk.rest())] or [()] * len(names)
            kinds = {"kind": pa.int32(), "shard": pa.int32(), "ends_sha256": pa.string(), "ids": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns)], names)

        walk = None
        for batch in batches:
            for of, path, conv, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words"))):
                if walk is None or walk.shard != of:
                    if walk:
                        while walk.open:
                            walk.close()
                        yield rows(walk)
                    walk = Walk(held.value, of)
                walk.add(conv, path, words)
                if len(walk.out) >= 10_000:
                    yield rows(walk)
        if walk:
            while walk.open:
                walk.close()
            yield rows(walk)

    dealt = paths.mapInArrow(assign, "conv_id bigint, path binary, words array<int>, shard int")
    # shard k is partition k: no two large ones meet by the chance of a hash
    dealt = dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    parts = written(dealt.mapInArrow(walked, PART), "trie-parts")

    sums = parts.filter("kind = 1").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("words"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    # a row a skeleton node, SKELETON at most, parents first
    inner = {r["node"]: r.asDict() for r in sums.orderBy("node").collect()}
    for k, row in inner.items():
        up = inner.get(skeleton.parents[k])
        row["parent_conv_id"] = up and up["conv_id"]
        if up:
            up["n_children"] += 1
    for k in sorted(inner, reverse=True):
        row, up = inner[k], inner.get(skeleton.parents[k])
        row["n_leaves"] += not row["n_children"]
        row["saved_tokens"] += (row["n_convs"] - 1) * row["words"]
        if up:
            up["n_leaves"] += row["n_leaves"]
            up["saved_tokens"] += row["saved_tokens"]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = spark.createDataFrame([(k, *[r[c] for c in columns]) for k, r in inner.items()], "node bigint, " + ", ".join(f"{c} bigint" for c in columns))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each node's ids, piece by piece; nothing of a list is held."""
        node, sofar = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sofar.hexdigest()])], ["node", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if k != node:
                    if sofar:
                        yield row()
                    node, sofar = k, hashlib.sha256()
                    sofar.update(ids.encode())
                else:
                    sofar.update(f",{ids}".encode())
        if sofar:
            yield row()

    ends = parts.filter("kind = 2").select("node", "shard", "piece", "ids").repartition("node").sortWithinPartitions("node", "shard", "piece").mapInArrow(digested, "node bigint, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    inside = whole.join(ends, "node", "left").select(*columns, F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    ups = F.broadcast(whole.select("node", F.col("conv_id").alias("up")))
    outside = parts.filter("kind = 0").join(ups, "node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*columns, "ends_sha256")
    return outside.unionByName(inside)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    bits = "list_transform(range(8 * len(c::VARCHAR)), lambda i: (ascii(substr(c::VARCHAR, (i // 8 + 1)::INTEGER, 1)) >> (i % 8)::INTEGER) & 1)"
    return f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % {GROUP} AS base, xor(list_reduce(list_concat([4294967295::BIGINT], {bits}::BIGINT[]), lambda v, b: xor(v >> 1, 3988292384 * (xor(v, b) & 1))), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c, p, role, text FROM t JOIN h USING (c) WHERE c = base OR p > h UNION ALL SELECT h.c, p, role, text FROM h JOIN t ON t.c = base WHERE h.c <> base AND p <= h),
k AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY p) AS d, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words FROM r),
w AS (SELECT c, list(x ORDER BY d) AS path, list(words ORDER BY d) AS ws FROM k GROUP BY c),
a AS (SELECT c, coalesce(path, []) AS path, coalesce(ws, []) AS ws FROM h LEFT JOIN w USING (c)),
m AS (SELECT c, len(path) AS turns, d, path[:d] AS node, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM a)),
n AS (SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (turns = d), '')) AS ends FROM m GROUP BY node, d),
e AS (SELECT *, (SELECT count(*) FROM n y WHERE y.d = n.d + 1 AND y.node[:n.d] = n.node) AS n_children FROM n),
s AS (SELECT up.node AS node, sum(x.own)::BIGINT AS saved, count(*) FILTER (x.n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS j FROM e) x JOIN n up ON up.d = x.j AND up.node = x.node[:x.j] GROUP BY up.node)
SELECT e.conv_id, e.d::BIGINT AS depth, up.conv_id AS parent_conv_id, e.n_convs, e.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s ON s.node = e.node LEFT JOIN n up ON up.d = e.d - 1 AND up.node = e.node[:e.d - 1]"""
