"""MinHash near-duplicate groups by an LSH forest, links confirmed on full sets.

1. Every text's set of word shingles is hashed to longs with built-in functions; numpy turns each set
   into HASHES minimum hashes and a 128-bit fingerprint. Texts with equal sets become one class.
2. The forest has TREES orders. In each, a class is placed by the values of DEPTH hashes (its region)
   and, inside the region, by the next values (its path). A region of up to SMALL classes is compared
   in full. A larger one is followed deeper: neighbours along the path, which share the longest
   prefixes, and the region's hub, the class nearest to the bits that most of its classes have. Sizes and
   a one-bit sketch of the hashes leave out what cannot reach the similarity.
3. Links are confirmed on the full sets: first the closest candidate of every class and the hubs, then
   all candidates that the components found so far do not join already.
4. The exact way for large regions: where a region still holds more than one component, every class
   outside the largest one is held against all others on the full sets, in blocks. A region of one
   component has nothing left to find.

At similarity 0.8 a pair misses all of 40 trees of depth 5 about once in ten million times, and differs in
more than SKETCH of the 128 bits (12.8 are expected) about three times in a million.

Defined results: texts without words have empty sets, are linked with nothing and are kept; a text
with fewer words than a shingle is one shingle; a row without doc_id has a null component and is kept;
rows that share a doc_id are grouped by their own texts; texts are read whole, however long; no columns
but doc_id and text are read, and the stage keeps all others as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.llm.common import ascii_lower, carried, restored, table, words, written
from sparktl.llm.components import components

HASHES, TREES, DEPTH, DEEP = 128, 40, 5, 8
SMALL, NEAR = 48, 2
SIMILARITY = 80
#: Bits of 128 that may differ: 1 - (1 + 0.8) / 2 of them are expected to, with five standard deviations.
SKETCH = 30
#: Hashes of a set that cross to Python in one row.
RUN = 128
CHUNK = 1 << 15
BLOCK = 512
_random = np.random.default_rng(8191)
FACTORS = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2)) + np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
ORDERS = np.stack([_random.permutation(HASHES)[: DEPTH + DEEP] for _ in range(TREES)])


def with_shingles(docs: DataFrame, k: int) -> DataFrame:
    """docs (text and any others) with the distinct hashes of each text's k-word shingles in text's place."""
    others = [c for c in docs.columns if c != "text"]
    ws = docs.select(*others, words(ascii_lower(F.col("text"))).alias("ws"))
    n = F.size("ws")
    starts = F.slice("ws", 1, F.greatest(n - (k - 1), F.lit(0)))
    several = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(F.col("ws"), i + j) for j in range(1, k)]))
    one = F.array(F.xxhash64(F.array_join("ws", " ")))
    return ws.select(*others, F.when(n >= k, F.array_distinct(several)).when(n > 0, one).otherwise(F.array().cast("array<bigint>")).alias("shingles"))


def runs(sets: DataFrame) -> DataFrame:
    """(doc_id, h, at, shingles) from (doc_id, h, shingles): each set in runs of at most RUN hashes, in order; an empty set is one empty run.

    Arrow takes rows by the thousand, so what crosses to Python at once depends on a row's length.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("shingles") - 1, F.lit(0)), F.lit(RUN))
    return sets.select("doc_id", "h", "shingles", F.explode(starts).alias("at")).select("doc_id", "h", "at", F.slice("shingles", F.col("at") + 1, RUN).alias("shingles"))


def signed(sets: DataFrame) -> DataFrame:
    """(doc_id, h, n, f1, f2, signature) from (doc_id, h, shingles); the fingerprint does not depend on order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last set so far, which the next runs may go on with
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                at = part.column(2).to_numpy()
                heads = np.flatnonzero(np.append(True, at[1:] == 0))
                offsets = part.column(3).offsets.to_numpy()
                starts = offsets[heads] - offsets[0]
                sizes = np.diff(np.append(starts, offsets[-1] - offsets[0]))
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False).astype("<i8").view(np.uint64)
                out = np.zeros((len(sizes), HASHES), "<u4")
                prints = np.zeros((2, len(sizes)), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    at_full = starts[full]
                    mixed = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                    prints[0, full] = np.add.reduceat(flat, at_full)
                    prints[1, full] = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), at_full)
                    low = (mixed >> np.uint64(32)).astype(np.uint32)
                    # a stretch of whole sets at a time, small enough for the cache
                    cuts = np.unique(np.append(np.searchsorted(at_full, np.arange(0, len(flat), CHUNK)), len(full)))
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        end = at_full[b] if b < len(at_full) else len(flat)
                        x, begin = low[at_full[a] : end], at_full[a:b] - at_full[a]
                        for h in range(HASHES):
                            out[full[a:b], h] = np.minimum.reduceat(x * FACTORS[h] + SHIFTS[h], begin)
                if held is not None and at[0]:
                    sizes[0] += held[1]
                    prints[:, 0] += held[2]
                    out[0] = np.minimum(out[0], held[3])
                elif held is not None:
                    yield held[0]
                rows = pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(heads)), part.column(1).take(pa.array(heads)), pa.array(sizes.astype("<i4")), pa.array(prints[0].view("<i8")), pa.array(prints[1].view("<i8")), pa.array([r.tobytes() for r in out], pa.binary())],
                    ["doc_id", "h", "n", "f1", "f2", "signature"],
                )
                held = rows.slice(len(sizes) - 1), sizes[-1], prints[:, -1].copy(), out[-1].copy()
                yield rows.slice(0, len(sizes) - 1)
        if held is not None:
            yield held[0]

    return runs(sets).mapInArrow(run, "doc_id bigint, h bigint, n int, f1 bigint, f2 bigint, signature binary")


def mixed_key(values: np.ndarray, tree: int) -> np.ndarray:
    out = np.full(len(values), tree + 1, np.uint64)
    for column in values.T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view("<i8")


PLACES = "key bigint, path bigint, id bigint, n int, s1 bigint, s2 bigint"


def placed(classes: DataFrame) -> DataFrame:
    """One row for each class and tree: region key, path, and what the first filters need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
            bits = np.packbits(((values * np.uint32(2654435761)) >> np.uint32(31)).astype(np.uint8), axis=1).view("<i8")
            sketch = [pa.array(bits[:, k].copy()) for k in (0, 1)]
            for tree, order in enumerate(ORDERS):
                path = np.ascontiguousarray(values[:, order[DEPTH:]].astype(np.uint8)).view(">u8")[:, 0]
                columns = [mixed_key(values[:, order[:DEPTH]], tree), (path >> np.uint64(1)).astype("<i8")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("id"), batch.column("n"), *sketch], ["key", "path", "id", "n", "s1", "s2"])

    return classes.select("id", "n", "signature").mapInArrow(run, PLACES)


def hub(s: np.ndarray) -> int:
    """The class whose sketch is nearest to the bits that most classes have: the text that the others vary."""
    bits = np.unpackbits(s.view(np.uint8), axis=1)
    most = np.packbits((2 * bits.sum(0) >= len(bits)).astype(np.uint8)).view(np.uint64)
    return int(np.bitwise_count(s ^ most).sum(axis=1).argmin())


def candidates(places: DataFrame, percent: int) -> DataFrame:
    """(a, b, close) pairs to confirm, and (a, null, null, key) for each class of a large region.

    close is the number of sketch bits that differ, or -1 for a pair with its region's hub. Regions are
    runs of sorted rows; a run longer than CHUNK is taken in stretches that all hold its hub, so
    memory stays bounded. A region that is dealt over several tasks has a hub in each. places is read
    more than once: give it written to storage.
    """
    triangle = {m: np.triu_indices(m, 1) for m in range(2, SMALL + 1)}
    names = ["a", "b", "close", "key"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, follows = None, False

        def flush(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            """rows: key, path, id, n, s1, s2 in order; the last run may go on."""
            nonlocal held, follows
            key = rows[:, 0]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(starts[1:], len(key))
            pairs, large = [], []
            first = rows[[starts[-1]]]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                if e == len(key) and not last and e - s <= CHUNK:
                    continue
                mine, m, goes_on = rows[s:e], e - s, follows and s == 0
                sketch = np.ascontiguousarray(mine[:, 4:6]).view(np.uint64)
                if m <= SMALL and not goes_on:
                    (i, j), at = triangle[m], None
                else:
                    at = 0 if goes_on else hub(sketch)
                    others = np.delete(np.arange(m), at)
                    i = np.concatenate([np.full(m - 1, at)] + [np.arange(m - d) for d in range(1, NEAR + 1)])
                    j = np.concatenate([others] + [np.arange(d, m) for d in range(1, NEAR + 1)])
                    large.append(mine[1:] if goes_on else mine)
                    if e == len(key):
                        first = mine[[at]]
                bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype="<i8")
                n = mine[:, 3]
                fits = (bits <= SKETCH) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                if at is not None:
                    bits[: m - 1] = -1
                x, y = mine[i[fits], 2], mine[j[fits], 2]
                pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y), bits[fits]], 1))
            if pairs:
                pairs = np.unique(np.concatenate(pairs), axis=0)
                none = lambda k: pa.nulls(len(pairs), k)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype("<i4")), *map(none, kinds[3:])], names)
            for mine in large:
                none = [pa.nulls(len(mine), k) for k in kinds[1:3]]
                yield pa.RecordBatch.from_arrays([pa.array(mine[:, 2]), *none, pa.array(mine[:, 0])], names)
            tail = rows[starts[-1] :]
            if len(tail) > CHUNK:
                held, follows = first, True
            else:
                held, follows = tail, follows and starts[-1] == 0

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns], 1)
                yield from flush(rows if held is None else np.concatenate([held, rows]), False)
        if held is not None:
            yield from flush(held, True)

    # a region that holds many of the classes is dealt by ranges of its paths over as many tasks as it takes
    ordered = places.repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint, close int, key bigint")


def first_choice(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, close): every class's closest partner, and all pairs with a hub."""
    ends = pairs.select("a", "b", "close").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "close"))
    best = ends.groupBy("a").agg(F.min(F.struct("close", "b")).alias("x")).select("a", "x.b")
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return best.unionByName(pairs.filter("close = -1").select("a", "b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends the groups (id, component) do not join."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def settled(regions: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) in large regions that no candidate pair has shown, from full sets.

    Regions that hold more than one component are joined into clusters where they share a class. In a
    cluster, every class outside its largest component is held against all classes of the cluster:
    blocks of the former meet blocks of the latter, intersections are counted, and only links come out.
    """
    named = regions.select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    split = named.groupBy("key").agg(F.min("c").alias("one"), F.max("c").alias("other"), F.min("id").alias("first")).filter("one < other").select("key", "first")
    mixed = written(named.join(split, "key").select("id", "c", "first").distinct(), "minhash-mixed")
    clusters = components(mixed.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "cluster")
    members = written(mixed.select("id", "c").distinct().join(clusters, "id"), "minhash-members")
    parts = members.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("m"))
    sizes = parts.groupBy("cluster").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"))
    sizes = sizes.select("cluster", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("rows"), F.ceil(F.col("all") / BLOCK).cast("int").alias("columns"))
    full = written(members.join(sizes, "cluster").join(sets, "id"), "minhash-full")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = ["cluster", "id", "c", "shingles"]
    left = full.filter("c != main").select(*fields, mine("rows").alias("x"), each("columns").alias("y"))
    right = full.select(*[F.col(f).alias(f) for f in fields], mine("columns").alias("y"), each("rows").alias("x"))

    def meet(some: pa.Table, every: pa.Table) -> pa.Table:
        found = []
        if some.num_rows and every.num_rows:
            sets_of = lambda t: t.column("shingles").combine_chunks()
            ours, theirs = sets_of(some), sets_of(every)
            n, m = np.diff(ours.offsets.to_numpy()), np.diff(theirs.offsets.to_numpy())
            flat = ours.flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            owner, keys = np.repeat(np.arange(len(n)), n)[order], flat[order]
            ids, others = some.column("id").to_numpy(), every.column("id").to_numpy()
            c, d = some.column("c").to_numpy(), every.column("c").to_numpy()
            for at in range(0, len(m), 32):
                part = theirs.slice(at, 32)
                want, who = part.flatten().to_numpy(), np.repeat(np.arange(len(part)), m[at : at + 32])
                low = np.searchsorted(keys, want, "left")
                hits = np.searchsorted(keys, want, "right") - low
                place = np.repeat(low - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
                common = np.bincount(owner[place] * len(part) + np.repeat(who, hits), minlength=len(n) * len(part)).reshape(len(n), len(part))
                link = (100 * common >= percent * (n[:, None] + m[None, at : at + 32] - common)) & (c[:, None] != d[None, at : at + 32])
                i, j = np.nonzero(link)
                found.append(np.stack([ids[i], others[at + j]], 1))
        pairs = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), "<i8")
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    keys = ["cluster", "x", "y"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, h, n, least): every row's set size and the least (doc_id, h) of its group; h is the text's hash.

    docs is read twice: once for the signatures, once for the full sets of the classes in candidates.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    prints = written(signed(with_shingles(docs, k)), "minhash-signatures")
    filled = prints.filter("n > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "minhash-classes")
    found = written(candidates(written(placed(classes), "minhash-places"), percent), "minhash-candidates")
    pairs = written(found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.min("close").alias("close")), "minhash-pairs")
    regions = found.filter("key IS NOT NULL").select("key", F.col("a").alias("id"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(regions.select("id")).distinct()
    needed = classes.join(needed, "id").select("id", "least.*")
    sets = written(with_shingles(docs.join(needed, ["doc_id", "h"]).select("id", "text"), k).dropDuplicates(["id"]), "minhash-sets")

    links = written(confirmed(first_choice(pairs), sets, percent), "minhash-links")
    groups = components(links)
    links = written(links.unionByName(confirmed(apart(pairs, groups), sets, percent)), "minhash-links")
    groups = components(links)
    links = written(links.unionByName(settled(regions, groups, sets, percent)), "minhash-links")
    groups = components(links)
    joined = written(groups.join(classes.select("id", "least"), "id"), "minhash-groups")
    joined = joined.drop("least").join(joined.groupBy("component").agg(F.min("least").alias("of_all")), "component").select("id", "of_all")
    named = classes.join(joined, "id", "left").select("f1", "f2", "n", F.coalesce("of_all", "least").alias("least"))
    out = prints.join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", F.struct("doc_id", "h"))).alias("least"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for docs (doc_id, text); docs is read twice."""
    group = F.col("least.doc_id")
    out = grouped(docs, k, percent)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every near-duplicate group (five-word shingles) the row of the least doc_id stays.

    Rows that share a doc_id stay apart where their texts are not near copies. Of rows that repeat doc_id
    and text, one stays. Texts without words are near copies of none; rows without doc_id all stay. All columns stay as they are.
    """
    rows = written(grouped(docs.select("doc_id", "text"), 5, SIMILARITY).filter("doc_id IS NOT NULL"), "minhash-rows")
    best = (F.col("least.doc_id") == F.col("doc_id")) & F.col("least.h").eqNullSafe(F.col("h"))
    work = carried(docs, ["doc_id", "text"], without=["doc_id", "text"]).withColumn("h", F.xxhash64("text"))
    out = work.join(rows.filter(~best).select("doc_id", "h").distinct(), ["doc_id", "h"], "left_anti")
    again = rows.filter(best).groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id", "h")
    if not again.isEmpty():
        one = F.min_by(F.struct(*out.columns), F.to_json(F.struct(*out.columns)))
        repeated = out.join(again, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(one.alias("x")).select("x.*")
        out = out.join(again, ["doc_id", "h"], "left_anti").unionByName(repeated)
    return out.select(*restored(docs, doc_id=F.col("doc_id"), text=F.col("text")))


def oracle(k: int = 2, percent: int = SIMILARITY) -> str:
    shingle = "array_to_string(ws[i:i + %d], ' ')" % (k - 1)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(least(a, b)) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id)::BIGINT AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id"""
