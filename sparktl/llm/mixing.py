"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

A source's expected copies of each document are target / size of the source. Documents of a source
stand in one order; their expected copies are prefix-summed, one random offset is added, and a
document is emitted once for each integer that its step crosses.

A document of more than 1 / LARGE of its source's words would carry the sum far past its target or leave
it far short. Such documents (fewer than LARGE a source) expect a whole number of copies each, which they
get whatever the offset: largest first, the whole number next to their step that brings the words taken
nearest to what is due. The others share what is left of the target evenly.

The order goes through buckets of about the root of the source's documents (64 at least; an even number
of buckets) by a hash of doc_id and size, and in a bucket by size, up and down in turn: every stretch of
it holds all sizes and what the offset adds in one bucket the next one takes off, so the words taken come
near the target. Ranks come from counts by (source, bucket) and a row number inside a bucket, so no task
sees a whole source.

Targets: sources in code point order, null last, have the weights in turn; they share ``share`` of all
words, none above ``most`` times its own words; the excess goes to the others by weight. That level is
the largest of the levels in the order of size by weight, one window over one row a source.

Defined results: null text has size 0; a source without words has target 0 and nothing is taken; null
sources are one source; repeated rows are separate documents; texts of any length count whole; columns
of the input that clash with a result of ``mix`` are replaced there, all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import carried, quoted, restored, table, words, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240229
LEAST_BUCKET = 64
#: A document of more than 1 / LARGE of its source's words is settled on its own.
LARGE, DOMINANT = 64, -1
#: Up to so many sources their table is broadcast; beyond it, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _hash(column: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(column), 1, digits), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row a source: source_key, source_size, target, step (expected copies), offset, buckets."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1)
    every, so_far = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = sources.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    level = (F.sum("source_size").over(every) * F.lit(share) - F.lit(most) * F.coalesce(F.sum("source_size").over(so_far), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))
    )
    out = out.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("level") * F.col("weight"), (F.col("source_size") * most).cast("double"))
    key = source_key(F.col("source"))
    return out.select(
        key.alias("source_key"), "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("step"),
        (_hash(F.concat_ws("|", F.lit(str(seed)), key), 13) / F.lit(2.0**52)).alias("offset"),
        (F.ceil(F.col("n") / (F.greatest(F.lit(LEAST_BUCKET), F.floor(F.sqrt(F.col("n").cast("double")))) * 2)) * 2).cast("long").alias("buckets"),
    )


def _marked(rows: DataFrame, goals: DataFrame, small: bool) -> DataFrame:
    """rows (doc_id, source, size and others) with their source's goals and their bucket, DOMINANT for large documents."""
    out = rows.withColumn("source_key", source_key(F.col("source"))).join(F.broadcast(goals) if small else goals, "source_key")
    spread = _hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string")), 8) % F.col("buckets")
    return out.withColumn("bucket", F.when(F.col("size") * LARGE > F.col("source_size"), F.lit(DOMINANT)).otherwise(spread))


def settled(large: DataFrame) -> DataFrame:
    """(source_key, whole, taken, held): the copies of a source's large documents, largest first, and their words.

    Each gets the whole number next to its step that brings the words taken nearest to the words due so
    far. A source has fewer than LARGE of them.
    """
    ordered = large.groupBy("source_key").agg(F.first("step").alias("step"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "doc_id"))), lambda x: -x["less"]).alias("sizes"))

    def more(acc: Column, size: Column) -> Column:
        held = acc["held"] + size
        near = F.floor((F.col("step") * held - acc["taken"]) / size + 0.5)
        copies = F.least(F.greatest(near, F.floor("step")), F.ceil("step")).cast("long")
        return F.struct((acc["taken"] + copies * size).alias("taken"), held.alias("held"), F.concat(acc["whole"], F.array(copies)).alias("whole"))

    start = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("whole"))
    return ordered.select("source_key", F.aggregate("sizes", start, more).alias("x")).select("source_key", "x.whole", "x.taken", "x.held")


def mix(df: DataFrame, sized: DataFrame | None = None, **options) -> DataFrame:
    """df (doc_id, source, size and any others) with source_size, target and copies (long).

    sized: the same rows with doc_id, source and size, if they can be had for less than df itself.
    """
    results = ["source_size", "target", "copies"]
    left = df.select(*[F.col(quoted(c)) for c in df.columns if c not in results])
    rows = carried(left, ["doc_id", "source", "size"])
    keys = carried(left if sized is None else sized, ["doc_id", "source", "size"]).select("doc_id", "source", "size")
    goals = written(targets(keys, **options), "mix-sources")
    small = goals.count() <= BROADCAST_SOURCES
    marked = _marked(keys, goals, small)
    rest = F.col("source_size") - F.coalesce("held", F.lit(0))
    step = F.when(F.col("whole").isNull(), F.col("step")).when(rest > 0, F.least(F.greatest((F.col("target") - F.col("taken")) / rest, F.lit(0.0)), F.lit(float(options.get("most", MOST))))).otherwise(0.0)
    goals = goals.join(settled(marked.filter(F.col("bucket") == DOMINANT)), "source_key", "left")
    goals = written(goals.select("source_key", "source_size", "target", step.alias("step"), "offset", "buckets", "whole"), "mix-goals")
    counts = marked.filter(F.col("bucket") != DOMINANT).groupBy("source_key", "bucket").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("here")
    counts = counts.select("source_key", "bucket", before.alias("before"))
    out = _marked(rows, goals, small)
    order = F.when((F.col("bucket") != DOMINANT) & (F.col("bucket") % 2 == 0), F.col("size")).otherwise(-F.col("size"))
    inside = F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy(order, "doc_id"))
    out = out.join(counts, ["source_key", "bucket"], "left").withColumn("inside", inside).withColumn("rank", F.col("before") + F.col("inside"))
    crossed = F.floor(F.col("step") * F.col("rank") + F.col("offset")) - F.floor(F.col("step") * (F.col("rank") - 1) + F.col("offset"))
    copies = F.when(F.col("bucket") == DOMINANT, F.get("whole", F.col("inside") - 1)).otherwise(crossed).cast("long")
    return out.select(*restored(left), "source_size", "target", copies.alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The texts are read once; what is ranked is a narrow table.
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it, with all its columns as they are."""
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    rows = carried(docs, ["doc_id", "source", "text"])
    out = mix(rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), *[c for c in rows.columns if c.startswith("_carried_")]), sized)
    copied = out.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*restored(docs))


def oracle() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    hashed = lambda x, n: f"('0x' || substr(md5({x}), 1, {n}))::BIGINT"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT k, source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY k, source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k = 'n', source) - 1) % {len(WEIGHTS)} {weights} END AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE - {MOST} * coalesce(sum(source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS one FROM w
  WINDOW p AS (ORDER BY source_size / weight, k = 'n', source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT k, n, source_size, least(max(one) OVER () * weight, {MOST}::DOUBLE * source_size) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step, {hashed("'" + str(SEED) + "|' || k", 13)} / pow(2, 52) AS off,
  (ceil(n / (greatest({LEAST_BUCKET}, floor(sqrt(n))) * 2)) * 2)::BIGINT AS buckets FROM t),
b AS MATERIALIZED (SELECT d.*, g.* EXCLUDE (k), CASE WHEN size * {LARGE} > source_size THEN {DOMINANT} ELSE {hashed("coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR", 8)} % buckets END AS bucket FROM d JOIN g USING (k)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k, bucket = {DOMINANT} ORDER BY bucket, CASE WHEN bucket >= 0 AND bucket % 2 = 0 THEN size ELSE -size END, doc_id NULLS FIRST) AS rank FROM b),
h AS MATERIALIZED (SELECT k, rank, size, step, sum(size) OVER (PARTITION BY k ORDER BY rank) AS held FROM r WHERE bucket = {DOMINANT}),
c(k, rank, copies, taken, held) AS (SELECT DISTINCT k, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM h UNION ALL
  SELECT k, h.rank, copies, (taken + copies * size)::BIGINT, h.held::BIGINT FROM (
    SELECT h.*, c.taken, least(greatest(floor((h.step * h.held - c.taken) / h.size + 0.5::DOUBLE), floor(h.step)), ceil(h.step))::BIGINT AS copies FROM c JOIN h ON c.k = h.k AND h.rank = c.rank + 1) h),
e AS (SELECT k, arg_max(taken, rank) AS taken, arg_max(held, rank) AS held FROM c GROUP BY k),
f AS (SELECT r.*, CASE WHEN e.k IS NULL THEN step WHEN source_size > held THEN least(greatest((target - taken) / (source_size - held), 0), {MOST}) ELSE 0 END AS rest FROM r LEFT JOIN e USING (k))
SELECT doc_id, size, source_size, target, (CASE WHEN bucket = {DOMINANT} THEN copies ELSE (floor(rest * f.rank + off) - floor(rest * (f.rank - 1) + off))::BIGINT END * size)::BIGINT AS taken
FROM f LEFT JOIN c ON c.k = f.k AND c.rank = f.rank AND bucket = {DOMINANT}"""
