"""Ranked lexical search: an Aho-Corasick automaton of all items' terms is run over every text.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. All bytes that
end a term are ASCII, so a text's UTF-8 bytes are mapped by one table: letters to lower case, everything else
of ASCII to a blank, the guard. Each term is in the automaton with a guard on both sides, so an output is a whole
term and never a part of one, and its number leads to the items that hold it. Two scans of the texts: the first
sums the documents, their terms and each item term's documents; the second scores each document as it passes, keeping
an item's k best in each task. No index of documents is made.

The automaton is broadcast, so its size is bounded: items are dealt by a hash to so many blocks that one has about
BLOCK characters of terms, and each block scans the texts by itself (one block for any usual set of items). A
single item beyond that is a block of its own; like any row it fits in a task.

Defined results: a null text has no terms; documents without terms count in no statistic; rows with one item_id
are one item with all their terms (so are those without an id); every row of the documents is a document, repeated
and missing ids included, null sorting first among equal scores; an item without terms, or none of whose terms is found,
has no rows. Very long texts are scanned whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import table

K, BLOCK = 10, 1_000_000
#: Products of (document, term, item) that are scored at once.
CHUNK = 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: By byte: lower case for A-Z, itself for what a term may hold, a blank for the rest.
GUARDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def guarded(text: bytes) -> str:
    """The text between guards, one character a byte."""
    return f" {text.translate(GUARDED).decode('latin-1')} "


class Terms:
    """The distinct terms of a block of items, and for each term the items that hold it, as slices of holders."""

    def __init__(self, items: list[list[str]]):
        self.terms = sorted({t for terms in items for t in terms})
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = sorted((number[t], item) for item, terms in enumerate(items) for t in set(terms))
        self.holders = np.array([item for _, item in pairs], np.int64)
        self.starts = np.searchsorted([t for t, _ in pairs], np.arange(len(self.terms) + 1))
        self.items = len(items)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(guarded(term.encode()), k)
        found.make_automaton()
        return found


def term_counts(automaton: ahocorasick.Automaton, text: str) -> Counter:
    """How often each item term is in a guarded text."""
    return Counter(map(itemgetter(1), automaton.iter(text)))


def length(text: str) -> int:
    """The number of terms of a guarded text."""
    blank = np.frombuffer(text.encode("latin-1"), np.uint8) == 32
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column("text").cast(pa.binary()):
        yield guarded(value.as_py() or b"")


class Best:
    """The k best documents of each item of those added so far."""

    def __init__(self, items: int, k: int):
        self.k, self.kth = k, np.ones(items, np.int64)  # scores are above 0
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, docs: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        """docs: ids; missing: whether an id is null; scores: a row a document, a column an item."""
        i, item = np.nonzero(scores >= self.kth[None, :])
        self.kept.append((item, scores[i, item], docs[i], missing[i]))
        self.size += len(i)
        if self.size > max(1 << 18, 4 * self.k * len(self.kth)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        item, score, doc, missing = (np.concatenate(c) for c in zip(*self.kept)) if self.kept else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        order = np.lexsort((doc, ~missing, -score, item))
        item, score, doc, missing = (c[order] for c in (item, score, doc, missing))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        stay, full = place < self.k, place == self.k - 1
        self.kth[item[full]] = score[full]
        self.kept = [(item[stay], score[stay], doc[stay], missing[stay])]
        self.size = len(self.kept[0][0])
        return self.kept[0]


def weighed(tf: np.ndarray, w: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item. Both tables are read more than once."""
    spark = docs.sparkSession
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col("item_id").cast("long"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), 0))).alias("term"))
    # terms of one item come together; its rows and their number are what the scan needs of it
    whole = terms.groupBy("item_id").agg(F.collect_set("term").alias("terms"), F.sum(F.length("term")).alias("chars"))
    blocks = max(1, math.ceil((whole.agg(F.sum("chars")).first()[0] or 0) / block))
    texts_of = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for number in range(blocks):
        own = whole.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).orderBy("item_id").collect()
        found = _block(spark, texts_of, [r["item_id"] for r in own], Terms([r["terms"] for r in own]), k)
        out = found if out is None else out.unionByName(found)
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return out.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(spark: SparkSession, docs: DataFrame, ids: list[int | None], terms: Terms, k: int) -> DataFrame:
    """The k best of every task's documents for each item of a block."""
    result = "item_id bigint, doc_id bigint, score bigint"
    if not terms.terms:
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, holding = shared.value.automaton(), np.zeros(len(shared.value.terms) + 2, np.int64)
        for batch in batches:
            for text in texts(batch):
                n = length(text)
                holding[-2:] += (n > 0, n)
                holding[list(term_counts(automaton, text))] += 1
        term = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(holding[term])], ["term", "n"])

    # one row a term of the block: bounded as the automaton is
    sums = docs.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    holding = np.zeros(len(terms.terms) + 2, np.int64)
    holding[sums["term"].to_numpy(int)] = sums["n"]
    documents, total = int(holding[-2]), int(holding[-1])
    if not total:
        return spark.createDataFrame([], result)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding[:-2]], np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        automaton, best = held.automaton(), Best(held.items, k)
        fan = np.diff(held.starts)
        doc, tf, term, m, made = [], [], [], [], 0

        def flush() -> None:
            if doc:
                of = np.repeat(np.arange(len(doc)), [len(t) for t in term])
                which = np.concatenate(term)
                value = weighed(np.concatenate(tf), weights[which], np.array(m, np.int64)[of])
                n = fan[which]
                # the holders of every term one after the other
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(held.starts[which], n)
                scores = np.zeros(len(doc) * held.items, np.int64)
                np.add.at(scores, np.repeat(of, n) * held.items + held.holders[at], np.repeat(value, n))
                best.add(np.array([d or 0 for d in doc], np.int64), np.array([d is None for d in doc]), scores.reshape(len(doc), held.items))
            for part in (doc, tf, term, m):
                part.clear()

        for batch in batches:
            for d, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                counts = term_counts(automaton, text)
                if counts:
                    doc.append(d)
                    term.append(np.fromiter(counts.keys(), np.int64, len(counts)))
                    tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
                    m.append(10 + 90 * length(text) * documents // total)
                    made += int(fan[term[-1]].sum()) + held.items
                    if made > CHUNK:
                        flush()
                        made = 0
        flush()
        item, scores, found, missing = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in item], pa.int64()), pa.array(found, pa.int64(), mask=missing), pa.array(scores)], ["item_id", "doc_id", "score"])

    return docs.mapInArrow(score, result)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle() -> str:
    terms = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
WITH d AS (SELECT doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS docs, sum(len(ts))::BIGINT AS total FROM d),
i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s WHERE term IN (SELECT term FROM i) GROUP BY term),
m AS (SELECT doc_id, 10 + (90 * len(ts)::BIGINT * docs) // total AS m FROM d, s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {K}"""
