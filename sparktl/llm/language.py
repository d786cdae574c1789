"""Language identification by prediction by partial matching over bytes.

Training text of each language gives a tree of contexts of up to ORDER bytes: how often each byte
followed each context. The trees are then frozen. The code length of a byte is that of escape method
C: from the longest context that was seen, -log2(n(s) / (n + q)) where the byte was seen in it (n
bytes, q of them different), else the escape -log2(q / (n + q)) and the next shorter context, down
to equal shares of the 256 bytes. A text's language is the one with the shortest code, summed in double
precision over every byte of the whole text.

A byte with its context is one integer of 32 bits. A stretch of texts has few different ones, so each is
looked up once, for all languages; a worker keeps the lengths of at most CACHE of them.

Bounds: at most per_language training documents of a language (those with the smallest hashes of
doc_id and text), none longer than longest bytes, come to the driver; every text is scored whole.

Defined results: null text or text without a letter is "und" with score 0; equal code lengths go to
the first language in code point order; without any training text all is "und". Rows that repeat an id
are trained on and scored one by one (equal rows are trained on once); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparktl.llm.common import table, written

ORDER, BITS = 3, 8
PER_LANGUAGE, LONGEST = 300, 1 << 16
PIECE, CACHE = 1 << 20, 1 << 18
#: Up to so many keys their counts are broadcast; beyond it, they are joined by shuffle.
BROADCAST_KEYS = 20_000
LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def codes(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in its text; before a text stand bytes 0."""
    out = symbols.astype(np.uint32)
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    for k in range(1, ORDER + 1):
        before = np.zeros(len(symbols), np.uint32)
        before[k:] = symbols[:-k]
        before[place < k] = 0
        out |= before << np.uint32(BITS * k)
    return out


def mask(k: int) -> np.uint32:
    """The bits of a byte and the k bytes before it."""
    return np.uint32((1 << BITS * (k + 1)) - 1)


@dataclass
class Trees:
    """One language's frozen counts: per order, sorted codes of context + symbol, and of contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, code: np.ndarray) -> Trees:
        grams, contexts = [], []
        for k in range(ORDER + 1):
            gram, n = np.unique(code & mask(k), return_counts=True)
            context, at = np.unique(gram >> np.uint32(BITS), return_inverse=True)
            grams.append((gram, n))
            contexts.append((context, np.bincount(at, n).astype("<i8"), np.bincount(at)))
        return cls(grams, contexts)

    def lengths(self, code: np.ndarray) -> np.ndarray:
        """Bits of each symbol after its context."""

        def look(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return np.where(keys[at] == want, values[at], 0)

        out, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        for k in range(ORDER, -1, -1):
            gram = code & mask(k)
            keys, totals, kinds = self.contexts[k]
            context = gram >> np.uint32(BITS)
            n, q, m = look(keys, totals, context), look(keys, kinds, context), look(*self.grams[k], gram)
            hit, escape = open_ & (m > 0), open_ & (m == 0) & (n > 0)
            out[hit] -= np.log2(m[hit] / (n[hit] + q[hit]))
            out[escape] -= np.log2(q[escape] / (n[escape] + q[escape]))
            open_ &= m == 0
        out[open_] += BITS  # one of 256 bytes
        return out


@dataclass
class Model:
    languages: list[str]
    trees: list[Trees]
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32), repr=False)
    rows: np.ndarray = field(default=None, repr=False)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """A row of code lengths, one for each language, for each of the codes (distinct, ascending)."""
        if self.rows is None:
            self.rows = np.zeros((0, len(self.languages)))
        at = np.minimum(np.searchsorted(self.known, code), max(len(self.known) - 1, 0))
        new = code[self.known[at] != code] if len(self.known) else code
        if not len(new):
            return self.rows[at]
        lengths = np.stack([t.lengths(new) for t in self.trees], 1)
        if len(self.known) + len(new) > CACHE:
            out = np.zeros((len(code), len(self.languages)))
            old = np.isin(code, new, assume_unique=True, invert=True)
            out[old], out[~old] = self.rows[at[old]], lengths
            # what is met in this stretch is the likeliest to come again
            self.known, self.rows = code[:CACHE], out[:CACHE]
            return out
        every = np.concatenate([self.known, new])
        order = np.argsort(every, kind="stable")
        self.known, self.rows = every[order], np.concatenate([self.rows, lengths])[order]
        return self.rows[np.searchsorted(self.known, code)]

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text (not empty) under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([len(t) for t in texts])
        groups = np.cumsum(sizes) // PIECE
        for g in np.unique(groups):
            mine = np.flatnonzero(groups == g)
            starts = np.append(0, np.cumsum(sizes[mine])[:-1])
            code, place = np.unique(codes(np.frombuffer(b"".join(texts[i] for i in mine), np.uint8), starts), return_inverse=True)
            costs = self.costs(code)
            for k in range(len(self.languages)):
                out[mine, k] = np.add.reduceat(costs[place, k], starts)
        return out

    def frozen(self) -> Model:
        return Model(self.languages, self.trees)


def trained(texts: dict[str, list[str]]) -> Model:
    """The model of non-empty training texts by language."""
    raw = {k: [t.encode("utf-8", "replace") for t in v if t] for k, v in sorted(texts.items())}
    raw = {k: v for k, v in raw.items() if v}
    trees = []
    for v in raw.values():
        starts = np.append(0, np.cumsum([len(t) for t in v])[:-1])
        trees.append(Trees.of(codes(np.frombuffer(b"".join(v), np.uint8), starts)))
    return Model(list(raw), trees)


def few_of_each(rows: DataFrame, key: str, least: str, most: int) -> DataFrame:
    """At most most rows of each key, distinct in least and the key: those with the smallest values of least.

    least: a column of hashes. A threshold from one count by key leaves about twice as many rows of a
    key as are asked for, however many it has, before they are ranked.
    """
    counts = written(rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_many")), "few-counts")
    if counts.count() <= BROADCAST_KEYS:
        counts = F.broadcast(counts)
    share = (F.col(least) / F.lit(2.0**64) + 0.5) * F.col("_many") <= 2 * most + 50
    place = F.row_number().over(Window.partitionBy(key).orderBy(least))
    near = rows.join(counts, F.col(key) == F.col("_key")).filter(share).drop("_key", "_many").dropDuplicates([key, least])
    return near.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model:
    """Train on docs (doc_id, text, lang), at most per_language of each; null langs, ids and texts and texts over longest bytes are left out."""
    some = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(F.octet_length("text") <= longest)
    some = some.select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    texts: dict[str, list[str]] = {}
    for r in few_of_each(some, "lang", "_hash", per_language).select("lang", "text").collect():
        texts.setdefault(r[0], []).append(r[1])
    return trained(texts)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): score is the winner's share of 2^-length over all languages."""
    held = docs.sparkSession.sparkContext.broadcast(model.frozen())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model.languages else []
            if some:
                bits = model.totals([texts[i].encode("utf-8", "replace") for i in some])
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                for i, b, s in zip(some, best, share):
                    names[i], scores[i] = model.languages[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predicted(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
