"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input has three parts: its evidence (how many standard errors its share of toxic training
documents is from even, by hashed word), a learned vector of the hashed word (if FAMILIAR documents have it), and the mean of learned
vectors of its hashed character trigrams. Two recurrent networks read a window of WINDOW words in both
directions, attention pools their states, and a linear layer gives the window's logit. A text has a window
at every word that WINDOW words follow, itself included; a shorter text is one window. All are scored, in
training as in use, and the text's score is that of its most toxic window, calibrated on the training
documents.

Labels are of documents, not of windows: windows of toxic documents start as those with the strongest
evidence and are chosen anew by the network's own scores between rounds. Evidence for one half of the
training documents comes from the other half, so that no document vouches for its own words.

Bounds: at most per_class training documents of each class (those with the smallest hashes of doc_id), none
over longest bytes, come to the driver. All documents are scored, whole.

Defined results: null text and text without words have the score of an empty window, below 0.7 by
construction; words are lower-cased and stripped of punctuation at both ends; without labels of both
kinds every score is 0; ids with both labels are not trained on; rows that repeat an id are scored one by
one; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.llm.common import table
from sparktl.llm.language import few_of_each, held_out

WINDOW = 8
WORDS, GRAMS = 1 << 15, 1 << 12
VECTOR, LETTERS, HIDDEN = 4, 4, 8
PER_CLASS, LONGEST = 800, 1 << 17
#: Training texts that share more than this part of their words with an earlier one vouch for nothing new.
NEAR_COPIES = 0.5
STEPS, BATCH, RATE, DECAY = 900, 64, 0.01, 1.0
MOST_EPOCHS = 30
#: Training documents in which a hashed word must stand to have a vector of its own.
FAMILIAR = 25
THRESHOLD = 0.7
MAX_CACHE = 300_000
EDGES = re.compile(r"^[^\w]+|[^\w]+$")
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„’‘…"


def plain(word: str) -> str:
    return word.strip(STRIP).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of plain words: hashed word, the hashed trigrams of all words, and where each word's begin."""
    raw = [w.encode("utf-8", "replace") for w in words]
    bucket = np.array([zlib.crc32(w) % WORDS for w in raw], np.int64)
    b = np.frombuffer(b"  " + b"  ".join(raw) + b"  ", np.uint8).astype(np.uint32)
    grams = ((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
    starts = np.append(0, np.cumsum([len(w) + 2 for w in raw])[:-1])
    return bucket, grams, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    evidence: np.ndarray
    familiar: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def new(cls, evidence: np.ndarray, familiar: np.ndarray, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        size = 1 + VECTOR + LETTERS
        p = {"word": r.normal(0, 0.05, (WORDS, VECTOR)), "gram": r.normal(0, 0.05, (GRAMS, LETTERS)), "query": r.normal(0, 0.3, 2 * HIDDEN), "out": r.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            p[f"{d}_in"] = r.normal(0, size**-0.5, (size, 3 * HIDDEN))
            p[f"{d}_state"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
            p[f"{d}_bias"] = np.zeros(3 * HIDDEN)
        return cls({k: v.astype(np.float32) for k, v in p.items()}, evidence, familiar)

    def inputs(self, words: list[str], evidence: np.ndarray | None = None) -> np.ndarray:
        """The input vectors of plain words, and a last one of zeros for padding."""
        bucket, grams, starts = features(words)
        known = self.evidence if evidence is None else evidence
        counts = np.diff(np.append(starts, len(grams)))[:, None]
        letters = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / counts
        out = np.zeros((len(words) + 1, 1 + VECTOR + LETTERS), np.float32)
        out[:-1] = np.column_stack([known[bucket], self.p["word"][bucket] * self.familiar[bucket, None], letters])
        return out

    def run(self, x: np.ndarray, steps: np.ndarray, keep: bool = False):
        """Logits of windows. x: projections of inputs by direction; steps: (windows, WINDOW) rows of x, -1 for none."""
        n, h = len(steps), HIDDEN
        states, kept = np.zeros((n, WINDOW, 2 * h), np.float32), {}
        real = (steps >= 0).astype(np.float32)
        for d, (name, order) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
            s, u = np.zeros((n, h), np.float32), self.p[f"{name}_state"]
            for t in order:
                a = x[d][steps[:, t]]
                g = s @ u[:, : 2 * h]
                g += a[:, : 2 * h]
                g = 1 / (1 + np.exp(-g))
                c = np.tanh(a[:, 2 * h :] + (g[:, h:] * s) @ u[:, 2 * h :])
                m = real[:, t : t + 1]
                new = s + m * g[:, :h] * (c - s)
                if keep:
                    kept[d, t] = (s, g, c)
                s = new
                states[:, t, d * h : d * h + h] = s
        score = np.tanh(states) @ self.p["query"]
        score = np.where(real > 0, score, -30)
        score = np.exp(score - score.max(1, keepdims=True))
        share = score / score.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", share, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, share, pooled, real, kept) if keep else logit

    def sweep(self, x: list[np.ndarray], ids: np.ndarray, part: int = 2048) -> np.ndarray:
        """run() of the window at each place of a text (row numbers of x), whose steps are slices of one array."""
        h, half, out = HIDDEN, np.float32(0.5), np.empty(len(ids) - WINDOW + 1, np.float32)
        for at in range(0, len(out), part):
            m = min(part, len(out) - at)
            score, value = np.zeros((WINDOW, m), np.float32), np.zeros((WINDOW, m), np.float32)
            for d, (name, order) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
                a, u = np.ascontiguousarray(x[d][ids[at : at + m + WINDOW - 1]].T), self.p[f"{name}_state"].T
                a[: 2 * h] *= half  # a logistic function is a tangent of half its argument
                gates, state = u[: 2 * h] * half, np.ascontiguousarray(u[2 * h :])
                query, last = self.p["query"][d * h : d * h + h], self.p["out"][d * h : d * h + h]
                s = np.zeros((h, m), np.float32)
                for t in order:
                    g = gates @ s
                    g += a[: 2 * h, t : t + m]
                    np.tanh(g, out=g)
                    g *= half
                    g += half
                    g[h:] *= s
                    c = state @ g[h:]
                    c += a[2 * h :, t : t + m]
                    np.tanh(c, out=c)
                    c -= s
                    c *= g[:h]
                    s += c
                    value[t] += last @ s
                    score[t] += query @ np.tanh(s)
            score -= score.max(0)
            np.exp(score, out=score)
            value *= score
            out[at : at + m] = value.sum(0) / score.sum(0) + self.p["bias"][0]
        return out

    def project(self, inputs: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(inputs @ self.p[f"{d}_in"] + self.p[f"{d}_bias"], np.float32) for d in "fb"]

    def gradients(self, inputs: np.ndarray, steps: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean log loss for the dense parameters, and for the inputs."""
        h, n = HIDDEN, len(steps)
        x = self.project(inputs)
        logit, states, share, pooled, real, kept = self.run(x, steps, keep=True)
        prob = sigmoid(logit)
        loss = -np.mean(labels * np.log(prob + 1e-9) + (1 - labels) * np.log(1 - prob + 1e-9))
        dl = ((prob - labels) / n).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["out"]
        ds = share[:, :, None] * dp[:, None, :]
        dshare = np.einsum("nth,nh->nt", states, dp)
        dscore = share * (dshare - (share * dshare).sum(1, keepdims=True)) * real
        th = np.tanh(states)
        g["query"] = np.einsum("nt,nth->h", dscore, th)
        ds += dscore[:, :, None] * (1 - th * th) * self.p["query"]
        dx = np.zeros_like(inputs)
        for d, (name, order) in enumerate((("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW)))):
            u = self.p[f"{name}_state"]
            da, du, back = np.zeros_like(x[d]), np.zeros_like(u), np.zeros((n, h), np.float32)
            for t in order:
                s, gate, c = kept[d, t]
                z, r, m = gate[:, :h], gate[:, h:], real[:, t : t + 1]
                dn = back + ds[:, t, d * h : d * h + h]
                dz, dc = m * dn * (c - s) * z * (1 - z), m * dn * z * (1 - c * c)
                dr = (dc @ u[:, 2 * h :].T) * s * r * (1 - r)
                gates = np.concatenate([dz, dr], 1)
                du[:, : 2 * h] += s.T @ gates
                du[:, 2 * h :] += (r * s).T @ dc
                back = dn * (1 - m * z) + gates @ u[:, : 2 * h].T + (dc @ u[:, 2 * h :].T) * r
                np.add.at(da, steps[:, t], np.concatenate([gates, dc], 1))
            da[-1] = 0  # padding
            g[f"{name}_state"], g[f"{name}_in"], g[f"{name}_bias"] = du, inputs.T @ da, da.sum(0)
            dx += da @ self.p[f"{name}_in"].T
        return g, dx, float(loss)


def windows(net: Network, x: list[np.ndarray], flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of every window of texts that follow one another in flat, and where each text's begin."""
    sizes = np.maximum(counts - WINDOW + 1, 1)
    long, base = counts >= WINDOW, np.append(0, np.cumsum(counts)[:-1])
    out, of_long = np.empty(sizes.sum(), np.float32), np.repeat(long, sizes)
    if long.any():
        n = counts[long]
        place = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        inside = place < np.repeat(sizes[long], n)  # the others reach into the next text
        out[of_long] = net.sweep(x, flat[np.repeat(long, counts)])[inside[: 1 - WINDOW]]
    if not long.all():
        at = np.arange(WINDOW)
        steps = np.append(flat, -1)[np.where(at < counts[~long, None], base[~long, None] + at, -1)]
        out[~of_long] = net.run(x, steps)
    return out, np.append(0, np.cumsum(sizes)[:-1])


def evidence_of(docs: list[set[int]], labels: np.ndarray) -> np.ndarray:
    """Standard errors by which each hashed word is more frequent in toxic documents, clipped and scaled."""
    count = np.zeros((2, WORDS))
    for words, y in zip(docs, labels):
        count[int(y), list(words)] += 1
    n = [(labels == 0).sum(), (labels == 1).sum()]
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    z = odds / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))
    return np.where(count.sum(0) > 0, np.clip(z, -3, 6) / 3, 0).astype(np.float32)


def originals(sets: list[set[int]], most: float, fold: int = 1 << 14) -> np.ndarray:
    """Numbers of the sets that are not near copies of an earlier one; copies would vouch for each other."""
    b = np.zeros((len(sets), fold), np.float32)
    for row, words in zip(b, sets):
        row[[w % fold for w in words]] = 1
    size = b.sum(1)
    common = b @ b.T
    near = np.tril(common > most * (size[:, None] + size[None, :] - common), -1)
    return np.flatnonzero(~near.any(1))


def trained(texts: list[str], labels: np.ndarray, seed: int = 5, rate: float | None = None, near_copies: float | None = NEAR_COPIES) -> Network | None:
    """Fit on labelled texts; None without both labels.

    rate: the share of toxic texts to calibrate for. near_copies: texts that share more than this part of
    their hashed words with an earlier one are left out of the training; None keeps them all.
    """
    labels = np.asarray(labels, float)
    if len(set(labels.tolist())) < 2:
        return None
    r = np.random.default_rng(seed)
    split = [[plain(w) for w in t.split()] for t in texts]
    names = sorted({w for ws in split for w in ws})
    number = {w: k for k, w in enumerate(names)}
    tokens = [np.array([number[w] for w in ws], np.int64) for ws in split]
    bucket, grams, starts = features(names) if names else (np.zeros(0, int),) * 3
    sets = [set(bucket[t].tolist()) for t in tokens]
    kept = np.arange(len(sets)) if near_copies is None else originals(sets, near_copies)
    if len(set(labels[kept].tolist())) == 2:
        texts, tokens, sets, labels = [texts[i] for i in kept], [tokens[i] for i in kept], [sets[i] for i in kept], labels[kept]
    order = r.permutation(len(texts))
    fold = np.zeros(len(texts), int)
    for y in (0, 1):  # halves with both labels in each
        mine = order[labels[order] == y]
        fold[mine[::2]] = 1
    halves = [evidence_of([sets[i] for i in np.flatnonzero(fold != k)], labels[fold != k]) for k in (0, 1)]
    familiar = (np.bincount([b for s in sets for b in s], minlength=WORDS) >= FAMILIAR).astype(np.float32)
    net = Network.new(evidence_of(sets, labels), familiar, seed)
    counts = np.diff(np.append(starts, len(grams)))
    lengths = np.array([len(t) for t in tokens])

    def strength(i: int) -> np.ndarray:
        known = np.append(halves[fold[i]][bucket[tokens[i]]] if len(bucket) else [], [-9] * max(0, WINDOW - len(tokens[i])))
        return np.lib.stride_tricks.sliding_window_view(known, WINDOW).max(1)

    def scores() -> list[np.ndarray]:
        """Of each text, the logits of its windows, by the evidence of the other half."""
        out: list = [None] * len(texts)
        for k in (0, 1):
            mine = np.flatnonzero(fold == k)
            if len(mine):
                x = net.project(net.inputs(names, halves[k])) if names else [np.zeros((1, 3 * HIDDEN), np.float32)] * 2
                logit, first = windows(net, x, np.concatenate([tokens[i] for i in mine]), lengths[mine])
                for i, part in zip(mine, np.split(logit, first[1:])):
                    out[i] = part
        return out

    def steps_of(i: int, chosen: list[int]) -> np.ndarray:
        at = np.array(chosen)[:, None] + np.arange(WINDOW)
        return np.append(tokens[i], -1)[np.where(at < lengths[i], at, -1)]

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def update(k: str, gradient: np.ndarray) -> None:
        a, b = moments[k]
        a += 0.1 * (gradient - a)
        b += 0.001 * (gradient * gradient - b)
        net.p[k] -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)

    epoch = 0
    while step < STEPS and epoch < MOST_EPOCHS:
        epoch += 1
        own = 3 * step >= STEPS or 3 * epoch >= MOST_EPOCHS
        own_scores = scores() if own else None
        rows, sides, targets = [], [], []
        for i in range(len(texts)):
            s = own_scores[i] if own else strength(i)
            if labels[i]:
                chosen = [int(s.argmax())]
            else:
                chosen = list({int(s.argmax()), *r.integers(0, len(s), 5).tolist()})
            rows.append(steps_of(i, chosen))
            sides += [fold[i]] * len(chosen)
            targets += [labels[i]] * len(chosen)
        rows, sides, targets = np.concatenate(rows), np.array(sides), np.array(targets)
        for side in r.permutation(2):
            mine = r.permutation(np.flatnonzero(sides == side))
            for at in range(0, len(mine), BATCH):
                batch = mine[at : at + BATCH]
                used, place = np.unique(rows[batch], return_inverse=True)
                place = place.reshape(rows[batch].shape)
                if used[0] == -1:
                    used, place = used[1:], place - 1
                if not len(used):
                    continue
                step += 1
                spans = [np.arange(starts[w], starts[w] + counts[w]) for w in used]
                flat = grams[np.concatenate(spans)]
                begin = np.append(0, np.cumsum(counts[used])[:-1])
                letters = np.add.reduceat(net.p["gram"][flat], begin, axis=0) / counts[used][:, None]
                inputs = np.zeros((len(used) + 1, 1 + VECTOR + LETTERS), np.float32)
                inputs[:-1] = np.column_stack([halves[side][bucket[used]], net.p["word"][bucket[used]] * familiar[bucket[used], None], letters])
                g, dx, _ = net.gradients(inputs, place, targets[batch])
                word, gram = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
                np.add.at(word, bucket[used], dx[:-1, 1 : 1 + VECTOR] * familiar[bucket[used], None])
                np.add.at(gram, flat, np.repeat(dx[:-1, 1 + VECTOR :] / counts[used][:, None], counts[used], axis=0))
                for k, v in (*g.items(), ("word", word), ("gram", gram)):
                    update(k, v)
                for k in ("word", "gram"):
                    net.p[k] *= 1 - RATE * DECAY
    # calibration: logistic regression on the best window of each training document
    best = np.array([s.max() for s in scores()])
    a, b, share = 1.0, 0.0, labels.mean()
    weight = np.where(labels == 1, (rate or share) / share, (1 - (rate or share)) / (1 - share))
    for _ in range(50):
        p = sigmoid(a * best + b)
        w = weight * p * (1 - p) + 1e-6
        grad = np.array([(weight * (p - labels) * best).sum() + 1e-2 * (a - 1), (weight * (p - labels)).sum()])
        hess = np.array([[(w * best * best).sum() + 1e-2, (w * best).sum()], [(w * best).sum(), w.sum()]])
        da, db = np.linalg.solve(hess, grad)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    if a <= 0:
        a, b = 1.0, 0.0
    net.slope, net.shift = float(a), float(b)
    return net


class Scorer:
    """Scores texts with a worker's cache of word projections, emptied when full."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.x = [np.zeros((1 << 14, 3 * HIDDEN), np.float32) for _ in range(2)]

    def add(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if not new:
            return
        end = len(self.number) + len(new)
        while end >= len(self.x[0]):
            self.x = [np.concatenate([x, np.zeros_like(x)]) for x in self.x]
        made = self.net.project(self.net.inputs([plain(w) for w in new])[:-1])
        for x, m in zip(self.x, made):
            x[len(self.number) : end] = m
        self.number.update(zip(new, range(len(self.number), end)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self.number) > MAX_CACHE:
            self.clear()
        split = [(t or "").split() for t in texts]
        try:
            tokens = [list(map(self.number.__getitem__, ws)) for ws in split]
        except KeyError:
            self.add([w for ws in split for w in ws])
            tokens = [list(map(self.number.__getitem__, ws)) for ws in split]
        counts = np.array([len(t) for t in tokens])
        logit, first = windows(self.net, self.x, np.array([k for t in tokens for k in t], np.int64), counts)
        best = np.maximum.reduceat(logit, first)
        score = sigmoid(self.net.slope * best + self.net.shift)
        return np.where(counts == 0, np.minimum(score, THRESHOLD / 2), score)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Network | None:
    """Train on docs (doc_id, text) with labels (doc_id, toxic), at most per_class documents of a class.

    Ids with both labels are left out, as are texts that are null or over longest bytes; of several texts
    of one id the one with the smallest hash is taken.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").select("doc_id", "toxic")
    some = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
    mine = known.join(some.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_hash", F.xxhash64("doc_id"))
    # per_class rows of each of two classes are broadcast
    chosen = few_of_each(mine, "toxic", "_hash", per_class).select("doc_id", "toxic")
    rows = some.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("doc_id").collect()
    rate = known.agg(F.avg("toxic")).first()[0]
    return trained([r["text"] for r in rows], np.array([r["toxic"] for r in rows]), rate=rate)


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                score = scorer.scores(part.column(1).to_pylist()) if scorer else np.zeros(part.num_rows)
                score = score.astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype("<i4"))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    net = fit(docs.filter(~held_out(F.col("doc_id"))), labels)
    return scored(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
