"""Exact search, ranked lexical search and the prefix trie: brute force on odd rows, and their parts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktl.llm import balltree, lexical, prefix_trie

NAN, INF = float("nan"), float("inf")


def products(rows, asked, k):
    """(query, rank, id, score) by all pairs, in Python's whole numbers."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            usable[i] = min(usable.get(i, v), v)
    out = []
    for q in sorted(i for i in usable if asked(i)):
        found = []
        for i, v in usable.items():
            if i != q:
                score = sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(v, usable[q]))
                found.append((-min(max(score, -(2**63)), 2**63 - 1), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def searched(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(0), "score": F.lit("own"), "shard": F.lit(1)})
    out = balltree.top_products(df, df.filter("vec_id % 5 = 0"), **options).collect()
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in out)


def test_exact_search_on_odd_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows += [(i, [0.5, 0.25, -0.5, 0.0, 0.125, 1.0]) for i in range(60, 130)]  # copies: ties by id
    rows += [(None, [1.0] * 6), (130, None), (131, [1.0, None] * 3), (132, [NAN] * 6), (133, [INF] * 6), (134, [1e308] * 6), (135, [0.0] * 6), (140, []), (145, [3.0, -2.0])]
    rows += [(5, rows[5][1]), (10, [-9.0] * 6), (150, [r.uniform(-1, 1) for _ in range(9)])]
    for options in ({}, {"shard": 16, "block": 4}):
        assert searched(spark, rows, k=5, **options) == products(rows, lambda i: i % 5 == 0, 5)
    assert searched(spark, rows[:3], k=5) == products(rows[:3], lambda i: i % 5 == 0, 5)  # fewer than k
    assert searched(spark, rows[:1], k=5) == searched(spark, [(7, None)], k=5) == searched(spark, [], k=5) == []


def test_exact_search_beyond_doubles(spark):
    rows = [(i, [2.0**30 + i, 2.0**31 - i, float(i)]) for i in range(12)] + [(20, [1e17, 1e17, 1e17]), (25, [-1e17] * 3)]
    assert searched(spark, rows, k=4) == products(rows, lambda i: i % 5 == 0, 4)


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_the_tree_leaves_out_no_winner(spread):
    r = np.random.default_rng(1)
    x = np.floor(256 * (r.normal(0, 3, (8, 12))[r.integers(0, 8, 700)] + r.normal(0, spread, (700, 12))))
    tree = balltree.BallTree(x, np.arange(700), 16)
    assert (np.sort(tree.ids) == np.arange(700)).all()
    for a, b in tree.spans:
        assert b - a
    s = (x[::7] @ x.T).astype(int)
    bounds = tree.bounds(x[::7])
    for node, (a, b) in enumerate(tree.spans):
        assert (bounds[:, node] >= (x[::7] @ tree.points[a:b].T).max(1)).all()
    i, ids, score = tree.search(x[::7], np.arange(700)[::7], np.full(100, balltree.LONG.min), 5)
    for q in range(100):
        best = sorted((-v, j) for j, v in enumerate(s[q]) if j != 7 * q)[:5]
        assert list(zip(-score[i == q], ids[i == q])) == best
    if spread < 1:  # clusters: with the k-th scores known, most leaves are never read
        kth = np.array([score[i == q].min() for q in range(100)])
        assert len(tree.leaves(bounds, kth)[0]) < 0.5 * 100 * (tree.children < 0).sum()


TERMS = re.compile(lexical.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERMS.findall((text or "").translate(LOWER))


def lexically(docs, items, k):
    held = {}
    for i, text in items:
        held.setdefault(i, set()).update(terms_of(text))
    ts = [terms_of(t) for _, t in docs]
    n, total = sum(map(bool, ts)), sum(map(len, ts))
    df = lambda t: sum(t in x for x in ts)
    out = []
    for i, own in held.items():
        scores = []
        for (d, _), x in zip(docs, ts):
            score = 0
            for t in own & set(x):
                w, tf, m = math.floor(1000 * math.log((2 * n + 2) / (2 * df(t) + 1))), x.count(t), 10 + 90 * len(x) * n // total
                score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ODD = [
    (1, None), (2, ""), (3, " \n--"), (4, "The cat"), (5, "the CAT sat, the cat ran"), (6, "scatter the\tcat-flap"), (7, "naïve café ÉCOLE école cat"), (8, "a b\x00c ſ K İ i̇ 日本語 😀x"),
    (None, "cat the café"), (9, "the cat"), (9, "the cat"), (10, "x9 x9 X9 9x"), (11, "the " * 3000 + "cat " * 3000), (12, " ".join(f"w{k}" for k in range(5000)) + " café"),
]
ITEMS = [(1, "The cat; the dog"), (2, "CAFÉ café naïve"), (2, "x9 école"), (3, None), (4, ""), (5, "nowhere"), (None, "日本語 c ſ"), (6, "w17 w4999 9x i cat"), (7, "the"), (8, "École Cafe")]


@pytest.mark.parametrize("block", [lexical.BLOCK, 12])
def test_lexical_on_odd_rows(spark, block):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit(1), "term": F.lit("own"), "rank": F.lit(0)}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("own"))
    for k in (3, 10):
        out = lexical.ranked(docs, items, k, block).collect()
        assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out), key=str) == lexically(ODD, ITEMS, k)
    assert lexical.ranked(docs.limit(0), items).count() == lexical.ranked(docs, items.limit(0)).count() == 0


def test_the_guards_keep_terms_whole():
    terms = lexical.Terms([["cat", "at"], ["é", "cat"]])
    text = lexical.guarded("Cat scat cat,cat\tat É é_é".encode())
    assert {terms.terms[k]: n for k, n in lexical.term_counts(terms.automaton(), text).items()} == {"cat": 3, "at": 1, "é": 2}
    assert lexical.length(text) == len(terms_of("Cat scat cat,cat\tat É é_é")) == 8
    assert [terms.holders[terms.starts[k] : terms.starts[k + 1]].tolist() for k in range(3)] == [[0], [0, 1], [1]]


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(int(c - math.fmod(c, 20)), [])[:h] + ts[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, convs in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = lambda n: [x for x in nodes if len(x) == len(n) + 1 and x[:-1] == n]
        words = lambda n: len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        saved = sum((len(nodes[n]) - 1) * words(n) for n in below)
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children(node)), sum(not children(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def walked(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"path": F.lit("own"), "words": F.lit(1), "place": F.lit(0), "shard": F.lit(0)})
    return sorted(map(tuple, prefix_trie.trie(df, **options).collect()), key=str)


def conversations(seed, count):
    r = random.Random(seed)
    rows = []
    for c in range(count):
        for turn in range(r.randrange(1, 5)):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["yes", "no, not now", "", "a b c"])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_all_prefixes(spark, seed):
    assert walked(spark, conversations(seed, 70), shard=20) == plain_trie(conversations(seed, 70))


def test_trie_on_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, None, None), (2, 3, "user", "a\tb  c"), (2, 3, "user", "a"), (2, None, "b", "first"), (3, 0, "", "x"), (-7, 0, "user", "below"), (-27, 1, "user", "far below")]
    rows += [(0, k, "user", f"turn {k}") for k in range(3)] + [(21, 0, "user", "no base"), (40, 0, "user", "short base"), *[(41 + c, k, "u", "w " * 200) for c in range(19) for k in range(5)]]
    rows += [(60, k, "user", f"long {k}") for k in range(300)] + [(61, k, "user", f"long {k}") for k in range(299)]
    rows += [(100 + 20 * c, k, "user", f"copy {k}") for c in range(90) for k in range(3)]  # copies of one conversation
    assert walked(spark, rows, shard=100) == plain_trie(rows)
    assert walked(spark, rows) == plain_trie(rows)
    assert walked(spark, rows[:0]) == walked(spark, rows[:1]) == []
    alone = [(19, 0, "user", "dropped")]
    assert zlib.crc32(b"19") % 4 and walked(spark, alone) == plain_trie(alone) == [(19, 0, None, 1, 0, 1, 0, hashlib.sha256(b"19").hexdigest())]


def test_ends_in_pieces(spark, monkeypatch):
    """A node's ids come in pieces from several shards, and its hash is that of all of them."""
    rows = [(20 * c, 0, "user", "one turn") for c in range(150)]
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    assert walked(spark, rows, shard=10) == plain_trie(rows)


def test_the_skeleton_holds_what_spans_shards():
    r = random.Random(2)
    digest = [bytes([k]) * prefix_trie.DIGEST for k in range(4)]
    keys = sorted((b"".join(r.choice(digest) for _ in range(r.randrange(6))), c) for c in range(400))
    for most in (prefix_trie.SKELETON, 12):
        s = prefix_trie.Skeleton.of(keys[::3], 20, most)
        assert len(s.parents) <= most or not s.splitters
        shards = [s.shard(*k) for k in keys]
        assert shards == sorted(shards)
        for path in {k[0][: prefix_trie.DIGEST * d] for k in keys for d in range(len(k[0]) // prefix_trie.DIGEST + 1)}:
            if len({n for n, k in zip(shards, keys) if k[0].startswith(path)}) > 1:
                node = 0
                for at in range(0, len(path), prefix_trie.DIGEST):
                    node = s.numbers[node, path[at : at + prefix_trie.DIGEST]]
