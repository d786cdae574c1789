"""Corpus operators: SQL counterparts, brute force on small fixtures, and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktl.llm import bitplane, components, language, minhash, mixing, nearest, packing, quality, queries, secret_scan, tokens, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: nulls in every column, empty, blank, long and repeated texts, ties, odd white space
LONG = " ".join(f"w{k % 700}" for k in range(30_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", None, 5), (4, "one", "en", "a", 3), (5, "Two words", "de", "b", 9),
    (6, "the same text here " * 12, "en", "a", 228), (7, "the same text here " * 12, "en", "a", 228), (8, LONG, "fr", "b", len(LONG)),
    (9, "naïve café\u00a0ÉCOLE \u2003x", "fr", "b", 20), (10, "a\r\nb\x0bc\x0cd", "en", "a", 8), (None, "no id at all", "en", "a", 12), (11, "İstanbul ſ 日本語 😀", None, "c", 16),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumns({"size_": F.lit(1), "kept": F.lit("clash"), "bucket": F.lit("clash")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    ours, theirs = (x[order].sort_values([ours.columns[0], *order]).reset_index(drop=True) for x in (ours, theirs))
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        assert ((a == b) | (a.isna() & b.isna())).all(), c


@pytest.mark.parametrize("text", [t for _, t, *_ in ODD])
def test_quality_measures(spark, text):
    row = quality.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ws = WORD.findall(text or "")
    seen = {}
    for i in range(len(ws) - 4):
        seen.setdefault(tuple(ws[i : i + 5]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["n_dup_lines"]) == (len(ws), sum(map(len, ws)), len(covered), len(lines) - len(set(lines)))
    assert row["base_failed"] == (len(ws) < 10 or 100 * len(covered) > 20 * len(ws))


def test_secrets(spark):
    text = "password: hunter22 token=abc AKIA" + "Z9" * 8 + " é " + "0f" * 20 + " passwd='sésame' key Xq9Zt4Lm2Vb8Rk1Wp7Nd5Hs3 https://example.com/a-b-c-d"
    found = [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.spans(text)]
    assert ("assign", "password: hunter22") in found and ("access", "AKIA" + "Z9" * 8) in found and ("hex", "0f" * 20) in found
    assert ("random", "Xq9Zt4Lm2Vb8Rk1Wp7Nd5Hs3") in found and not any("abc AKIA" in s or "sésame" in s for _, s in found)
    assert not [k for k, _ in [(x, y) for x, y in found if x == "random"] if k == "hex"]
    assert secret_scan.redacted(text, secret_scan.spans(text)).count("[SECRET]") == 4
    assert secret_scan.redacted("clean", []) == "clean" and not secret_scan.spans("plain words, nothing more than that")
    # digests and identifiers are no random strings
    for x in (hashlib.sha256(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "some-long-slug-of-words-2024"):
        assert not secret_scan.is_random(x)


def test_tokens_agree_with_the_library():
    r = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "The", "fooBar,", "é", "ÀÿÞß", "'s", "12", "!!", "\xa0", "日本", "İx", "\x02", "µª", " a", " the", "word", "%%%"]
    for file, blanks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder, library = tokens.Encoder(file, blanks), tokens.tokenizer(file)
        for _ in range(1500):
            text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 7, 8, 4097, 1 << 16])
def test_bit_planes(n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype("<u4")
    assert (bitplane.unshuffled(bitplane.shuffled(ids), n) == ids).all()


def test_token_files(spark, odd):
    from sparktl.llm.common import new_path

    path = new_path(spark, "t")
    bitplane.write_tokens(spark, odd, path, "byte_bpe_50k.json", 0, True)
    rows = sorted(bitplane.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    library, start = tokens.tokenizer("byte_bpe_50k.json"), 0
    for row, (doc, text, *_) in zip(rows, sorted(ODD, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (row["doc_id"], row["start"], row["n_tokens"], bytes(row["ids"])) == (doc, start, len(ids) // 4, ids)
        start += len(ids) // 4
    empty = new_path(spark, "t")
    bitplane.write_tokens(spark, odd.limit(0), empty, "byte_bpe_50k.json", 0, True)
    assert bitplane.read_tokens(spark, empty).count() == 0


def packed_well(rows, size=4096):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark, odd, docs):
    out = packing.op5_packing(spark, SF).collect()
    total = sum(r["length"] for r in out)
    assert packed_well(out) <= -(-total // 4096) + 1
    library = tokens.tokenizer("word_bpe_49k.json")
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out}
    for doc, text in zip(docs.doc_id, docs.text):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            assert got.pop((doc, k)) == (at, len(part), zlib.crc32(part.tobytes()))
    assert not got
    assert packed_well(packing.packed_documents(spark, odd, SF).collect())
    assert packing.packed_documents(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_short(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 60) for _ in range(r.choice([5, 40, 400]))]
    histogram = {k: lengths.count(k) for k in set(lengths)}
    plan = packing.planned(dict(histogram), 60)
    used = {}
    for filling, times in plan:
        assert sum(k * n for k, n in filling) <= 60
        for k, n in filling:
            used[k] = used.get(k, 0) + n * times
    assert used == histogram
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(histogram, 60))


def test_mixing(spark, odd):
    sized = odd.withColumn("size", mixing.size_of(F.col("text")))
    rows = mixing.mix(sized).collect()
    assert len(rows) == len(ODD) and all(0 <= r["copies"] <= 2 for r in rows)
    goals = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in goals.values()) == pytest.approx(1.5 * sum(s for s, _ in goals.values()))
    assert all(t <= 2 * s for s, t in goals.values())
    assert mixing.mix(sized.limit(0)).count() == 0
    again = mixing.mix(sized).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_url_filters(spark):
    urls = ["http://a.net/", "http://a.net", "https://B.Example.NET/en/1", "http://x.example.com/de/5", "http://x.org/fr/2?q", "http://notnet/x", None, "", "no host", "http://u.org/a://b", "http://t.com/p/1", "http://t.com/p/1"]
    rows = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [rows[k]["rule"] for k in range(7)] == ["net/", None, "example.net/en/", "example.com/de/", "org/fr/", None, None]
    assert [rows[k]["verdict"] for k in (0, 2, 3, 4)] == ["block", "allow", "block", "allow"]
    assert (rows[2]["host"], rows[2]["path"]) == ("b.example.net", "/en/1") and (rows[8]["host"], rows[8]["path"]) == ("", "") and len(rows) == len(urls)
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute_groups(texts, k, percent=80):
    sets = {}
    for doc, text in texts.items():
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {d: root(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def varied(base, r, edits):
    ws = list(base)
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
    return " ".join(ws)


def test_near_duplicates(spark, monkeypatch):
    """Copies, a group larger than a region compared in full, chains of links, and unrelated texts."""
    r = random.Random(2)
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    texts = [varied(base, r, r.randrange(12)) for _ in range(150)] + [" ".join(base)] * 5
    chain = [f"c{k}" for k in range(120)]
    for k in range(6):
        texts.append(" ".join(chain))
        chain = chain[6:] + [f"n{k}_{j}" for j in range(6)]
    texts += [" ".join(f"u{r.randrange(10**6)}" for _ in range(80)) for _ in range(40)] + [None, "", "x", "x", "X y", "x Y"]
    rows = dict(enumerate(texts))
    for small, chunk in ((minhash.SMALL, minhash.CHUNK), (8, 64)):
        monkeypatch.setattr(minhash, "SMALL", small)
        monkeypatch.setattr(minhash, "CHUNK", chunk)
        out = minhash.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), k=2).collect()
        group, sizes = brute_groups(rows, 2)
        assert {x["doc_id"]: x["component_id"] for x in out} == group
        assert {x["doc_id"]: x["n_shingles"] for x in out} == sizes


def test_near_duplicates_edges(spark, odd):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r["doc_id"]: r["component_id"] for r in out}[7] == 6
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.distinct_documents(spark, odd.unionByName(odd), SF)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 6, 8, 9, 10, 11]


def test_near_duplicates_with_repeated_ids(spark):
    """Rows of one id: each text counts, whichever comes first, and texts alike to none are never lost."""
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:59], "other"])
    rows = [(1, " ".join(base)), (1, "something else altogether here today"), (2, near), (2, near), (2, "a third text with words of its own"), (3, "something else altogether here today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (2, 1), (2, 2), (3, 1)]
    kept = sorted(map(tuple, minhash.distinct_documents(spark, df, SF).collect()))
    assert kept == sorted({rows[0], rows[1], rows[4]})


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (105, 101), (7, 7), (101, 100)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 105: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 16)) * r.uniform(0.5, 2, (600, 1))
    x[100:300] = x[100]
    rows = [(k, [float(v) for v in x[k]]) for k in range(600)] + [(600, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    stored = x.astype(np.float32).astype(float)
    hits = exact = 0
    for q in range(0, 600, 20):
        mine = sorted((h["rank"], h["id"], h["score"]) for h in out if h["query_id"] == q)
        score = stored @ stored[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:20]
        assert [a for a, *_ in mine] == list(range(1, 21))
        assert [s for *_, s in mine] == pytest.approx([score[i] for _, i, _ in mine])
        hits += len({i for _, i, _ in mine} & set(best))
        exact += [i for _, i, _ in mine] == best.tolist()
    assert hits >= 0.95 * 600 and not {h["query_id"] for h in out} & {600, 620, 640, 660}
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.filter("vec_id < 3")
    assert sorted((h["query_id"], h["rank"]) for h in nearest.nearest(few, few).collect()) == [(q, k) for q in range(3) for k in (1, 2)]


def test_language(spark, odd, docs):
    held = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d in docs.doc_id])
    out = language.op9_language(spark, SF).toPandas().set_index("doc_id")
    assert (out.loc[docs.doc_id, "held_out"].to_numpy() == held).all() and out.score.between(0, 1).all()
    assert (out.loc[docs.doc_id[held], "lang_pred"].to_numpy() == docs.lang[held].to_numpy()).mean() > 0.95
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.predicted(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and len(got) == len(ODD)
    assert {r["lang_pred"] for r in language.predicted(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_code_lengths():
    """Against a plain walk through the contexts."""
    model = language.trained({"a": ["abracadabra"], "b": ["bonobo bonobo"]})
    text = b"abrabo zz"
    for tree, total in zip(model.trees, model.totals([text])[0]):
        code = language.codes(np.frombuffer(text, np.uint8), np.array([0]))
        bits = 0.0
        for c in code.tolist():
            for k in range(language.ORDER, -1, -1):
                gram = c & ((1 << 8 * (k + 1)) - 1)
                seen = dict(zip(tree.grams[k][0].tolist(), tree.grams[k][1].tolist()))
                here = {g: n for g, n in seen.items() if g >> 8 == gram >> 8}
                if not here:
                    continue
                n, q = sum(here.values()), len(here)
                if gram in here:
                    bits -= np.log2(here[gram] / (n + q))
                    break
                bits -= np.log2(q / (n + q))
            else:
                bits += 8
        assert total == pytest.approx(bits, rel=1e-12)


def test_code_lengths_of_a_full_cache(monkeypatch):
    r, text = random.Random(1), []
    model = language.trained({"a": ["abracadabra " * 9], "b": ["".join(r.choice("abcdé日本") for _ in range(400))]})
    text = [("".join(r.choice("abcdefé日本語 ") for _ in range(r.randrange(1, 90)))).encode() for _ in range(60)]
    whole = model.frozen().totals(text)
    monkeypatch.setattr(language, "CACHE", 40)
    monkeypatch.setattr(language, "PIECE", 200)
    assert (model.frozen().totals(text) == whole).all()


def test_training_rows_are_bounded(spark):
    rows = [(k % 3 + 1, f"text number {k}", "en" if k % 10 else "de", 0, "x") for k in range(2000)]
    df = spark.createDataFrame(rows, COLUMNS.replace("source string, n_chars long", "n_chars long, source string")).unionByName(spark.createDataFrame(rows, COLUMNS.replace("source string, n_chars long", "n_chars long, source string")))
    some = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    got = language.few_of_each(some, "lang", "_hash", 20).collect()
    assert {x: sum(r["lang"] == x for r in got) for x in ("en", "de")} == {"en": 20, "de": 20} and len({r["text"] for r in got}) == 40


def plain_logit(net, vectors):
    """The network on one window, word by word and unit by unit."""
    h, sig = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    states = [[0.0] * (2 * h) for _ in vectors]
    for d, order in (("f", range(len(vectors))), ("b", range(len(vectors) - 1, -1, -1))):
        a, u, bias, s = (net.p[f"{d}_in"].astype(float), net.p[f"{d}_state"].astype(float), net.p[f"{d}_bias"].astype(float), [0.0] * h)
        for t in order:
            pre = [sum(vectors[t][i] * a[i, j] for i in range(len(vectors[t]))) + bias[j] for j in range(3 * h)]
            z = [sig(pre[j] + sum(s[i] * u[i, j] for i in range(h))) for j in range(h)]
            r = [sig(pre[h + j] + sum(s[i] * u[i, h + j] for i in range(h))) for j in range(h)]
            c = [np.tanh(pre[2 * h + j] + sum(r[i] * s[i] * u[i, 2 * h + j] for i in range(h))) for j in range(h)]
            s = [s[j] + z[j] * (c[j] - s[j]) for j in range(h)]
            for j in range(h):
                states[t][(h if d == "b" else 0) + j] = s[j]
    weight = [np.exp(sum(np.tanh(v) * q for v, q in zip(state, net.p["query"]))) for state in states]
    pooled = [sum(w * state[j] for w, state in zip(weight, states)) / sum(weight) for j in range(2 * h)]
    return sum(v * o for v, o in zip(pooled, net.p["out"])) + net.p["bias"][0]


def test_toxicity_against_a_plain_network():
    """Scores of whole texts: the best of the windows, each worked out word by word."""
    r = random.Random(3)
    net = toxicity.Network.new(np.random.default_rng(3).normal(0, 1, toxicity.WORDS).astype(np.float32), np.ones(toxicity.WORDS, np.float32))
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(count)) for count in (1, 5, 40, 0, toxicity.WINDOW, toxicity.WINDOW - 1, toxicity.WINDOW + 1, 25)]
    want = []
    for text in texts:
        ws = text.split()
        vectors = net.inputs([toxicity.plain(w) for w in ws])[:-1].astype(float).tolist() if ws else []
        starts = range(max(1, len(ws) - toxicity.WINDOW + 1))
        want.append(max(plain_logit(net, vectors[a : a + toxicity.WINDOW]) for a in starts) if ws else None)
    got = [toxicity.Scorer(net).scores(texts), [toxicity.Scorer(net).scores([t])[0] for t in texts]]
    for one in got:
        for score, logit in zip(one, want):
            assert score < 0.7 if logit is None else score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def test_conflicting_labels_and_repeated_ids(spark):
    rows = [(k, f"{'vile' if k % 2 else 'fine'} words {k}") for k in range(60)]
    docs = spark.createDataFrame(rows + rows + [(5, "another text of the same id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    seen = []
    toxicity_trained, toxicity.trained = toxicity.trained, lambda texts, y, **_: seen.append((texts, y.tolist()))
    try:
        toxicity.fit(docs, labels)
        toxicity.fit(docs, labels, per_class=10)
    finally:
        toxicity.trained = toxicity_trained
    assert [len(t) for t, _ in seen] == [59, 20] and sum(seen[0][1]) == 29 and sum(seen[1][1]) == 10


def test_toxicity_learns(spark, odd):
    r = random.Random(0)
    plain = [f"w{k}" for k in range(1500)]
    texts, labels = [], []
    for k in range(240):
        ws = [r.choice(plain) for _ in range(r.randrange(5, 90))]
        if k % 4 == 0:
            ws[r.randrange(len(ws))] = r.choice(["Vile,", "rotten", "BEASTLY!"])
        texts.append(" ".join(ws))
        labels.append(int(k % 4 == 0))
    net = toxicity.trained(texts[:160], np.array(labels[:160]))
    scorer, y = toxicity.Scorer(net), np.array(labels[160:])
    score = scorer.scores(texts[160:])
    assert (score[y == 1, None] > score[None, y == 0]).mean() > 0.95
    # one text or many, the score is the same; a toxic word in the last window counts
    assert scorer.scores([texts[200]])[0] == pytest.approx(score[40], abs=1e-5)
    rows = toxicity.scored(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in rows)
    assert {x["score"] for x in toxicity.scored(odd, None).collect()} == {0.0}


def test_toxicity_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Network.new(np.zeros(toxicity.WORDS), np.ones(toxicity.WORDS))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = r.normal(0, 1, (20, 1 + toxicity.VECTOR + toxicity.LETTERS))
    x[-1] = 0
    steps, y = r.integers(0, 19, (6, toxicity.WINDOW)), np.array([0, 1, 1, 0, 1, 0.0])
    steps[2, 9:] = -1
    g, dx, _ = net.gradients(x, steps, y)
    for k, d in (*g.items(), ("x", dx)):
        v = x if k == "x" else net.p[k]
        at, e = tuple(r.integers(0, n - (k == "x" and i == 0)) for i, n in enumerate(v.shape)), 1e-3
        old, loss = v[at], []
        for step in (e, -e):
            v[at] = old + step
            loss.append(net.gradients(x, steps, y)[2])
        v[at] = old
        assert (loss[0] - loss[1]) / (2 * e) == pytest.approx(d[at], rel=2e-2, abs=1e-5), k


def test_pipeline(spark, odd):
    import corpus_pipeline

    clashes = "kept n_words _ws secret_spans rank bucket source_key offset _copy target size copies step before component h n ids a.b".split()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.select(*names).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(*names).filter("doc_id > 11 AND doc_id < 60"))
    docs = docs.select(*names, *[F.lit(f"own {c}").alias(c) for c in clashes])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert rows and all(r[c] == f"own {c}" for r in rows for c in clashes), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    whole = corpus_pipeline.run(spark, SF).collect()
    assert packed_well(whole) > 0
    kept = {r["doc_id"] for r in quality.kept_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert {r["doc_id"] for r in whole} <= kept
