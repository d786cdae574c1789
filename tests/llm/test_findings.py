"""Cases of the review's findings: each failed before the change that its finding led to."""

import base64
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktl.llm import minhash, nearest, packing, secret_scan, url_filter

LOWER_DIGITS = string.ascii_lowercase + string.digits


@pytest.mark.parametrize(
    ("letters", "length", "share"),
    [(LOWER_DIGITS, 20, 0.95), (LOWER_DIGITS, 32, 0.98), (LOWER_DIGITS, 12, 0.9), (LOWER_DIGITS, 8, 0.75), (string.ascii_uppercase + "234567", 24, 0.98), (string.ascii_uppercase + "234567", 12, 0.8)],
)
def test_random_strings_of_one_case(letters, length, share):
    r = random.Random(5)
    keys = ["".join(r.choice(letters) for _ in range(length)) for _ in range(300)]
    found = [any(k == 3 for _, k, _ in secret_scan.spans(f"the key is {key} here")) for key in keys]
    assert sum(found) >= share * len(keys)


def test_words_and_identifiers_are_not_random():
    r = random.Random(6)
    key = base64.b32encode(bytes(r.randrange(256) for _ in range(20))).decode().lower()
    assert secret_scan.redacted(f"before {key} after", secret_scan.spans(f"before {key} after")) == "before [SECRET] after"
    plain = "internationalisation Donaudampfschifffahrtsgesellschaft anticonstitutionnellement 2024-01-05 some-long-slug 1234567890 ==================== -=-=-=-=-=-=-=-=-=-= README_FILE https://example.com/en/news/2024 STRENGTHS rhythms"
    assert not secret_scan.spans(plain)


def url_verdicts(spark, urls, rules=url_filter.RULES):
    """(verdict, template, purity) by url."""
    rows = url_filter.judged(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    return {r["url"]: (r["verdict"], r["template"], r["purity"]) for r in rows}


def test_unlabelled_branches_stay_out_of_wildcards(spark):
    others = ["en", "fr", "es", "it", "nl", "pt", "sv", "fi", "da"]
    urls = [f"http://x.example.com/de/{k}" for k in range(100)] + [f"http://x.example.com/{o}/{k}" for o in others for k in range(3)]
    got = url_verdicts(spark, urls)
    assert all(got[u][0] == ("block" if "/de/" in u else "allow") for u in urls)
    assert all(got[f"http://x.example.com/{o}/1"][2] == pytest.approx(0.2) for o in others)


def test_alike_branches_merge_in_groups(spark):
    """Twenty clean, twenty blocked branches and one without labels: two wildcards, and one on its own."""
    rules, urls = [], []
    for k in range(41):
        name = "".join(chr(97 + int(d)) for d in f"{k:02}")
        urls += [f"http://h.org/{name}/{j}" for j in range(30)]
        if k < 40:
            rules.append(url_filter.Rule("block" if k < 20 else "allow", "h.org", f"/{name}/1"))
    got = url_verdicts(spark, urls, tuple(rules))
    first = {}
    for u, (_, template, _) in got.items():
        first.setdefault(template.split("/")[1], set()).add(u.split("/")[3])
    assert sorted(map(len, first.values())) == [1, 20, 20]
    assert {got[u][0] for u in urls if u.split("/")[3] == "ae"} == {"block"} and got["http://h.org/ea/5"] == ("allow", "/ea/*", pytest.approx(0.2))


def test_deep_paths(spark):
    """A blocked and a clean template that part at the fifth segment, below a wildcard of merged branches."""
    names = ["".join(chr(97 + int(d)) for d in f"{k:02}") for k in range(20)]
    urls, rules = [], []
    for k, n in enumerate(names):
        for last in ("ads", "news"):
            urls += [f"http://d.org/a/b/{n}/c/{last}/{j}" for j in (100, 101, 102, 103, 200)]
            rules.append(url_filter.Rule("block" if last == "ads" else "allow", "d.org", f"/a/b/{n}/c/{last}/1"))
    urls.append("http://d.org/" + "/".join(["x"] * 300))
    got = url_verdicts(spark, urls, tuple(rules))
    one = {u: v for u, (v, _, _) in got.items() if u.endswith("/200")}
    assert len(one) == 40 and all(v == ("block" if "/ads/" in u else "allow") for u, v in one.items())
    assert {t for u, (_, t, _) in got.items() if u.endswith("/200")} == {"/a/b/*~/c/ads/*", "/a/b/*~/c/news/*"}
    assert got[urls[-1]][:2] == ("allow", "/" + "/".join(["x"] * 300))


def test_clashing_columns_are_kept(spark):
    df = spark.createDataFrame([("http://x.net/a", "own")], "url string, prefix string").withColumns({c: F.lit("own") for c in ("parts", "segment", "s1", "first", "domain", "n", "b", "go")})
    row = url_filter.judged(df).first()
    assert all(row[c] == "own" for c in df.columns if c != "url") and row["verdict"] == "block"


def test_truly_alike_branches_merge(spark):
    r = random.Random(3)
    rows = [(h, sum(r.random() < p for _ in range(n)), n) for h in range(100) for p in [r.uniform(0.2, 0.8)] for n in [r.randrange(5, 60)] for _ in range(50)]
    branches = spark.createDataFrame(rows, "host int, b int, n int")
    found = branches.join(url_filter.alike(branches, ["host"]), ["host", "n", "b"]).groupBy("host", "wild").count().collect()
    assert sum(x["count"] == 50 for x in found) >= 95


def test_long_plans_branch_too():
    """Plans of well over 200 steps."""
    for size, m, draw, most in ((600, 20_000, lambda r: int(r.lognormvariate(6.5, 1)), 15_793), (4096, 3_000, lambda r: r.randint(1024, 2048), 1_199)):
        r, histogram = random.Random(1), {}
        for _ in range(m):
            k = max(1, min(draw(r), size))
            histogram[k] = histogram.get(k, 0) + 1
        plan, used = packing.planned(dict(histogram), size), {}
        for filling, times in plan:
            assert sum(k * n for k, n in filling) <= size
            for k, n in filling:
                used[k] = used.get(k, 0) + n * times
        assert used == histogram and sum(n for _, n in plan) <= most


def fewest(lengths, size):
    """The fewest sequences, exactly: of each subset of the pieces the fewest, and then the least filled last one."""
    best = [(0, size)]
    for subset in range(1, 1 << len(lengths)):
        steps = ((best[subset ^ (1 << i)], k) for i, k in enumerate(lengths) if subset >> i & 1)
        best.append(min((n, full + k) if full + k <= size else (n + 1, k) for (n, full), k in steps))
    return best[-1][0]


def test_packing_against_an_exact_solver():
    """Mixed cases are packed as well as can be; of hard ones a plan is hardly ever one sequence over, and never two."""
    over = {"mixed": [], "hard": [], "hard, best fit": []}
    for seed in range(60):
        r = random.Random(seed)
        size = r.choice([60, 100, 1000])
        n, low, high = r.randint(8, 12), r.choice([1, size // 6, size // 4]), r.choice([size // 2, size * 2 // 3, size])
        for kind, lengths in (("mixed", [r.randint(low, high) for _ in range(n)]), ("hard", [r.randint(size // 8, size * 6 // 10) for _ in range(12)])):
            histogram = {k: lengths.count(k) for k in set(lengths)}
            count = lambda plan: sum(times for _, times in plan) - fewest(lengths, size)  # noqa: B023, E731
            over[kind].append(count(packing.planned(dict(histogram), size)))
            if kind == "hard":
                over["hard, best fit"].append(count(packing.best_fit(histogram, size)))
    assert set(over["mixed"]) == {0}
    assert set(over["hard"]) <= {0, 1} and sum(over["hard"]) <= 2 and 2 * sum(over["hard"]) < sum(over["hard, best fit"])


def test_repeated_rows_do_not_push_ids_out(spark):
    rows = [(1, [1.0, 2.0])] * 60 + [(k, [1.0, 2.0]) for k in range(2, 31)] + [(k, [-1.0, float(k)]) for k in range(40, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = nearest.nearest(df, df.filter("vec_id = 5"), k=3).collect()
    top = sorted((r["rank"], r["id"]) for r in out)
    assert [i for _, i in top] == [49, 48, 47]
    out = nearest.nearest(df.filter("vec_id < 40"), df.filter("vec_id = 5"), k=20).collect()
    assert [i for _, i in sorted((r["rank"], r["id"]) for r in out)] == [k for k in range(1, 22) if k != 5]


def plain_base(text):
    """The base spans of op2 by a plain scan from left to right, without regular expressions."""
    names, value = ("password", "passwd", "secret", "token", "api_key", "apikey"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lower, found, i = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), [], 0
    while i < len(text):
        name = next((n for n in names if lower.startswith(n, i)), None)
        j = i + len(name or "")
        ok = name is not None
        if ok:
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            while text[j : j + 1] == " ":
                j += 1
            ok = text[j : j + 1] in (":", "=") and j < len(text)
        if ok:
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
            k = j
            while k < len(text) and text[k] in value:
                k += 1
            ok = k > j
        if not ok:
            i += 1
            continue
        if k - j >= 6:
            found.append((i, 0, k))
        i = k
    for kind, begin, chars, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            k = i + len(begin)
            while text.startswith(begin, i) and k < len(text) and text[k] in chars:
                k += 1
            if text.startswith(begin, i) and k > i + len(begin):
                found += [(i, kind, k)] * (k - i >= least)
                i = k
            else:
                i += 1
    return sorted(found)


def test_base_secrets_against_a_plain_scan(spark):
    import hashlib
    import random

    from sparktl.llm import secret_scan

    r = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", ":", "=", " ", "'", '"', "AKIA", "Z9X8", "0f3a", "abc.def", "é", "\n", "-", "K" * 20, "a1" * 13, "ſecret", "x"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    for text in texts:
        assert [s for s in secret_scan.spans(text) if s[1] < 3] == plain_base(text), text
    # the query's columns, for repeated rows, null ids and null texts too
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts[:40])] + [(1, texts[1])] * 2 + [(99, None), (100, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    from unittest import mock

    with mock.patch.object(secret_scan, "table", lambda *_: docs):
        out = secret_scan.op2_secret_scans(spark, "").collect()
    want = sorted((i, ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in plain_base(t or ""))) for i, t in [((x[0] is not None, x[0] or 0), x[1]) for x in rows])
    assert sorted(((v["doc_id"] is not None, v["doc_id"] or 0), v["base_sha256"]) for v in out) == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want)


def test_random_strings_of_letters_and_in_halves():
    import random
    import string

    from sparktl.llm import secret_scan

    r = random.Random(1)
    share = lambda make: sum(secret_scan.is_random(make()) for _ in range(300)) / 300
    drawn = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    assert share(lambda: drawn(string.ascii_letters, 8)) > 0.85 and share(lambda: drawn(string.ascii_letters, 12)) > 0.95
    assert share(lambda: drawn(string.ascii_lowercase, 20)) > 0.85 and share(lambda: drawn(string.ascii_lowercase + string.digits, 12)) > 0.85
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        assert share(lambda: f"{drawn(letters, 12)}-{drawn(letters, 12)}") > 0.4
    plain = "getUserName XMLHttpRequest MERCHANTABILITY some-long-slug-of-words-2024 understand-recommendation parseHTMLDocument ArrayIndexOutOfBoundsException quick-brown-fox-jumps-over-lazy-dog LICENSE-APACHE-VERSION 2024-11-28".split()
    assert not [w for w in plain if secret_scan.is_random(w)]


def test_a_cluster_names_its_folder():
    from types import SimpleNamespace

    from sparktl.llm import common

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert common.shared_dir(session("local[4]")).startswith("file://")


def test_long_sets_cross_in_short_rows(spark, monkeypatch):
    """A set of any size crosses to Python in short rows, and its signature and fingerprint are those of the whole."""
    long = [f"w{k}" for k in range(5000)]
    rows = [(1, " ".join(long)), (2, None), (3, "a b c"), (4, " ".join(long[::-1])), (None, " ".join(long[:129])), (6, " ".join(long[:130])), (7, "")]
    sets = minhash.with_shingles(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("h", F.xxhash64("text")), 2).select("doc_id", "h", "shingles")
    widest, plain = [], type(sets).mapInArrow

    def watched(df, *args):
        widest.append(df.select(F.max(F.size("shingles"))).first()[0])
        return plain(df, *args)

    monkeypatch.setattr(type(sets), "mapInArrow", watched)
    want = {(r["doc_id"], r["h"]): np.array(r["shingles"], "<i8").view(np.uint64) for r in sets.collect()}
    for records in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = minhash.signed(sets).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(rows) and {(r["doc_id"], r["h"]) for r in got} == set(want)
        for r in got:
            flat = want[r["doc_id"], r["h"]]
            mixed = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            low = (mixed >> np.uint64(32)).astype(np.uint32)
            least = (low[:, None] * minhash.FACTORS + minhash.SHIFTS).min(axis=0) if len(flat) else np.zeros(minhash.HASHES, "<u4")
            assert r["n"] == len(flat) and bytes(r["signature"]) == least.astype("<u4").tobytes()
            assert (r["f1"], r["f2"]) == tuple(int(x.view("<i8")) for x in (flat.sum(dtype=np.uint64), (mixed ^ (mixed >> np.uint64(29))).sum(dtype=np.uint64)))
    assert max(widest) <= 1000
