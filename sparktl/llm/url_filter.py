"""URL filters: domain rules first, then a tree of path templates, with DataFrame functions alone.

The tree is a table. Every url is a host and all segments of its path, and each node is a host and a
prefix of segments:

* Generalising: segments that vary by their look (numbers, long digit or hexadecimal runs, dates,
  ids with digits, file names with a number) become wildcards that keep the extension.
* Merging: under one host and prefix, labelled branches that are statistically alike share a wildcard.
  They start as one group; a branch whose block rate differs from that of the rest of its group leaves
  it, downwards or upwards. A group without such a branch that varies more than chance allows is split
  at its rate. The parts are tested again until all are alike, and groups of at least MANY branches are
  merged. The bound is Z standard errors for one branch and grows with the number of branches tested.
  A branch without labels keeps its own template.
* Labels are the urls that a rule decides. A template's purity is its share of blocked labels, smoothed
  towards its host, the host's towards its registered domain and language-like first segment, and
  that towards the prior; templates above REJECT are blocked.

Hot hosts: counts are partial sums before any shuffle, and the verdicts are joined back on (host,
template), a join whose large partitions Spark splits (adaptive skew join).

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the
verdict of the method for the host "" (allow, without labels); repeated rows are judged one by one;
paths are taken whole, however deep; extra columns are kept by ``judged`` unless a result has their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.llm.common import LOWER, UPPER, carried, quoted, restored, table, written

MANY = 8
Z = 2.0
WEIGHT = 4.0
PRIOR = 0.2
REJECT = 0.5


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The longest rule that fits a url wins.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def by_rule(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df (with url) and host, path, rule and rule_verdict."""
    ordered = sorted(rules, key=lambda r: -len(r.name))
    pick = lambda what: F.coalesce(*[F.when(fits(r), what(r)) for r in ordered])
    return df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": pick(lambda r: F.lit(r.name)), "rule_verdict": pick(lambda r: F.lit(r.verdict))})


def generalised(segment: Column) -> Column:
    """A segment, or a wildcard where it varies by its look."""
    stem, kind = F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 1), F.regexp_extract(segment, r"^(.*?)(\.[A-Za-z]{2,5})?$", 2)
    varies = stem.rlike(r"^\d+$") | stem.rlike(r"^[0-9A-Fa-f-]{12,}$") | stem.rlike(r"\d{3,}") | (F.length(stem) > 24) | stem.rlike(r"^\d+[-_.]\d+")
    return F.when(varies, F.concat(F.lit("*"), F.lower(kind))).otherwise(segment)


def segmented(df: DataFrame) -> DataFrame:
    """df (with path) and parts, the generalised segments of the whole path."""
    return df.withColumn("parts", F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), generalised))


def leaves(pages: DataFrame) -> DataFrame:
    """Counts by (host, parts): urls, labelled, blocked. pages: with host, parts and rule_verdict."""
    labelled, blocked = F.col("rule_verdict").isNotNull(), F.col("rule_verdict") == "block"
    return pages.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("urls"), F.sum(labelled.cast("long")).alias("labelled"), F.sum(F.coalesce(blocked, F.lit(False)).cast("long")).alias("blocked")
    )


def alike(branches: DataFrame, done: list[str]) -> DataFrame:
    """(*done, n, b, wild): the wildcard of the branches with n labels, b of them blocked; only where merged.

    branches: *done, n, b. The test depends on n and b alone, so it works on one row for each pair of them,
    however many branches a parent has. Each round splits groups, and the last one splits none.
    """
    pairs = branches.filter("n > 0").groupBy(*done, "n", "b").agg(F.count(F.lit(1)).alias("same")).withColumn("g", F.lit(""))
    n, b, gn, gb, m, same = map(F.col, ("n", "b", "gn", "gb", "m", "same"))
    rate = (gb + PRIOR * WEIGHT) / (gn + WEIGHT)
    noise = rate * (1 - rate)
    # a normal tail shrinks by the factor m where the square of the bound grows by 2 ln m
    bound = F.sqrt(Z * Z + 2 * F.log("m"))
    apart, least = b - n * (gb - b) / (gn - n), bound * F.sqrt(n * noise * (1 + n / (gn - n))) + 0.5
    side = F.when(apart > least, "+").when(apart < -least, "-").otherwise("=")
    # Pearson's statistic and the variance of its terms under one rate
    square, spread = (b - n * rate) * (b - n * rate) / (n * noise), 2 + (1 / noise - 6) / n
    varies = (F.max((F.col("side") != "=").cast("int")) == 0) & (F.sum(square * same) - F.max("m") + 1 > F.max(bound) * F.sqrt(F.sum(spread * same)))
    while True:
        groups = pairs.groupBy(*done, "g").agg(F.sum("same").alias("m"), F.sum(n * same).alias("gn"), F.sum(b * same).alias("gb"))
        tested = written(pairs.join(groups.filter(m >= MANY), [*done, "g"]).withColumn("side", side), "url-alike")
        tested = tested.join(tested.groupBy(*done, "g").agg(varies.alias("varies")), [*done, "g"])
        split = F.when(~F.col("varies"), F.col("side")).when(b * gn < n * gb, "-").otherwise("+")
        pairs = written(tested.select(*done, "n", "b", "same", F.concat("g", split).alias("g")), "url-alike")
        if pairs.filter(~F.col("g").endswith("=")).isEmpty():
            return pairs.select(*done, "n", "b", F.concat(F.lit("*~"), F.regexp_replace("g", "=+$", "")).alias("wild"))


def merged(tree: DataFrame) -> DataFrame:
    """tree with each path's template: alike branches of one parent share a wildcard.

    Level by level from the root, however deep the paths are. Under a prefix with fewer than MANY labelled
    paths nothing can merge: these leave the loop with the rest of their segments as they are. The tree
    has one row for each distinct path and is written after each level, so that plans stay small.
    """
    level, done = 0, []

    def parted(rows: DataFrame) -> DataFrame:
        """rows, with go: whether the level below their prefix may merge."""
        below = rows.filter(F.size("parts") > level)
        many = below.filter("labelled > 0").groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MANY).select("host", "prefix", F.lit(True).alias("go"))
        return written(rows.join(many, ["host", "prefix"], "left").withColumn("go", F.coalesce(F.col("go") & (F.size("parts") > level), F.lit(False))), "url-tree")

    rows = parted(tree.withColumn("prefix", F.lit("")))
    while True:
        rest = F.slice("parts", level + 1, F.greatest(F.size("parts") - level, F.lit(0)))
        template = F.concat_ws("/", F.col("prefix"), rest)
        done.append(rows.filter(~F.col("go")).select("host", "parts", "labelled", "blocked", template.alias("template")))
        rows = rows.filter("go").drop("go")
        if rows.isEmpty():
            break
        rows = rows.withColumn("segment", F.get("parts", F.lit(level)))
        branches = rows.groupBy("host", "prefix", "segment").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b"))
        wild = branches.join(alike(branches, ["host", "prefix"]), ["host", "prefix", "n", "b"]).select("host", "prefix", "segment", "wild")
        rows = rows.join(wild, ["host", "prefix", "segment"], "left").withColumn("prefix", F.concat_ws("/", "prefix", F.coalesce("wild", "segment"))).drop("wild", "segment")
        level += 1
        rows = parted(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def purities(tree: DataFrame) -> DataFrame:
    """(host, parts, template, purity): the smoothed purity of each path's template."""
    tree = tree.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "first": F.regexp_extract("template", r"(?s)^/([^/]*)", 1)})
    total = lambda keys, to: tree.groupBy(*keys).agg(F.sum("labelled").alias(f"n{to}"), F.sum("blocked").alias(f"b{to}"))
    smooth = lambda to, towards: (F.col(f"b{to}") + WEIGHT * towards) / (F.col(f"n{to}") + WEIGHT)
    out = tree.join(total(["domain", "first"], 1), ["domain", "first"]).join(total(["host", "first"], 2), ["host", "first"]).join(total(["host", "template"], 3), ["host", "template"])
    return out.select("host", "parts", "template", smooth(3, smooth(2, smooth(1, F.lit(PRIOR)))).alias("purity"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """pages (with url) and host, path, rule, template, purity and verdict."""
    results = ["host", "path", "rule", "template", "purity", "verdict"]
    left = pages.select(*[F.col(quoted(c)) for c in pages.columns if c not in results])
    ruled = segmented(by_rule(carried(left, ["url"], without=["url"]), rules))
    found = written(purities(merged(leaves(ruled))), "url-purities")
    method = F.when(F.col("purity") > REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = ruled.join(found, ["host", "parts"]).withColumn("verdict", F.coalesce("rule_verdict", method))
    return out.select(*restored(left, url=F.col("url")), *results)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def oracle() -> str:
    """Without merging, which SQL cannot express: no parent in the given tables has MANY labelled branches."""
    stem = r"'^(.*?)(\.[A-Za-z]{2,5})?$'"
    s, e = f"regexp_extract(x, {stem}, 1, 's')", f"regexp_extract(x, {stem}, 2, 's')"
    looks = " OR ".join(f"regexp_matches({s}, '{p}')" for p in (r"^\d+$", r"^[0-9A-Fa-f-]{12,}$", r"\d{3,}", r"^\d+[-_.]\d+"))
    general = f"CASE WHEN {looks} OR length({s}) > 24 THEN '*' || lower({e}) ELSE x END"
    rules = sorted(RULES, key=lambda r: -len(r.name))
    fit = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in rules]
    case = lambda what: "CASE " + " ".join(f"WHEN {f} THEN '{what(r)}'" for f, r in zip(fit, rules)) + " END"
    smooth = lambda to, towards: f"((b{to} + {WEIGHT}::DOUBLE * {towards}) / (n{to} + {WEIGHT}::DOUBLE))"
    totals = ", ".join(f"count(rv) OVER (PARTITION BY {keys}) AS n{to}, count(CASE WHEN rv = 'block' THEN 1 END) OVER (PARTITION BY {keys}) AS b{to}" for to, keys in ((1, "domain, first"), (2, "host, first"), (3, "host, template")))
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
g AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS rv, [{general} FOR x IN string_split(path, '/') IF x <> ''] AS parts FROM u),
t AS (SELECT *, CASE WHEN len(parts) > 0 THEN '/' || array_to_string(parts, '/') ELSE '' END AS template, coalesce(parts[1], '') AS first, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain FROM g),
q AS (SELECT *, {totals} FROM t),
f AS (SELECT *, {smooth(3, smooth(2, smooth(1, PRIOR)))} AS purity FROM q)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, purity FROM f"""
