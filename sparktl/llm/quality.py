"""Quality rules: a threshold table compiled into one projection, with no user functions.

Every measure is an integer column made of built-in expressions, and each rule compares
``scale * measure`` with ``bound * base`` in integers, so any engine agrees on the verdict.

Defined results: a null or blank text has zero in every measure and fails ``n_words``; repeated
rows are judged one by one; columns of the input that clash with a measure are replaced in
``judged`` (the input's own columns are kept otherwise).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.llm.common import WORD, carried, quoted, restored, table, words

SYMBOLS = "#*$%&|<>"
#: Common function words of the languages in the corpus (lower case).
STOP_WORDS = (
    "the of and to in is it that for was with as on be are this by from at a an or not which have has "
    "der die das und ist im in den von zu mit sich auf für nicht ein eine des dem auch "
    "le la les de des du et est un une en que qui pour dans par au ne pas sur avec "
    "el la los las de del y es un una en que por para con se no lo su al"
)
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Reject where scale * measure > bound * base (or < with below) and base is at least least."""

    name: str
    measure: str
    scale: int
    bound: int
    base: str | None = None
    below: bool = False
    least: int = 0
    basic: bool = False


#: The threshold table. Rules marked basic make base_failed.
RULES = (
    Rule("too_few_words", "n_words", 1, 10, below=True, basic=True),
    Rule("repeated_windows", "n_repeat_words", 100, 20, "n_words", basic=True),
    Rule("symbols_per_word", "n_symbols", 100, 30, "n_words"),
    Rule("marks_per_word", "n_marks", 100, 60, "n_words"),
    Rule("long_words", "word_chars", 1, 40, "n_words"),
    Rule("short_words", "word_chars", 10, 15, "n_words", below=True),
    Rule("repeated_lines", "n_dup_lines", 100, 50, "n_lines", least=6),
    Rule("no_stop_words", "n_stop_words", 100, 2, "n_words", below=True, least=40),
)


def failed(rule: Rule) -> Column:
    left = F.col(rule.measure) * rule.scale
    right = F.lit(rule.bound) * (F.col(rule.base) if rule.base else 1)
    hit = left < right if rule.below else left > right
    return hit & (F.col(rule.base) >= rule.least) if rule.base and rule.least else hit


def measures(df: DataFrame) -> DataFrame:
    """df with its measures. Arrays are named once, so that each is computed once a row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, " \t\n\x0b\x0c\r", "")
    ws = F.col("_ws")
    one = df.withColumn("_ws", words(F.col("text"))).withColumns(
        {
            "word_chars": F.char_length(solid).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_marks": (F.char_length(text) - F.char_length(F.translate(text, "!?", ""))).cast("long"),
            "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
        }
    )
    starts = F.slice(ws, 1, F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0)))
    rest = lambda i: [F.get(ws, i + k) for k in range(1, WINDOW)]
    two = one.withColumns(
        {
            "n_words": F.size(ws).cast("long"),
            "n_stop_words": F.size(F.filter(ws, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS.split()))))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform(starts, lambda w, i: F.xxhash64(w, *rest(i))),
        }
    )
    # Hashes settle the usual case, no window twice; only other texts compare the windows themselves.
    clear = F.size(F.array_distinct("_hashes")) == F.size("_hashes")
    keyed = F.array_sort(F.transform(starts, lambda w, i: F.struct(F.concat_ws(" ", w, *rest(i)).alias("k"), i.alias("i"))))
    three = two.withColumn("_keyed", F.when(~clear, keyed))
    same = lambda x, i: F.coalesce(x["k"] == F.get(F.col("_keyed"), i)["k"], F.lit(False))
    places = F.array_sort(F.transform(F.filter(F.col("_keyed"), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    four = three.withColumn("_places", F.coalesce(places, F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform(F.col("_places"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return four.withColumn("n_repeat_words", covered).drop("_ws", "_lines", "_hashes", "_keyed", "_places")


def judged(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, one boolean for each rule (fails_<name>), base_failed and kept."""
    results = [*MEASURES, *[f"fails_{r.name}" for r in rules], "base_failed", "kept"]
    left = df.select(*[F.col(quoted(c)) for c in df.columns if c not in results])
    return _judged(carried(left, ["text"], without=["text"]), rules).select(*restored(left, text=F.col("text")), *results)


def _judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    out = measures(df).withColumns({f"fails_{r.name}": failed(r) for r in rules})
    some = lambda names: F.greatest(*[F.col(f"fails_{n}") for n in names], F.lit(False), F.lit(False))
    return out.withColumns({"base_failed": some([r.name for r in rules if r.basic]), "kept": ~some([r.name for r in rules])})


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_marks", "n_lines", "n_stop_words")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass every rule, with all their columns as they are.

    The row number keeps the optimizer from moving the filter below the measures, where it would
    repeat every one of them in the condition.
    """
    marked = _judged(carried(docs, ["text"], without=["text"]), RULES).withColumn("_row", F.monotonically_increasing_id())
    return marked.filter("kept AND _row >= 0").select(*restored(docs, text=F.col("text")))


def _sql_rule(r: Rule) -> str:
    hit = f"{r.scale} * {r.measure} {'<' if r.below else '>'} {r.bound}" + (f" * {r.base}" if r.base else "")
    return f"({hit} AND {r.base} >= {r.least})" if r.base and r.least else f"({hit})"


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    count = lambda chars: " + ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in chars)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
u AS (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
k AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k FROM u),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM k) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM t, range({WINDOW}) AS g(j) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        ({count(SYMBOLS)})::BIGINT AS n_symbols, ({count("!?")})::BIGINT AS n_marks,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len([x FOR x IN ws IF lower(x) IN ({stops})])::BIGINT AS n_stop_words,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_lines, n_stop_words,
  ({" OR ".join(_sql_rule(r) for r in RULES if r.basic)}) AS base_failed,
  NOT ({" OR ".join(_sql_rule(r) for r in RULES)}) AS kept FROM m"""
