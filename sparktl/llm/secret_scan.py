"""Secret scans: three fixed patterns plus a token-efficiency test under a tiktoken vocabulary.

Random strings split into many short tokens. A candidate is a run of SHORT or more characters of
``[A-Za-z0-9+/_=-]``; known digests (whole runs of 32, 40, 56, 64, 96 or 128 hexadecimal digits), UUIDs
and hyphen- or slash-separated identifiers of words and numbers are left out, unless the letters of the words are LONG or more
and themselves split into tokens as no words do; what is left is a finding when it has fewer than MAX_RATIO characters a
token. Runs under LONG characters are held to a stricter ratio, the strictest where they are letters in the case of a word,
as rare words are short runs of letters.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; texts
are scanned whole, however long; repeated rows are scanned one by one; other columns are kept as they
are, but for one named secret_spans, which scan() replaces (the pipeline's stage keeps that one too).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.llm.common import carried, held, restored, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORT, LONG = 8, 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT},}}")
UUID = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
ONLY_HEX = re.compile(r"[0-9a-fA-F]+")
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
MAX_RATIO = 2.0
#: The share of MAX_RATIO from which the parts of a slug are words.
WORDS = 0.85
VOCABULARY = "byte_bpe_50k.tiktoken"


def encoding(vocabulary: str):
    def make():
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return held((vocabulary, "tiktoken"), make)


def is_identifier(run: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> bool:
    """Digests, UUIDs, paths or slugs whose parts are words (by case, and by their tokens where they are long) or numbers, and runs of signs alone."""
    if UUID.fullmatch(run) or (ONLY_HEX.fullmatch(run) and len(run) in DIGESTS):
        return True
    parts = [p for p in re.split(r"[-/_=+]", run) if p]
    if len(parts) == 1 or not all(p.isdigit() or (p.isalpha() and cased(p)) for p in parts):
        return False
    words = [p for p in parts if p.isalpha()]
    letters = sum(map(len, words))
    return letters < LONG or letters >= WORDS * max_ratio * sum(len(encoding(vocabulary).encode_ordinary(p)) for p in words)


def cased(run: str) -> bool:
    return run.islower() or run.istitle() or run.isupper()


def ratio_limit(run: str, max_ratio: float = MAX_RATIO) -> float:
    """The characters a token that a run must stay under: max_ratio from LONG characters on, less for shorter runs."""
    if len(run) >= LONG:
        return max_ratio
    letters = run.isalpha()
    if letters and not cased(run):
        return 0.95 * max_ratio
    if not letters and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
        return 0.9 * max_ratio
    return (0.5 + len(run) / 64) * max_ratio


def is_random(run: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> bool:
    if len(run) < SHORT or is_identifier(run, vocabulary, max_ratio):
        return False
    return len(run) < ratio_limit(run, max_ratio) * len(encoding(vocabulary).encode_ordinary(run))


#: Short runs are mostly words that come again.
short_is_random = lru_cache(maxsize=1 << 16)(is_random)


def spans(text: str, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for m in CANDIDATE.finditer(text):
        # Every run of 24 hexadecimal digits lies in a candidate.
        found += [(m.start() + h.start(), 2, m.start() + h.end()) for h in HEX.finditer(m[0])]
        if (is_random if m.end() - m.start() >= LONG else short_is_random)(m[0], vocabulary, max_ratio):
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each group of overlapping spans replaced by one mask."""
    out, at, open_to = [], 0, -1
    for a, _, b in found:
        if a >= open_to:
            if open_to >= 0:
                at = open_to
            out += [text[at:a], mask]
            open_to = b
        else:
            open_to = max(open_to, b)
    out.append(text[max(at, open_to, 0):] if found else text)
    return "".join(out)


def scan(df: DataFrame, mask: bool = False, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """df's columns with ``secret_spans`` array<struct<start, kind, end>>; with mask, text has its spans replaced.

    The text goes to Python in Arrow batches; nothing is shuffled.
    """
    kind = "array<struct<start:int,kind:string,end:int>>"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [spans(t, vocabulary, max_ratio) if t else [] for t in texts]
            columns = batch.columns
            if mask:
                columns[at] = pa.array([redacted(t, f) if f else t for t, f in zip(texts, found)], batch.column(at).type)
            rows = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], [*batch.schema.names, "secret_spans"])

    kept = df.drop("secret_spans")
    at = kept.columns.index("text")
    return kept.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}, secret_spans {kind}")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long")
    text = lambda only: F.array_join(
        F.transform(F.filter("secret_spans", lambda x: x["kind"].isin(*only)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text(KINDS[:3]), 256).alias("base_sha256"), text(KINDS).alias("spans"), count("random").alias("n_random"),
    )


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked and n_chars follows. Other columns stay as they are."""
    out = scan(carried(docs, ["text"], without=["text"]), mask=True)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        old = F.col(f"_carried_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return out.select(*restored(docs, **new))
