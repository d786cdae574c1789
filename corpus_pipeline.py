"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``; the last returns one row for each packed piece.

Defined results: as in the operators' own modules; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktl.llm.common import table, written
from sparktl.llm.minhash import distinct_documents
from sparktl.llm.mixing import mixed_documents
from sparktl.llm.packing import packed_documents
from sparktl.llm.quality import kept_documents
from sparktl.llm.secret_scan import masked_documents

STAGES = [
    ("quality_rules", kept_documents),
    ("minhash_dedup", distinct_documents),
    ("secret_scans", masked_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

#: The last stage's rows come from a tokenizer, which SQL cannot express; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {}
