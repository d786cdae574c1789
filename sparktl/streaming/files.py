"""Streams of newline-delimited JSON, and tables that a stream or a simulation writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructType


def read_ndjson(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False, **options) -> DataFrame:
    """A streaming DataFrame of the files that appear in a folder, one JSON object a line, with the columns of the schema.

    A line that is no object of this schema fails the stream if strict; otherwise its text is in the column malformed,
    null for all others, and its other columns hold what could be read.
    """
    empty = spark.createDataFrame([], schema).schema
    if "malformed" in empty.names:
        raise ValueError("malformed is a column of the reader")
    if strict:
        return spark.readStream.schema(empty).options(mode="FAILFAST", **options).json(path)
    whole = StructType([*empty.fields, *StructType().add("malformed", StringType()).fields])
    return spark.readStream.schema(whole).options(mode="PERMISSIVE", columnNameOfCorruptRecord="malformed", **options).json(path)


def write_verdicts(out: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataStreamWriter:
    """A writer of monitor.verdicts() to Parquet, not yet started: path/batch=<number>/kind=<verdicts or refused>.

    A batch replaces its own folder, so one that is run again after a failure is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        kind = F.when(F.col("refused").isNull(), "verdicts").otherwise("refused") if "refused" in batch.columns else F.lit("verdicts")
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")

    return out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint)


def latest_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Of what write_verdicts() has written, each sample's newest row."""
    rows = spark.read.parquet(path).filter("kind = 'verdicts'")
    others = [c for c in rows.columns if c not in ("series", "t", "batch", "kind")]
    return rows.groupBy("series", "t").agg(F.max_by(F.struct(*others), "batch").alias("_x")).select("series", "t", "_x.*")


def write_lifted(lifted: DataFrame, path: str) -> None:
    """A table of stats.noise.lift, a folder for each member."""
    lifted.write.mode("overwrite").partitionBy("member").parquet(path)
