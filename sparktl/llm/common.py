"""Helpers that several corpus operators share: word patterns, shared storage and table access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside these six.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    # Only the first and the last part can be empty.
    start = F.when(F.element_at(parts, 1) == "", 2).otherwise(1)
    end = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, start, F.greatest(F.size(parts) - start - end + 1, F.lit(0)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; plain lower() where the text is all ASCII and the two agree."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, used: Iterable[str], without: Iterable[str] = ()) -> DataFrame:
    """The used columns under their own names, and all columns but those without under reserved ones.

    What an operator adds then clashes with no column of its input; restored() gives the names back.
    """
    return df.select(*[F.col(quoted(c)) for c in used], *[F.col(quoted(c)).alias(f"_carried_{k}") for k, c in enumerate(df.columns) if c not in without])


def restored(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of df, an input of carried(), to select afterwards; new: those with new values."""
    return [new[c].alias(c) if c in new else F.col(f"_carried_{k}").alias(c) for k, c in enumerate(df.columns)]


_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by this worker until it is asked for another: it holds one vocabulary at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, spark.checkpoint.dir; where that is unset a temporary one, for local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if folder.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "viewfs:")) or folder.startswith("/"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
