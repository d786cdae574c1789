"""Traces from tables and files.

Numeric columns become doubles, columns that cannot are left out, and the time column is found by name.
``check`` is one aggregate over the trace: nulls, values that are not finite, and times that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of a time column, in order of preference.
TIME_NAMES = ("time", "timestamp", "t", "time_s", "time_sec", "time_ms", "time_ns", "elapsed", "elapsed_time", "epoch")


class TraceError(ValueError):
    """A trace that cannot be evaluated: it says which column and how many rows."""


def time_column(columns: list[str]) -> str:
    """The first name of TIME_NAMES among the columns, whatever their case; else the first column."""
    plain = {c.strip().lower(): c for c in reversed(columns)}
    return next((plain[n] for n in TIME_NAMES if n in plain), columns[0])


def seconds(column: str, origin_us: int = 0):
    """A timestamp as seconds since the origin; the origin is subtracted as an integer, so no digits are lost."""
    return (F.unix_micros(F.col(column).cast("timestamp")) - F.lit(origin_us)) / F.lit(1e6)


def to_trace(df: DataFrame, series: list[str], time: str | None = None, rename: dict[str, str] | None = None, origin_us: int = 0) -> DataFrame:
    """series, t and every numeric column as double. rename: signal name -> column."""
    time = time or time_column([c for c in df.columns if c not in series])
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        t = seconds(time, origin_us)
    elif isinstance(kind, T.NumericType):
        t = F.col(time).cast("double")
    else:
        raise TraceError(f"time column {time} is not numeric")
    names = {c: s for s, c in (rename or {}).items()}
    signals = [f.name for f in df.schema if f.name not in (*series, time) and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return df.select(*series, t.alias("t"), *[F.col(c).cast("double").alias(names.get(c, c)) for c in signals])


def check(trace: DataFrame, series: list[str], signals: list[str], time: str = "t") -> DataFrame:
    """trace, after one aggregation has found neither nulls nor non-finite values nor repeated times."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    found = trace.agg(*[bad(c).alias(c) for c in (time, *signals)]).first().asDict()
    for name, n in found.items():
        if n:
            raise TraceError(f"column {name}: {n} rows are null or not finite")
    again = trace.groupBy(*series, time).count().filter("count > 1").limit(1).count()
    if again:
        raise TraceError(f"a series has one {time} twice")
    return trace


def numbers(df: DataFrame, series: list[str], time: str) -> DataFrame:
    """df, after one pass has found no cell of a text column, but for series and time, that is not a number."""
    texts = [f.name for f in df.schema if f.name not in (*series, time) and isinstance(f.dataType, T.StringType)]
    if texts:
        wrong = lambda c: F.min(F.when(F.col(c).try_cast("double").isNull(), F.struct(F.col(time).cast("string"), F.coalesce(c, F.lit("")))))
        found = df.agg(*[wrong(c).alias(c) for c in texts]).first()
        for c in texts:
            if found[c]:
                raise TraceError(f"column {c}: {found[c][1]!r} at {time} {found[c][0]} is not a number")
    return df.withColumns({c: F.col(c).cast("double") for c in texts}) if texts else df


def read_trace(
    spark: SparkSession, path: str, series: list[str] | None = None, kind: str | None = None, time: str | None = None, rename: dict[str, str] | None = None, strict: bool = True, **options
) -> DataFrame:
    """A trace from csv, txt, tsv, json (array), ndjson, parquet or arrow files, by extension unless given.

    strict: text cells that are no numbers, nulls, values that are not finite and repeated times raise
    TraceError; otherwise columns of text are left out and the rest is read as it is. time and rename
    (signal name -> column) are those of to_trace.
    """
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "txt", "tsv"):
        df = spark.read.csv(path, header=True, inferSchema=True, mode="FAILFAST", sep="\t" if kind == "tsv" else ",")
    elif kind in ("parquet", "pq"):
        df = spark.read.parquet(path)
    elif kind in ("json", "ndjson"):
        df = spark.read.json(path, multiLine=kind == "json", mode="FAILFAST")
    elif kind in ("arrow", "feather", "ipc"):
        from sparktl.sources.files import ArrowSource

        spark.dataSource.register(ArrowSource)
        df = spark.read.format(ArrowSource.name()).options(**options).load(path)
    else:
        raise TraceError(f"unknown kind of file: {kind}")
    series = series or []
    time = time or time_column([c for c in df.columns if c not in series])
    if not strict:
        return to_trace(df, series, time, rename)
    out = to_trace(numbers(df, series, time), series, time, rename)
    return check(out, series, [c for c in out.columns if c not in (*series, "t")])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, t, value): one trace a user; t in seconds since 2024-01-01."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select("user_id", "event_id", seconds("ts", 1704067200000000).alias("t"), "value")


def daily(spark: SparkSession, sf_dir: str, table: str, key: str, date: str, value) -> DataFrame:
    """(key, t in days, x): one row for each key and day, since their times repeat in the table."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    day = (F.unix_micros(F.col(date).cast("timestamp")) / F.lit(86400000000)).cast("double")
    return df.groupBy(key, day.alias("t")).agg(value.alias("x"))
