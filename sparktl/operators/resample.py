"""Resampling onto other times (the as-of joins of this library) and statistics over recent samples."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An end of a spline moves the curvature k samples further by less than 2^-k, below a double's precision from here on.
REACH = 64


def curvature(t: np.ndarray, v: np.ndarray, each: int = 128) -> np.ndarray:
    """Half the second derivative at each sample of the natural cubic spline.

    Stretches of ``each`` samples, with REACH more on both sides, are the columns of one array; all of them
    are swept there and back at once, a step for each sample of a stretch.
    """
    n, size = len(t), min(len(t), each + 2 * REACH)
    if n < 3:
        return np.zeros(n)
    first = np.clip(np.arange(0, n, each) - REACH, 0, n - size)
    at = first + np.arange(size)[:, None]
    t, v = t[at], v[at]
    h = np.diff(t, axis=0)
    slope = np.diff(v, axis=0) / h
    out, ratio, part = np.zeros(at.shape), np.zeros(at.shape), np.zeros(at.shape)
    for i in range(1, size - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * ratio[i - 1]
        ratio[i], part[i] = h[i] / pivot, (3 * (slope[i] - slope[i - 1]) - h[i - 1] * part[i - 1]) / pivot
    for i in range(size - 2, 0, -1):
        out[i] = part[i] - ratio[i] * out[i + 1]
    place = np.arange(n)
    return out[place - first[place // each], place // each]


def bent(trace: DataFrame, series: list[str], signals: list[str], time: str, run: int = 4096) -> DataFrame:
    """The samples with a row for each signal that has a value there, and its curvature in a column _m_signal.

    A series is dealt in runs of samples that also get REACH samples on both sides, so no task has a whole one.
    """
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(s).cast("double").alias("v")) for k, s in enumerate(signals)]))
    points = trace.select(*series, F.col(time).cast("double").alias(time), one.alias("_p")).select(*series, time, F.col("_p.k").alias("_k"), F.col("_p.v").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    placed = points.withColumn("_place", F.row_number().over(Window.partitionBy(*series, "_k").orderBy(time)) - 1)
    first, last = F.greatest(F.col("_place") - REACH, F.lit(0)), F.col("_place") + REACH
    spread = placed.withColumn("_run", F.explode(F.sequence(F.floor(first / run), F.floor(last / run))))

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_place")
        rows["_m"] = curvature(rows[time].to_numpy(), rows["_v"].to_numpy())
        return rows[rows["_place"] // run == rows["_run"]][[*series, time, "_k", "_v", "_m"]]

    # a given number, which small sizes in bytes do not draw together: the work is in Python
    dealt = spread.repartition(int(trace.sparkSession.conf.get("spark.sql.shuffle.partitions")), *series, "_k", "_run")
    kept = dealt.groupBy(*series, "_k", "_run").applyInPandas(solved, T.StructType([*points.schema.fields, T.StructField("_m", T.DoubleType())]))
    return kept.select(*series, time, *[F.when(F.col("_k") == k, F.col(x)).alias(n) for k, s in enumerate(signals) for x, n in (("_v", s), ("_m", f"_m_{s}"))])


def resample(trace: DataFrame, grid: DataFrame, series: list[str], signals: list[str], time: str = "t", method: str = "linear", carry: tuple[str, ...] = (), chunk: float | None = None) -> DataFrame:
    """The signals at the grid's times (series and t columns), by "linear" or natural "cubic" interpolation or sample and "hold".

    Grid rows and samples share one sorted window, so there is one shuffle and no join. Outside the
    samples the nearest end is held; before the first sample "hold" gives the first. Null samples are
    passed over (cubic: NaN too); a series without samples gives nulls, one sample a constant. carry: columns of the grid to keep.
    chunk: the length of chunks of time that a series is split into; what lies before and after each is joined from one row a chunk.
    """
    if method not in ("linear", "hold", "cubic"):
        raise ValueError(f"no such method: {method}")
    bends = [f"_m_{s}" for s in signals] if method == "cubic" else []
    samples = (bent(trace, series, signals, time) if bends else trace).select(*series, time, *signals, *bends, *[F.lit(None).cast(grid.schema[c].dataType).alias(f"_c_{c}") for c in carry], F.lit(False).alias("_grid"))
    wanted = grid.select(*series, time, *[F.lit(None).cast("double").alias(s) for s in [*signals, *bends]], *[F.col(c).alias(f"_c_{c}") for c in carry], F.lit(True).alias("_grid"))
    rows = samples.unionByName(wanted)
    keys = [*series, "_chunk"] if chunk else series
    rows = rows.withColumn("_chunk", F.floor(F.col(time) / chunk)) if chunk else rows
    # range frames hold samples at the grid's own time on both sides
    before, after = (Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, Window.currentRow) for t in (F.col(time), F.col(time).desc()))
    out = rows
    for s in signals:
        point = F.when(F.col(s).isNotNull(), F.struct(F.col(time).alias("t"), F.col(s).cast("double").alias("v"), *[F.col(f"_m_{s}").alias("m")] * bool(bends)))
        out = out.withColumn(f"_{s}", point)
        out = out.withColumns({f"_p_{s}": F.last(f"_{s}", ignorenulls=True).over(before), f"_n_{s}": F.last(f"_{s}", ignorenulls=True).over(after)})
    if chunk:
        out = _beyond(out, series, signals, time)
    values = []
    for s in signals:
        p, n = F.col(f"_p_{s}"), F.col(f"_n_{s}")
        if method != "hold":
            # next to an infinity there is no line: the value before holds
            line = F.when((F.abs(p["v"]) == float("inf")) | (F.abs(n["v"]) == float("inf")), p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (F.col(time) - p["t"]) / (n["t"] - p["t"]))
            if bends:
                x, h = F.col(time) - p["t"], n["t"] - p["t"]
                slope, third = (n["v"] - p["v"]) / h - h * (n["m"] + 2 * p["m"]) / 3, (n["m"] - p["m"]) / (3 * h)
                line = p["v"] + x * (slope + x * (p["m"] + x * third))
            value = F.when(p.isNull(), n["v"]).when(n.isNull() | (p["t"] == F.col(time)), p["v"]).when(n["t"] == F.col(time), n["v"]).otherwise(line)
        else:
            value = F.coalesce(p["v"], n["v"])
        values.append(value.alias(s))
    return out.filter("_grid").select(*series, time, *[F.col(f"_c_{c}").alias(c) for c in carry], *values)


def _beyond(rows: DataFrame, series: list[str], signals: list[str], time: str) -> DataFrame:
    """rows of chunks, the nearest samples before and after filled in from the chunks on both sides."""
    keys = [*series, "_chunk"]
    back, ahead = (Window.partitionBy(*series).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.col("_chunk"), F.col("_chunk").desc()))
    at = lambda s, pick: pick(f"_{s}", F.when(F.col(f"_{s}").isNotNull(), F.col(time)))
    sums = rows.groupBy(*keys).agg(*[at(s, F.max_by).alias(f"_l_{s}") for s in signals], *[at(s, F.min_by).alias(f"_f_{s}") for s in signals])
    sums = sums.withColumns({f"_l_{s}": F.last(f"_l_{s}", ignorenulls=True).over(back) for s in signals})
    sums = sums.withColumns({f"_f_{s}": F.last(f"_f_{s}", ignorenulls=True).over(ahead) for s in signals})
    sums = sums.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    out = rows.join(sums, same, "left")
    return out.withColumns({f"_p_{s}": F.coalesce(f"_p_{s}", f"_l_{s}") for s in signals} | {f"_n_{s}": F.coalesce(f"_n_{s}", f"_f_{s}") for s in signals})


def recent(trace: DataFrame, series: list[str], signal: str, capacity: int, time: str = "t") -> DataFrame:
    """trace with count, mean, variance, deviation, least and greatest of each sample's last ``capacity`` ones."""
    w = Window.partitionBy(*series).orderBy(time).rowsBetween(1 - capacity, 0)
    x = F.col(signal)
    return trace.withColumns(
        {"recent_n": F.count(x).over(w), "recent_mean": F.avg(x).over(w), "recent_var": F.when(F.count(x).over(w) > 1, F.var_samp(x).over(w)),
         "recent_std": F.when(F.count(x).over(w) > 1, F.stddev_samp(x).over(w)), "recent_min": F.min(x).over(w), "recent_max": F.max(x).over(w)}
    )


def closest(trace: DataFrame, series: list[str], at: float, time: str = "t") -> DataFrame:
    """Each series' sample nearest to a time; the earlier of two that are as near."""
    others = [c for c in trace.columns if c not in series]
    picked = trace.groupBy(*series).agg(F.min_by(F.struct(*others), F.struct(F.abs(F.col(time) - at), F.col(time))).alias("_x"))
    return picked.select(*series, "_x.*")


def between(trace: DataFrame, start: float, end: float, time: str = "t", slack: float = 1e-9) -> DataFrame:
    return trace.filter((F.col(time) >= start - slack) & (F.col(time) <= end + slack))


def latest(trace: DataFrame, series: list[str], k: int, time: str = "t") -> DataFrame:
    """Each series' last k samples."""
    place = F.row_number().over(Window.partitionBy(*series).orderBy(F.col(time).desc()))
    return trace.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")
