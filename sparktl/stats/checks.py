"""Probabilities that formulas hold over noisy traces: Monte Carlo, intervals and sequential tests."""

from __future__ import annotations

import math
from fractions import Fraction
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sparktl.operators.formula import Formula
from sparktl.operators.temporal import crowds, from_start, robustness, widths
from sparktl.stats.noise import Noise, lift

#: Sums of logarithms as near as this are equal.
MET = 1e-12


def realisations(trace: DataFrame, formula: Formula, noise: dict[str, Noise], members: int, series: list[str], time: str = "t", seed: int = 42) -> DataFrame:
    """(series, member, rho): the robustness at the start of each noisy copy. Partitioned by series and member."""
    # the copies of a series start where it does, so its first time is found once, before it is copied
    near = from_start(trace, series, time, formula.horizon())
    lifted = lift(near, noise, members, series, time, seed)
    out = robustness(lifted, formula, [*series, "member"], time, samples=crowds(trace, widths(formula), series, time))
    return out.filter(F.col(time) == F.col("_start")).select(*series, "member", "rho")


def z_of(level: float) -> float:
    return NormalDist().inv_cdf(0.5 + level / 2)


def wilson(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval as columns; [0, 1] without trials."""
    z = F.lit(z_of(level))
    p = k / n
    mid, half = p + z * z / (n * 2), z * F.sqrt(p * (1 - p) / n + z * z / (n * n * 4))
    scale = 1 + z * z / n
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / scale)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / scale)).otherwise(1.0)


def agresti_coull(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    z = F.lit(z_of(level))
    m = n + z * z
    p = (k + z * z / 2) / m
    half = z * F.sqrt(p * (1 - p) / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), p - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), p + half)).otherwise(1.0)


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # evaluated from the back: a fixed number of levels is plenty for the counts of a simulation
    f = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + even / (1 + odd / f)
    return front / (1 - (a + b) * x / (a + 1) / f) if f else 0.0


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - tail, k + 1, n - k))


def jeffreys(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    if n == 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    return (0.0 if k == 0 else beta_quantile(tail, k + 0.5, n - k + 0.5)), (1.0 if k == n else beta_quantile(1 - tail, k + 0.5, n - k + 0.5))


def chernoff_samples(error: float, delta: float) -> int:
    return math.ceil(math.log(2 / delta) / (2 * error**2))


def wilson_samples(error: float, level: float) -> int:
    return math.ceil(z_of(level) ** 2 / (4 * error**2))


def check(runs: DataFrame, series: list[str], threshold: float, level: float = 0.95) -> DataFrame:
    """Per series: samples, satisfied (robustness >= 0), their share, its Wilson interval, and whether it reaches threshold."""
    out = runs.groupBy(*series).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("rho") >= 0).alias("satisfied"))
    low, high = wilson(F.col("satisfied").cast("double"), F.col("samples").cast("double"), level)
    share = F.col("satisfied") / F.col("samples")
    return out.withColumns({"probability": share, "low": low, "high": high, "holds": share >= threshold})


def distribution(runs: DataFrame, series: list[str]) -> DataFrame:
    """Per series: samples, mean, population variance, least and greatest robustness."""
    r = F.col("rho")
    return runs.groupBy(*series).agg(F.count(r).alias("samples"), F.avg(r).alias("mean"), F.var_pop(r).alias("variance"), F.min(r).alias("least"), F.max(r).alias("greatest"))


def sequential(runs: DataFrame, series: list[str], p0: float, p1: float, alpha: float = 0.05, beta: float = 0.05) -> DataFrame:
    """Wald's test, members in order: per series the decision (H1: p >= p1, H0: p <= p0) and the members it took.

    The running log-likelihood ratio is one window; the first crossing decides. A bound that is met exactly is crossed:
    ratios are taken of the decimals as they are written, and sums of logarithms have a slack of MET.
    """
    w = Window.partitionBy(*series).orderBy("member")
    q0, q1, a, b = (Fraction(str(x)) for x in (p0, p1, alpha, beta))
    good, bad, up, down = (math.log(x) for x in (q1 / q0, (1 - q1) / (1 - q0), (1 - b) / a, b / (1 - a)))
    # counts times constants, so that the sum does not depend on its order
    k, n = F.count_if(F.col("rho") >= 0).over(w), F.count(F.lit(1)).over(w)
    ratio = k * F.lit(good) + (n - k) * F.lit(bad)
    steps = runs.withColumns({"_ratio": ratio, "_n": n})
    verdict = F.when(F.col("_ratio") >= up - MET, F.lit("accept_h1")).when(F.col("_ratio") <= down + MET, F.lit("accept_h0"))
    first = steps.withColumn("_v", verdict).groupBy(*series).agg(F.min(F.when(F.col("_v").isNotNull(), F.struct("_n", "_v"))).alias("_x"), F.max("_n").alias("_all"))
    return first.select(*series, F.coalesce("_x._v", F.lit("inconclusive")).alias("decision"), F.coalesce("_x._n", "_all").alias("members"))


def bayesian(runs: DataFrame, series: list[str], threshold: float, factor: float = 100.0) -> DataFrame:
    """Sequential test by the posterior of the probability under a uniform prior, members in order.

    Holds once the posterior odds of p >= threshold reach ``factor`` times the prior odds; fails the
    other way round. Counts run in one window; the posterior is computed once for each distinct pair of them and joined back.
    """
    w = Window.partitionBy(*series).orderBy("member")

    @pandas_udf("double")
    def above(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([1 - beta_cdf(threshold, a + 1, b - a + 1) for a, b in zip(k, n)])

    steps = runs.withColumns({"_k": F.count_if(F.col("rho") >= 0).over(w), "_n": F.count(F.lit(1)).over(w)})
    known = steps.select("_k", "_n").distinct().withColumn("_p", above("_k", "_n"))
    steps = steps.join(known, ["_k", "_n"])
    p, theta = F.col("_p"), F.lit(float(threshold))
    verdict = F.when(p * theta >= factor * (1 - p) * (1 - theta), F.lit("holds")).when((1 - p) * (1 - theta) >= factor * p * theta, F.lit("fails"))
    first = steps.withColumn("_v", verdict).groupBy(*series).agg(F.min(F.when(F.col("_v").isNotNull(), F.struct("_n", "_v"))).alias("_x"), F.max("_n").alias("_all"))
    return first.select(*series, F.coalesce("_x._v", F.lit("inconclusive")).alias("decision"), F.coalesce("_x._n", "_all").alias("members"))


def chance(runs: DataFrame, series: list[str], probability: float, tightening: float = 0.0, level: float = 0.95) -> DataFrame:
    """check(), with holds where the interval's lower end reaches the probability and its tightening."""
    return check(runs, series, probability, level).withColumn("holds", F.col("low") >= probability + tightening)


def conservative(runs: DataFrame, series: list[str], threshold: float, level: float = 0.95) -> DataFrame:
    """check() with the exact (Clopper-Pearson) interval, and holds where its lower end reaches the threshold.

    The interval is computed once for each distinct pair of counts, which is joined back.
    """
    counts = runs.groupBy(*series).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("rho") >= 0).alias("satisfied"))

    @pandas_udf("low double, high double")
    def exact(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), level) for a, b in zip(k, n)], columns=["low", "high"])

    bounds = counts.select("satisfied", "samples").distinct().withColumn("_x", exact("satisfied", "samples")).select("satisfied", "samples", "_x.*")
    out = counts.join(bounds, ["satisfied", "samples"])
    return out.select(*series, "samples", "satisfied", (F.col("satisfied") / F.col("samples")).alias("probability"), "low", "high", (F.col("low") >= threshold).alias("holds"))
