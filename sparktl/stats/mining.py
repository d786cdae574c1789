"""The tightest parameter of a formula that all traces satisfy, a grid of candidates at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktl.operators.formula import Formula
from sparktl.operators.temporal import crowds, from_start, robustness, widths


def tightest(trace: DataFrame, make: Callable[[Column], Formula], holds: float, fails: float, series: list[str], time: str = "t", rounds: int = 6, grid: int = 16) -> float:
    """The parameter nearest to ``fails`` for which every trace's robustness at its start is >= 0.

    make(theta) builds the formula on a column. The rows within its horizon of each start are found and dealt by series
    once; each round then evaluates ``grid`` values for all traces in one job without another shuffle of rows, the value
    being part of the series' name, and narrows the interval that many times. The formula must hold at one end and fail at the other.
    """
    f = make(F.col("theta"))
    samples = crowds(trace, widths(f), series, time)
    # copies are made after the join with the starts: before it, they are rows that the size of a broadcast does not count
    near = from_start(trace, series, time, f.horizon())
    near = (near.repartition(*map(F.col, series)) if series else near).persist()

    def worst(values: list[float]) -> dict[float, float]:
        rows = near.withColumn("theta", F.explode(F.array(*map(F.lit, values))))
        found = robustness(rows, make(F.col("theta")), [*series, "theta"], time, samples=samples).filter(F.col(time) == F.col("_start"))
        return dict(found.groupBy("theta").agg(F.min("rho")).collect())

    try:
        ends = worst([holds, fails])
        if not ends or ends[holds] < 0 or ends[fails] >= 0:
            raise ValueError("the formula must hold at one end and fail at the other")
        for _ in range(rounds):
            steps = [holds + (fails - holds) * k / grid for k in range(1, grid)]
            found = worst(steps)
            good = [v for v in steps if found[v] >= 0]
            last = max(good, key=lambda v: abs(v - holds), default=holds)
            holds, fails = last, last + (fails - holds) / grid
        return holds
    finally:
        near.unpersist()
