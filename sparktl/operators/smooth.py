"""Smooth robustness: minima and maxima replaced by means that every value moves.

``log_sum_exp`` is below the least (above the greatest) value by at most ln(n) / temperature and tends to it
as the temperature grows. ``arithmetic_geometric`` is the geometric mean of positive values, and otherwise the
sum of the values that are not positive over the number of all, so its sign tells whether the formula holds.

Give one of them to ``temporal.robustness(..., lowering=)`` or ``temporal.bank``, with chunks or without. Both take
all operators. until and since have no form in sums: the mean of phi up to each sample of a window starts at the window's own, so
each window is folded sample by sample, and their cost grows with the samples in it.
An empty window is as in ``temporal``, infinite values count as the limit that they are, and NaN is passed over.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktl.operators.formula import INF, Formula
from sparktl.operators.temporal import SLACK, Lowering, operands


#: Slack of the edges of smooth until and since.
CHAIN_SLACK = 1e-12


class Smooth(Lowering):
    by_blocks = True

    def between(self, f: Formula, phi: str, psi: str) -> Column:
        """The mean, over the samples of the window, of psi there and the mean of phi on the way; -Infinity for an empty one."""
        ahead, t = f.kind == "until", F.col(self.time)
        p, q = (self.add(c) for c in operands(f, F.col(phi), F.col(psi)))
        reach = "UNBOUNDED FOLLOWING" if f.high == INF else self.edge(f.high + CHAIN_SLACK, True)
        near = self.add(self.over(f"collect_list(struct(`{self.time}` AS t, `{p}` AS p, `{q}` AS q))", f"CURRENT ROW AND {reach}", not ahead))
        edge = t + F.lit(f.low - CHAIN_SLACK) if ahead else t - F.lit(f.low - CHAIN_SLACK)
        inside = (lambda x: x["t"] >= edge) if ahead else (lambda x: x["t"] <= edge)
        return F.coalesce(F.aggregate(F.col(near), self.start(), lambda sofar, x: self.step(sofar, x, inside(x)), self.finish), F.lit(-INF))


class LogSumExp(Smooth):
    """Windows by running sums over blocks of time, added pairwise by doubling: no shift can overflow or vanish."""

    def __init__(self, df: DataFrame, series: list[str], time: str = "t", rows: int | None = None, crowds: dict[float, float] | None = None, temperature: float = 10.0):
        if not 0 < temperature < INF:
            raise ValueError(f"the temperature is to be finite and above 0, not {temperature}")
        super().__init__(df, series, time, rows, crowds)
        self.source, self.temperature, self.counts = df, temperature, {}

    def pair(self, pick: str, a: Column, b: Column) -> Column:
        a, b = F.when(~F.isnan(a), a), F.when(~F.isnan(b), b)
        near, far = (F.least(a, b), F.greatest(a, b)) if pick == "min" else (F.greatest(a, b), F.least(a, b))
        more = F.log1p(F.exp(F.lit(-self.temperature) * F.abs(far - near))) / self.temperature
        alone = a.isNull() | b.isNull() | (F.abs(near) == INF)
        return F.when(alone, near).otherwise(near - more if pick == "min" else near + more)

    @staticmethod
    def start() -> Column:
        return F.struct(F.lit(None).cast("double").alias("way"), F.lit(None).cast("double").alias("best"))

    def step(self, sofar: Column, x: Column, inside: Column) -> Column:
        best = F.when(inside, self.pair("max", sofar["best"], self.pair("min", x["q"], sofar["way"]))).otherwise(sofar["best"])
        return F.struct(self.pair("min", sofar["way"], x["p"]).alias("way"), best.alias("best"))

    @staticmethod
    def finish(sofar: Column) -> Column:
        return sofar["best"]

    def doubled(self, pick: str, x: str, keys: list[str], descending: bool, rows: int) -> Column:
        w = Window.partitionBy(*keys).orderBy(F.col(self.time).desc() if descending else F.col(self.time))
        out, k = self.add(F.expr(self.plain(x))), 1
        while k < rows:
            before = self.add(F.lag(out, k).over(w))
            out, k = self.add(self.pair(pick, F.col(out), F.col(before))), 2 * k
        return F.col(out)

    def most(self, width: float) -> int:
        """The most samples of a block of this length, from the trace as given."""
        if width not in self.counts:
            blocks = self.source.groupBy(*self.series, F.floor(F.col(self.time) / width)).count()
            self.counts[width] = blocks.agg(F.max("count")).first()[0] or 0
        return self.counts[width]

    def running(self, pick: str, x: str, block: Column, length: float, descending: bool) -> Column:
        return self.doubled(pick, x, [*self.series, self.add(block)], descending, self.most(length))

    def framed(self, pick: str, x: str, frame: str) -> Column:
        """For windows of few samples: all of them in a list."""
        return F.aggregate(self.over(f"collect_list({self.plain(x)})", frame), F.lit(None).cast("double"), lambda sofar, v: self.pair(pick, sofar, v))

    def unbounded(self, pick: str, x: str, low: float, ahead: bool) -> Column:
        whole = self.add(F.struct(self.doubled(pick, x, self.series, ahead, self.longest()).alias("v")))
        return F.col(self.add(self.over(f"last_value(`{whole}`)", f"UNBOUNDED PRECEDING AND {self.edge(low - SLACK, False)}", ahead)))["v"]

    def future(self, pick: str, x: str, low: float, high: float) -> Column:
        if high == INF:
            return self.unbounded(pick, x, low, True)
        if self.sparse(high - low):
            return self.framed(pick, x, f"{self.edge(low - SLACK, True)} AND {self.edge(high + SLACK, True)}")
        return self.window(pick, x, low - SLACK, high + SLACK)

    def past(self, pick: str, x: str, low: float, high: float) -> Column:
        if high == INF:
            return self.unbounded(pick, x, low, False)
        if self.sparse(high - low):
            return self.framed(pick, x, f"{self.edge(high + SLACK, False)} AND {self.edge(low - SLACK, False)}")
        return self.window(pick, x, -(high + SLACK), -(low - SLACK))


class ArithmeticGeometric(Smooth):
    """Windows by the plain sums, count and minimum that the mean is made of; maxima are minima of the negated values."""

    def pair(self, pick: str, a: Column, b: Column) -> Column:
        if pick in ("sum", "least"):
            return super().pair("min" if pick == "least" else pick, a, b)
        parts = [self.parts(pick, v) for v in (a, b)]
        n, logs, low = (F.coalesce(p + q, p, q) for p, q in zip(parts[0][1:], parts[1][1:]))
        return self.mean(pick, F.least(parts[0][0], parts[1][0]), n, logs, low)

    @staticmethod
    def parts(pick: str, x: Column) -> list[Column]:
        """Least value, count, sum of logarithms and sum of what is not positive, of one value; null for NaN."""
        y = F.when(~F.isnan(x), x if pick == "min" else -x)
        logs = F.when((y > 0) & (y < INF), F.ln(y)).when(y.isNotNull(), 0.0)
        return [y, (y < INF).cast("double"), logs, F.when(y <= 0, y).when(y.isNotNull(), 0.0)]

    @staticmethod
    def mean(pick: str, least: Column, n: Column, logs: Column, low: Column) -> Column:
        value = F.when(n == 0, F.lit(INF)).when(least > 0, F.exp(logs / n)).otherwise(low / n)
        return value if pick == "min" else -value

    @staticmethod
    def start() -> Column:
        none = F.struct(*[F.lit(None).cast("double").alias(c) for c in "ynlw"])
        return F.struct(none.alias("way"), none.alias("best"))

    def joined(self, sofar: Column, pick: str, x: Column) -> Column:
        y, *more = self.parts(pick, x)
        sums = [F.coalesce(sofar[c] + v, sofar[c], v).alias(c) for c, v in zip("nlw", more)]
        return F.struct(F.least(sofar["y"], y).alias("y"), *sums)

    def step(self, sofar: Column, x: Column, inside: Column) -> Column:
        way = self.mean("min", *[sofar["way"][c] for c in "ynlw"])
        best = F.when(inside, self.joined(sofar["best"], "max", self.pair("min", x["q"], way))).otherwise(sofar["best"])
        return F.struct(self.joined(sofar["way"], "min", x["p"]).alias("way"), best.alias("best"))

    def finish(self, sofar: Column) -> Column:
        return self.mean("max", *[sofar["best"][c] for c in "ynlw"])

    def windowed(self, read: Callable[[str, str], Column], pick: str, x: str) -> Column:
        names = [self.add(p) for p in self.parts(pick, F.col(x))]
        least = self.add(read("least", names[0]))
        return self.mean(pick, F.col(least), *[F.col(self.add(read("sum", n))) for n in names[1:]])

    def running(self, pick: str, x: str, block: Column, length: float, descending: bool) -> Column:
        if pick == "least":
            return super().running("min", x, block, length, descending)
        order = Window.partitionBy(*self.series, self.add(block)).orderBy(F.col(self.time).desc() if descending else F.col(self.time))
        return F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def over(self, call: str, frame: str, descending: bool = False) -> Column:
        return super().over(call.replace("least(", "min(", 1), frame, descending)

    def future(self, pick: str, x: str, low: float, high: float) -> Column:
        return self.windowed(lambda how, c: super(ArithmeticGeometric, self).future(how, c, low, high), pick, x)

    def past(self, pick: str, x: str, low: float, high: float) -> Column:
        return self.windowed(lambda how, c: super(ArithmeticGeometric, self).past(how, c, low, high), pick, x)


def log_sum_exp(temperature: float = 10.0) -> Callable[..., Lowering]:
    return functools.partial(LogSumExp, temperature=temperature)


def arithmetic_geometric() -> Callable[..., Lowering]:
    return ArithmeticGeometric
