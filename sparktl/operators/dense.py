"""Robustness in continuous time, over margins that are straight lines between samples.

``robustness`` takes whole formulas, nested as they may be, and ``signal`` gives their piecewise-linear signals.
``combine`` and ``window`` are the plans for one junction and one window at the samples, with fewer shuffles.

The least (greatest) value of a piecewise-linear margin on a window is at one of its edges or at a sample
inside, so a window is two interpolations and a range frame. Outside the samples the end values hold:
unlike in discrete time, a window past the last sample has the last value.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktl.functions.margins import Term
from sparktl.functions.margins import signal as signal_of
from sparktl.operators.formula import INF, UNARY, Formula, atom
from sparktl.operators.resample import resample
from sparktl.operators.temporal import NARROW, Lowering, crowds


def linear(trace: DataFrame, margin: Column | Term | str) -> Column:
    """The margin as a column, if it is known to be linear in the signals: a Term that is, or a column by its name."""
    if isinstance(margin, Column):
        if not any(str(margin) == str(F.col(c)) for c in trace.columns):
            raise ValueError(f"{margin} does not say that it is linear in the signals; make it of names and signal()")
        return margin.cast("double")
    term = signal_of(margin) if isinstance(margin, str) else margin
    if term.degree is None:
        raise ValueError(f"dense time needs margins that are linear in the signals ({', '.join(sorted(term.signals))}); use discrete robustness")
    atom(term).expect(trace.columns)
    return term.column.cast("double")


def growth(f: Formula) -> int:
    """An upper bound of the rows that a formula's signal, and the grid it is made on, have for each sample."""
    parts = sum(map(growth, f.parts))
    return {"atom": 2, "not": parts, "until": 14 * parts, "since": 14 * parts}.get(f.kind, 8 * parts + 8 if f.kind in UNARY else 2 * parts)


class Dense:
    """Formulas as piecewise-linear signals: rows (series, t, rho), one for each time at which the signal bends.

    Between its rows a signal is a straight line, outside them the end values hold, and next to an infinite value
    the value before holds. Every step is windows over one series in order of time, on the rows that it adds.
    """

    def __init__(self, trace: DataFrame, series: list[str], time: str = "t"):
        self.trace, self.series, self.time = trace, series, time
        self.order = Window.partitionBy(*series).orderBy(time)
        self.samples: dict[float, float] = {}
        self.most: int | None = None

    def filled(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """rows with null values of the named columns read off the lines between those that are there; _inside: whether on both sides some are."""
        t = F.col(self.time)
        before = self.order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        after = Window.partitionBy(*self.series).orderBy(t.desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        points = {f"_at_{c}": F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v"))) for c in names}
        out = rows.withColumns(points)
        out = out.withColumns({f"_p_{c}": F.last(f"_at_{c}", ignorenulls=True).over(before) for c in names})
        out = out.withColumns({f"_n_{c}": F.last(f"_at_{c}", ignorenulls=True).over(after) for c in names})
        values = {}
        for c in names:
            p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
            step = (F.abs(p["v"]) == INF) | (F.abs(n["v"]) == INF)
            line = F.when(step, p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"]))
            values[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), n["v"]).when(n.isNull() | (p["t"] == t), p["v"]).when(n["t"] == t, n["v"]).otherwise(line)
        inside = functools.reduce(lambda a, b: a & b, [F.col(f"_p_{c}").isNotNull() & F.col(f"_n_{c}").isNotNull() for c in names])
        return out.select(*rows.columns, inside.alias("_inside"), *[v.alias(f"_v_{c}") for c, v in values.items()]).drop(*names).withColumnsRenamed({f"_v_{c}": c for c in names})

    def crossed(self, rows: DataFrame, a: str, b: str, flag: str | None = None) -> DataFrame:
        """(series, t, a, b) with a row more wherever the two lines cross between rows. flag: a column to keep, false on those rows."""
        x, y, t = F.col(a), F.col(b), F.col(self.time)
        kept = [flag] if flag else []
        both = rows.select(*self.series, self.time, a, b, *kept).withColumns({f"_next_{c}": F.lead(c).over(self.order) for c in (a, b, self.time)})
        here, there = x - y, F.col(f"_next_{a}") - F.col(f"_next_{b}")
        apart = (F.signum(here) * F.signum(there) < 0) & (F.abs(here) < INF) & (F.abs(there) < INF)
        part = here / (here - there)
        at, value = t + (F.col(f"_next_{self.time}") - t) * part, x + (F.col(f"_next_{a}") - x) * part
        own = F.struct(t.alias(self.time), x.alias(a), y.alias(b), *kept)
        bend = F.struct(at.alias(self.time), value.alias(a), value.alias(b), *[F.lit(False).alias(c) for c in kept])
        more = apart & (at > t) & (at < F.col(f"_next_{self.time}"))
        return both.select(*self.series, F.inline(F.when(more, F.array(own, bend)).otherwise(F.array(own))))

    def together(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """(series, t, _a, _b) on the times of both."""
        none = F.lit(None).cast("double")
        rows = a.select(*self.series, self.time, F.col("rho").alias("_a"), none.alias("_b")).unionByName(b.select(*self.series, self.time, none.alias("_a"), F.col("rho").alias("_b")))
        rows = rows.groupBy(*self.series, self.time).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("_a", "_b")])
        return self.filled(rows, ["_a", "_b"]).drop("_inside")

    def joined(self, kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
        pick = F.least if kind == "and" else F.greatest
        return self.crossed(self.together(a, b), "_a", "_b").select(*self.series, self.time, pick("_a", "_b").alias("rho"))

    def of(self, f: Formula) -> DataFrame:
        """The formula's signal."""
        if f.kind == "atom":
            sides = f.margin.sides if isinstance(f.margin, Term) else None
            line = linear(self.trace, sides[1] if sides else f.margin)
            rows = self.trace.select(*self.series, self.time, line.alias("rho"))
            if not sides:
                return rows
            both = self.crossed(rows.withColumn("_not", -F.col("rho")), "rho", "_not")
            return both.select(*self.series, self.time, (F.least if sides[0] == "and" else F.greatest)("rho", "_not").alias("rho"))
        if f.kind == "next":
            raise ValueError("next has no meaning in dense time")
        parts = [self.of(p) for p in f.parts]
        if f.kind in ("not", "implies"):
            parts[0] = parts[0].withColumn("rho", -F.col("rho"))
        if f.kind == "not":
            return parts[0]
        if f.kind in ("and", "or", "implies"):
            return self.joined(f.kind, *parts)
        return self.slid(f, parts[0]) if f.kind in UNARY else self.chained(f, *parts)

    def slid(self, f: Formula, child: DataFrame) -> DataFrame:
        """The extremum of child over a window that slides: straight between the times at which a bend comes in or goes, but for
        where the values at its two edges cross, or cross that of the bends inside."""
        least, side = f.kind in ("always", "historically"), 1.0 if f.kind in ("always", "eventually") else -1.0
        pick, call = (F.least, "min") if least else (F.greatest, "max")
        t, near, far = F.col(self.time), side * f.low, side * f.high
        shifts = [x for x in dict.fromkeys((near, far)) if abs(x) < INF]
        empty = F.lit(None).cast("double")
        row = lambda at, role, x=empty, to=empty: F.struct(at.alias(self.time), F.lit(role).alias("_role"), x.alias("_x"), to.alias("_to"))
        # times to ask for: those of the ends, and those at which a bend is at an edge of the window
        ends = F.lag("rho").over(self.order).isNull() | F.lead("rho").over(self.order).isNull()
        spread = F.array(row(t, "bend", F.col("rho")), *[row(t - F.lit(x), "ask") for x in shifts], F.when(ends, row(t, "ask")))
        rows = child.withColumn("_rows", spread).select(*self.series, F.inline(F.array_compact("_rows")))
        by_role = Window.partitionBy(*self.series).orderBy(self.time, "_role")
        again = (F.col("_role") == "ask") & (F.lag("_role").over(by_role) == "ask") & (F.lag(t).over(by_role) == t)
        rows = rows.withColumn("_again", F.coalesce(again, F.lit(False))).filter("NOT _again").drop("_again").withColumn("_y", F.col("_x"))
        rows = self.filled(rows, ["_y"]).filter("_inside OR _role = 'bend'").drop("_inside", "_y")
        # each gets rows at its edges, and one in the middle between it and the next
        later = Window.partitionBy(*self.series).orderBy(t.desc()).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_to", F.when(F.col("_role") == "ask", F.last(F.when(F.col("_role") == "ask", t), ignorenulls=True).over(later)))
        to = F.col("_to")
        spread = F.array(row(t, "ask", to=to), F.when(to.isNotNull(), row(t + (to - t) / 2, "mid")), *[row(t + F.lit(x), "edge") for x in shifts])
        rows = rows.withColumn("_rows", F.when(F.col("_role") == "bend", F.array(row(t, "bend", F.col("_x")))).otherwise(F.array_compact(spread)))
        rows = rows.select(*self.series, F.inline("_rows")).withColumn("_v", F.col("_x"))
        rows = self.filled(rows, ["_v"]).drop("_inside")
        work = Lowering(rows, self.series, self.time, crowds=self.crowded(f))
        level = work.add(work.exact(call, "_x", min(near, far), max(near, far)))
        low, high = (work.add(work.over("any_value(`_v`)", f"{work.edge(x, True)} AND {work.edge(x, True)}")) if abs(x) < INF else None for x in (near, far))
        asks = work.df.filter("_role IN ('ask', 'mid')").withColumns({"_role_next": F.lead("_role").over(self.order), "_c": F.lead(level).over(self.order)})
        # the level between two times is that of the row in the middle, which comes next
        here = {"_low": F.col(low), "_level": F.col(level), "_high": F.col(high) if high else F.lit(None).cast("double"), "_c": F.when(F.col("_role_next") == "mid", F.col("_c"))}
        asks = asks.withColumns(here).filter("_role = 'ask'").select(*self.series, self.time, "_low", "_high", "_level", "_c")
        nexts = {f"{c}_next": F.lead(c).over(self.order) for c in (self.time, "_low", "_high")}
        asks = asks.withColumns(nexts)
        end, lines = F.col(f"{self.time}_next"), [(F.col(c), F.col(f"{c}_next")) for c in ("_low", "_high")]
        flat = (F.col("_c"), F.col("_c"))
        bends = []
        for (a, a1), (b, b1) in ((lines[0], lines[1]), (lines[0], flat), (lines[1], flat)):
            d0, d1 = a - b, a1 - b1
            part = d0 / (d0 - d1)
            sound = (F.signum(d0) * F.signum(d1) < 0) & (F.abs(d0) < INF) & (F.abs(d1) < INF) & (part > 0) & (part < 1)
            read = [F.when((F.abs(x) == INF) | (F.abs(y) == INF), x).otherwise(x + (y - x) * part) for x, y in lines]
            bends.append(F.when(sound, F.struct((t + (end - t) * part).alias(self.time), pick(*read, F.col("_c")).alias("rho"))))
        first = F.struct(t.alias(self.time), pick("_low", "_high", "_level").alias("rho"))
        out = asks.select(*self.series, F.inline(F.array_compact(F.array(first, *bends))))
        return out.groupBy(*self.series, self.time).agg(F.first("rho").alias("rho"))

    def chained(self, f: Formula, phi: DataFrame, psi: DataFrame) -> DataFrame:
        """until and since: those of discrete time on a grid that has the edges of every window and all crossings of the operands.

        Between the grid's rows min(phi, psi) is straight, so its supremum is at rows, and so is the infimum of phi on the way.
        """
        t, side = F.col(self.time), 1.0 if f.kind == "until" else -1.0
        empty = F.lit(None).cast("double")
        shifts = [x for x in dict.fromkeys((side * f.low, side * f.high)) if x != 0 and abs(x) < INF]
        row = lambda at, ask, a=empty, b=empty: F.struct(at.alias(self.time), F.lit(ask).alias("_ask"), a.alias("_a"), b.alias("_b"))
        asks = [t - F.lit(x) for x in shifts]
        spread = [row(t, True, F.col("_a"), F.col("_b")), *[row(at, True) for at in asks], *[row(at + F.lit(x), False) for at in (t, *asks) for x in shifts]]
        rows = self.together(phi, psi).withColumn("_rows", F.array(*spread)).select(*self.series, F.inline("_rows"))
        rows = rows.groupBy(*self.series, self.time).agg(F.max("_ask").alias("_ask"), *[F.first(c, ignorenulls=True).alias(c) for c in ("_a", "_b")])
        rows = self.filled(rows, ["_a", "_b"]).filter("_inside").drop("_inside")
        fine = self.crossed(rows, "_a", "_b", "_ask").withColumn("_h", F.least("_a", "_b"))
        work = Lowering(fine, self.series, self.time, rows=math.ceil(self.longest() * growth(f)), crowds=self.crowded(f))
        reached = F.col(work.add(work.between(f, "_a", "_h")))
        value = F.greatest(reached, F.col("_b")) if f.low == 0 else reached
        return work.df.filter("_ask").select(*self.series, self.time, value.alias("rho"))

    def crowded(self, f: Formula) -> dict[float, float]:
        """About how many rows a window of f has: as many times those of the trace as the signal has rows for each of its."""
        width = f.high - f.low
        if width not in self.samples:
            self.samples |= crowds(self.trace, {width} if NARROW <= width < INF else set(), self.series, self.time)
        return {width: self.samples[width] * growth(f)} if width in self.samples else {}

    def longest(self) -> int:
        if self.most is None:
            self.most = Lowering(self.trace, self.series, self.time).longest()
        return self.most


def signal(trace: DataFrame, formula: Formula, series: list[str], time: str = "t") -> DataFrame:
    """(series, t, rho): the formula's robustness as a piecewise-linear signal, a row for each time at which it bends.

    Margins are to be linear; == and != bend where they are 0. Windows and junctions are exact between samples too,
    nested as they may be. until and since are exact at their rows: the times of their operands, and
    those at which one of these is at an edge of the window.
    """
    return Dense(trace, series, time).of(formula)


def robustness(trace: DataFrame, formula: Formula, series: list[str], time: str = "t", name: str = "rho") -> DataFrame:
    """(series, t, rho): the formula's robustness in continuous time, at the samples."""
    work = Dense(trace, series, time)
    rows = work.of(formula).withColumn("_sample", F.lit(False)).unionByName(trace.select(*series, time, F.lit(None).cast("double").alias("rho"), F.lit(True).alias("_sample")))
    return work.filled(rows, ["rho"]).filter("_sample").select(*series, time, F.col("rho").alias(name))


def combine(trace: DataFrame, kind: str, left: Column | Term | str, right: Column | Term | str, series: list[str], time: str = "t", name: str = "rho") -> DataFrame:
    """(series, t, rho, sample): and, or, implies of two margins as a piecewise-linear signal.

    left and right must be linear in the signals. Where they cross between two samples the signal bends:
    such times are rows of their own, with sample false. x == c is "and" of x - c and c - x, x != c "or".
    """
    if kind not in ("and", "or", "implies"):
        raise ValueError(f"no such junction: {kind}")
    pick = F.least if kind == "and" else F.greatest
    order = Window.partitionBy(*series).orderBy(time)
    a, b, t = F.col("_a"), F.col("_b"), F.col(time)
    left, right = linear(trace, left), linear(trace, right)
    both = trace.select(*series, time, (-left if kind == "implies" else left).alias("_a"), right.alias("_b"))
    both = both.withColumns({f"_next{c}": F.lead(c).over(order) for c in ("_a", "_b", time)})
    here, there = a - b, F.col("_next_a") - F.col("_next_b")
    # signs, as a product of small differences may vanish
    crossed = F.signum(here) * F.signum(there) < 0
    part = F.when(crossed, here / (here - there))
    point = lambda at, value, sample: F.struct(at.alias(time), value.alias(name), F.lit(sample).alias("sample"))
    bend = point(t + (F.col(f"_next{time}") - t) * part, a + (F.col("_next_a") - a) * part, False)
    points = F.when(crossed, F.array(point(t, pick(a, b), True), bend)).otherwise(F.array(point(t, pick(a, b), True)))
    return both.select(*series, F.inline(points))


def window(trace: DataFrame, margin: Column | Term | str, kind: str, low: float, high: float, series: list[str], time: str = "t", name: str = "rho", samples: str | None = None) -> DataFrame:
    """(series, t, rho): always, eventually, historically or once of the margin on [low, high], at each sample.

    margin must be linear in the signals, or the signal that combine() gives. high must be finite.
    samples: a boolean column of the trace; only rows where it is true get a value.
    """
    if kind not in ("always", "eventually", "historically", "once") or not 0 <= low <= high < INF:
        raise ValueError("not a bounded window")
    ahead, least = kind in ("always", "eventually"), kind in ("always", "historically")
    data = trace.select(*series, time, linear(trace, margin).alias(name), (F.col(samples) if samples else F.lit(True)).alias("_sample"))
    side = 1.0 if ahead else -1.0
    edges = data.filter("_sample").select(*series, F.col(time).alias("_at"), F.explode(F.array(F.lit(side * low), F.lit(side * high))).alias("_by"))
    grid = edges.select(*series, "_at", (F.col("_at") + F.col("_by")).alias(time))
    pick = F.min if least else F.max
    ends = resample(data, grid, series, [name], time, carry=("_at",)).groupBy(*series, F.col("_at").alias(time)).agg(pick(name).alias("_ends"))
    lowering = Lowering(data, series, time, crowds=crowds(trace, {high - low} if high - low >= NARROW else set(), series, time))
    inside = lowering.add((lowering.future if ahead else lowering.past)("min" if least else "max", name, low, high))
    both = lowering.df.select(*series, time, F.col(inside).alias("_in")).join(ends, [*series, time])
    return both.select(*series, time, (F.least if least else F.greatest)("_in", "_ends").alias(name))
