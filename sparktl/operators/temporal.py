"""Robustness of temporal formulas over traces, as window expressions.

A trace is a DataFrame with one row for each sample of a series: the columns that name the series, a
double time ``t`` that increases strictly within it, and signals. A formula of any size needs one
shuffle by series. Bounded operators over few samples are plain frames; over many they are running frames
over blocks of time, in two sorts whatever the width; unbounded ones are running frames (the future read in
descending time), until and since an associative scan by doubling.

Discrete semantics: an empty window is +Infinity for always and historically and -Infinity for the
others; window edges have a slack of 1e-9; next at the last sample is -Infinity. NaN is passed over by
every minimum and maximum; where there is nothing else, or gives NaN and a window is as if empty. In until and
since it bounds nothing: a NaN psi counts as +Infinity, but in an until without bounds as -Infinity.

``robustness(..., chunk=...)`` splits long series into chunks of time that carry the rows their windows
reach into, so one huge series is many tasks; it needs a bounded formula. ``in_chunks`` takes every formula: next and
operators without an end, wherever they are, are settled by a second pass over one row a chunk.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktl.functions.margins import maximum
from sparktl.operators.formula import INF, UNARY, Formula

SLACK = 1e-9
#: Windows narrower than this are read sample by sample, whatever they hold: their edges are near a double's step.
NARROW = 1e-3
#: Windows with fewer samples than this, as one around a sample has on average, are read sample by sample.
FEW = 160
#: Samples from which a series is more than one task should sort.
HEAVY = 1_000_000
#: A block's share of the window's length: no window lies within a block, however times are rounded.
SHARE = 0.75
NAN = "CAST('NaN' AS DOUBLE)"


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)" if x in (INF, -INF) else f"{x!r}D"


def _quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


class Lowering:
    """Adds one column for each distinct subformula to df; equal subformula objects share a column."""

    by_blocks = False  # whether windows are partitioned by blocks of time

    def __init__(self, df: DataFrame, series: list[str], time: str = "t", rows: int | None = None, crowds: dict[float, float] | None = None):
        self.df, self.series, self.time, self.rows = df, series, time, rows
        self.crowds = crowds or {}  # samples in a window, by its length
        self.names: dict[int, str] = {}
        self.kept: list[Formula] = []  # keeps ids from being used again
        self.part = f"PARTITION BY {_quoted(series)} " if series else ""

    def add(self, column: Column) -> str:
        name = f"_r{len(self.names)}_{len(self.df.columns)}"
        self.df = self.df.withColumn(name, column)
        return name

    def over(self, call: str, frame: str, descending: bool = False) -> Column:
        return F.expr(f"{call} OVER ({self.part}ORDER BY `{self.time}`{' DESC' if descending else ''} RANGE BETWEEN {frame})")

    @staticmethod
    def edge(x: float, ahead: bool) -> str:
        """A frame bound x after (ahead) or before the current row; x may be just below 0."""
        side = ahead == (x >= 0)
        return f"{_d(abs(x))} {'FOLLOWING' if side else 'PRECEDING'}"

    def sparse(self, width: float) -> bool:
        """Whether a window this long is to be read sample by sample."""
        return width < NARROW or self.crowds.get(width, INF) < FEW

    def future(self, pick: str, x: str, low: float, high: float) -> Column:
        """pick (min or max) of column x over [t + low, t + high], null where no value is."""
        if high == INF:
            return self.over(f"{pick}({self.plain(x)})", f"UNBOUNDED PRECEDING AND {self.edge(low - SLACK, False)}", True)
        if self.sparse(high - low):
            return self.over(f"{pick}({self.plain(x)})", f"{self.edge(low - SLACK, True)} AND {self.edge(high + SLACK, True)}")
        return self.window(pick, x, low - SLACK, high + SLACK)

    def past(self, pick: str, x: str, low: float, high: float) -> Column:
        if high == INF:
            return self.over(f"{pick}({self.plain(x)})", f"UNBOUNDED PRECEDING AND {self.edge(low - SLACK, False)}")
        if self.sparse(high - low):
            return self.over(f"{pick}({self.plain(x)})", f"{self.edge(high + SLACK, False)} AND {self.edge(low - SLACK, False)}")
        return self.window(pick, x, -(high + SLACK), -(low - SLACK))

    def exact(self, pick: str, x: str, low: float, high: float) -> Column:
        """pick over [t + low, t + high] without slack; one of the two may be infinite."""
        if high == INF or low == -INF:
            ahead = high == INF
            return self.over(f"{pick}({self.plain(x)})", f"UNBOUNDED PRECEDING AND {self.edge(low if ahead else high, not ahead)}", ahead)
        if self.sparse(high - low):
            return self.over(f"{pick}({self.plain(x)})", f"{self.edge(low, True)} AND {self.edge(high, True)}")
        return self.window(pick, x, low, high)

    @staticmethod
    def plain(x: str) -> str:
        """The column without NaN, which no minimum or maximum of this library picks."""
        return f"nullif(`{x}`, {NAN})"

    def window(self, pick: str, x: str, low: float, high: float) -> Column:
        """pick over [t + low, t + high] in time that does not depend on how many samples lie in it.

        Time is cut into blocks of SHARE of the window's length. The window's first and last samples are read by
        the frames that define it, so its edges are those of a plain frame; each brings the pick of its block
        from there to the block's end, or from the block's start to there. The last one also brings the whole
        block before its own, for a window that touches three. In one block, the window has all of it on one side.
        """
        length = SHARE * (high - low)
        at = lambda t: F.floor(t / length)
        block = F.col(self.add(at(F.col(self.time))))
        order = Window.partitionBy(*self.series).orderBy(self.time)
        up = self.add(self.running(pick, x, block, length, False))
        whole = self.add(F.when(F.lag(block).over(order) != block, F.struct(F.lag(block).over(order).alias("b"), F.lag(up).over(order).alias("v"))))
        before = F.last(whole, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        head = self.add(F.struct(F.col(self.time).alias("t"), block.alias("b"), F.col(up).alias("v"), before.alias("before")))
        last = F.col(self.add(self.over(f"last_value(`{head}`)", f"UNBOUNDED PRECEDING AND {self.edge(high, True)}")))
        tail = self.add(F.struct(F.col(self.time).alias("t"), block.alias("b"), self.running(pick, x, block, length, True).alias("v")))
        first = F.col(self.add(self.over(f"last_value(`{tail}`)", f"UNBOUNDED PRECEDING AND {self.edge(-low, True)}", True)))
        between = F.when(last["before"]["b"] > first["b"], last["before"]["v"])
        one = F.when(at(F.col(self.time) + low) < first["b"], last["v"]).otherwise(first["v"])
        several = self.pair(pick, self.pair(pick, first["v"], between), last["v"])
        return F.when(first["t"] <= last["t"], F.when(first["b"] == last["b"], one).otherwise(several))

    def running(self, pick: str, x: str, block: Column, length: float, descending: bool) -> Column:
        """pick of the block's samples up to (descending: from) each one on; null where they are all NaN.

        One running extremum of (block, value) starts anew with every block, and needs no other order than time.
        """
        sign = 1 if (pick == "min") == descending else -1
        key = self.add(F.when(F.expr(self.plain(x)).isNotNull(), F.struct(block.alias("b"), (F.col(x) * sign).alias("v"))))
        best = F.col(self.add(self.over(f"{'min' if descending else 'max'}(`{key}`)", "UNBOUNDED PRECEDING AND CURRENT ROW", descending)))
        return F.when(best["b"] == block, best["v"] * sign)

    def pair(self, pick: str, a: Column, b: Column) -> Column:
        """pick of two values; nulls and NaN are passed over."""
        if pick == "sum":
            return F.coalesce(a + b, a, b)
        return F.least(a, b) if pick == "min" else maximum(a, b)

    def longest(self) -> int:
        if self.rows is None:
            counts = self.df.groupBy(*self.series).count() if self.series else self.df.groupBy().count()
            self.rows = counts.agg(F.max("count")).first()[0] or 0
        return self.rows

    def scan(self, phi: str, psi: str, forward: bool) -> str:
        """max over later (forward) or earlier samples of min(psi there, min of phi on the way), by doubling."""
        w = Window.partitionBy(*self.series).orderBy(self.time)
        shift = F.lead if forward else F.lag
        p, q, k = psi, phi, 1
        while k < self.longest():
            later_p, later_q = self.add(shift(p, k).over(w)), self.add(shift(q, k).over(w))
            ends = F.col(later_p).isNull()
            p, q, k = self.add(F.when(ends, F.col(p)).otherwise(F.greatest(p, F.least(q, later_p)))), self.add(F.when(ends, F.col(q)).otherwise(F.least(q, later_q))), 2 * k
        return p

    def between(self, f: Formula, phi: str, psi: str) -> Column:
        """until and since on a window: min(best psi in it, phi on the way to it, the scan from its first sample)."""
        forward, low = f.kind == "until", f.low - SLACK
        phi, psi = (self.add(c) for c in operands(f, F.col(phi), F.col(psi)))
        scanned = self.scan(phi, psi, forward)
        if f.low == 0 and f.high == INF:
            return F.col(scanned)
        best = self.add((self.future if forward else self.past)("max", psi, f.low, f.high))
        if low < 0:
            way, first = F.lit(INF), F.col(scanned)
        else:
            short = math.nextafter(low, -INF)
            frame = f"CURRENT ROW AND {self.edge(short, True)}" if forward else f"{self.edge(short, False)} AND CURRENT ROW"
            way = F.col(self.add(self.over(f"min(`{phi}`)", frame)))
            first = F.col(self.add(self.over(f"last_value(`{scanned}`)", f"UNBOUNDED PRECEDING AND {self.edge(low, False)}", forward)))
        return F.when(F.col(best).isNull(), F.lit(-INF)).otherwise(F.least(F.col(best), way, first))

    def lower(self, f: Formula) -> str:
        if id(f) in self.names:
            return self.names[id(f)]
        x = [self.lower(p) for p in f.parts]
        if f.kind == "atom":
            column = f.margin.cast("double")
        elif f.kind == "not":
            column = -F.col(x[0])
        elif f.kind == "and":
            column = self.pair("min", *map(F.col, x))
        elif f.kind == "or":
            column = self.pair("max", *map(F.col, x))
        elif f.kind == "implies":
            column = self.pair("max", -F.col(x[0]), F.col(x[1]))
        elif f.kind == "always":
            column = F.coalesce(self.future("min", x[0], f.low, f.high), F.lit(INF))
        elif f.kind == "eventually":
            column = F.coalesce(self.future("max", x[0], f.low, f.high), F.lit(-INF))
        elif f.kind == "historically":
            column = F.coalesce(self.past("min", x[0], f.low, f.high), F.lit(INF))
        elif f.kind == "once":
            column = F.coalesce(self.past("max", x[0], f.low, f.high), F.lit(-INF))
        elif f.kind == "next":
            column = F.lead(x[0], 1, -INF).over(Window.partitionBy(*self.series).orderBy(self.time))
        elif f.kind in ("until", "since"):
            column = self.between(f, *x)
        else:
            raise ValueError(f"no such operator: {f.kind}")
        self.kept.append(f)
        self.names[id(f)] = name = self.add(column)
        return name


def operands(f: Formula, phi: Column, psi: Column) -> tuple[Column, Column]:
    """Those of until or since without NaN, which bounds nothing."""
    free = F.lit(-INF if f.kind == "until" and (f.low, f.high) == (0, INF) else INF)
    return F.when(F.isnan(phi), F.lit(INF)).otherwise(phi), F.when(F.isnan(psi), free).otherwise(psi)


def widths(f: Formula) -> set[float]:
    """The lengths of the formula's bounded windows, but for those that are always read sample by sample."""
    own = {f.high - f.low} if f.kind in (*UNARY, "until", "since") and NARROW <= f.high - f.low < INF else set()
    return own.union(*map(widths, f.parts))


#: What crowds() found, by the plan that it was asked about; it only ever chooses between plans with one result.
_known: OrderedDict[tuple, float] = OrderedDict()


def crowds(trace: DataFrame, lengths: set[float], series: list[str], time: str = "t") -> dict[float, float]:
    """How many samples a window of each length has around a sample, on average: one pass over keys and times.

    Bursts, and for an infinite length long series, count as often as they have samples. Found again without a pass
    for the same plan; where it is known, give it to bank() and spare the first one.
    """
    if not lengths:
        return {}
    narrow = trace.select(*series, time)
    plan = narrow.semanticHash()
    missing = sorted(w for w in lengths if (plan, w) not in _known)
    if missing:
        cell = F.posexplode(F.array(*[F.floor(F.col(time) / w) if w < INF else F.lit(0).cast("long") for w in missing]))
        cells = narrow.select(*series, cell.alias("_width", "_cell")).groupBy(*series, "_width", "_cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
        found = {r["_width"]: r["crowd"] for r in cells.groupBy("_width").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()}
        _known.update({(plan, w): found.get(k, 0.0) for k, w in enumerate(missing)})
    out = {w: _known[plan, w] for w in lengths}
    while len(_known) > 1024:
        _known.popitem(last=False)
    return out


def heavy(trace: DataFrame, series: list[str], time: str = "t") -> bool:
    """Whether a sample's series has HEAVY samples or more, on average, so that series should be split into chunks."""
    return crowds(trace, {INF}, series, time)[INF] >= HEAVY


def bank(trace: DataFrame, formulas: dict[str, Formula], series: list[str], time: str = "t", rows: int | None = None, lowering: Callable[..., Lowering] = Lowering, samples: dict[float, float] | None = None) -> DataFrame:
    """trace with one robustness column for each formula; subformulas that are one object are computed once.

    rows: the most samples of a series, for until and since; counted from the trace if not given.
    lowering: what evaluates the formulas, see ``smooth`` for others. samples: see crowds().
    """
    for f in formulas.values():
        f.expect(trace.columns)
    lengths = set().union(*map(widths, formulas.values()))
    samples = crowds(trace, lengths, series, time) if samples is None else samples
    work = lowering(trace, series, time, rows, samples)
    if series and work.by_blocks and not all(map(work.sparse, lengths)):
        # dealt by series once: the blocks of a series are then already together
        work.df = trace.repartition(*map(F.col, series))
    names = {name: work.lower(f) for name, f in formulas.items()}
    return work.df.select(*trace.columns, *[F.col(c).alias(n) for n, c in names.items()])


def bounded(f: Formula) -> bool:
    return f.horizon() + f.memory() < INF


class Split:
    """A formula over series in chunks of time: bounded parts by the rows that they reach, operators without an end by what chunks add up to.

    An operator without an end is evaluated in each chunk by itself and summed up in one row a chunk; a pass over these
    rows finds what the chunks beyond add, and a join gives it to the samples. Only the summaries of a series meet in one task.
    """

    def __init__(self, trace: DataFrame, f: Formula, series: list[str], chunk: float, time: str = "t"):
        self.df, self.trace, self.series, self.chunk, self.time = trace, trace, series, chunk, time
        self.samples = crowds(trace, widths(f), series, time)
        self.made = 0

    def name(self) -> str:
        self.made += 1
        return f"_s{self.made}"

    def block(self, at: Column) -> Column:
        return F.floor(at / self.chunk)

    def of(self, f: Formula) -> str:
        """Adds the column of f and gives its name."""
        whole = not f.has_temporal()
        if not bounded(f):
            f = Formula(f.kind, tuple(Formula("atom", margin=F.col(self.of(p))) for p in f.parts), None, f.low, f.high)
            whole = f.kind in ("not", "and", "or", "implies")
            if f.kind == "next":
                return self.following(f.parts[0].margin)
            if f.high == INF and not whole:
                return self.chained(f) if f.kind in ("until", "since") else self.reached(f)
        name = self.name()
        self.df = robustness(self.df, f, self.series, self.time, name, None if whole else self.chunk, samples=self.samples)
        return name

    def following(self, x: Column) -> str:
        """x at the next sample: in the chunk, or the first one of the next chunk that has samples."""
        name, keys = self.name(), [*self.series, "_chunk"]
        rows = self.df.withColumn("_chunk", self.block(F.col(self.time))).withColumn("_value", F.struct(x.alias("x")))
        sums = rows.groupBy(*keys).agg(F.min_by("_value", self.time).alias("_first"))
        carried = sums.withColumn("_carry", F.lead("_first").over(Window.partitionBy(*self.series).orderBy("_chunk")))
        here = rows.withColumn("_after", F.lead("_value").over(Window.partitionBy(*keys).orderBy(self.time)))
        found = F.coalesce(F.col("_after"), F.col("_carry"))
        value = F.when(found.isNull(), F.lit(-INF)).otherwise(found["x"])
        self.df = joined(here, carried, keys, "_carry").select(*self.df.columns, value.alias(name))
        return name

    def reached(self, f: Formula) -> str:
        ahead, least = f.kind in ("always", "eventually"), f.kind in ("always", "historically")
        pick, both, empty = ("min", F.least, INF) if least else ("max", F.greatest, -INF)
        edge = F.col(self.time) + F.lit(f.low - SLACK if ahead else SLACK - f.low)
        return self.read(f.parts[0].margin, edge, ahead, pick, both, empty)

    def read(self, x: Column, edge: Column, ahead: bool, pick: str, both: Callable[..., Column], empty: float) -> str:
        """pick of x over the samples from the edge on (ahead) or up to it: in the edge's chunk, and of the chunks beyond.

        Each row is there twice, as a sample at its own time and as a question at its edge.
        """
        name, t, asks = self.name(), F.col(self.time), F.col("_asks")
        rows = self.df.withColumn("_value", F.when(~F.isnan(x), x)).withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True))))
        rows = rows.withColumns({"_at": F.when(asks, edge).otherwise(t), "_value": F.when(~asks, F.col("_value"))}).withColumn("_chunk", self.block(F.col("_at")))
        keys = [*self.series, "_chunk"]
        # a first value is that of the nearest sample: the last one on the way from the far end to the edge
        call = {"first": lambda c: F.last(c, ignorenulls=True), "min": F.min, "max": F.max}[pick]
        along = Window.partitionBy(*keys).orderBy(F.col("_at").desc() if ahead else F.col("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        nearest = F.when(F.col("_value").isNotNull(), F.struct(F.col("_at") if ahead else -F.col("_at"), "_value"))
        sums = rows.groupBy(*keys).agg((F.min(nearest)["_value"] if pick == "first" else call("_value")).alias("_sum"))
        beyond = Window.partitionBy(*self.series).orderBy(F.col("_chunk").desc() if ahead else F.col("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.withColumn("_carry", call("_sum").over(beyond))
        here = rows.withColumn("_reached", call("_value").over(along)).filter("_asks")
        value = F.coalesce(both(F.col("_reached"), F.col("_carry")), F.lit(empty))
        self.df = joined(here, carried, keys, "_carry").select(*self.df.columns, value.alias(name))
        return name

    def chained(self, f: Formula) -> str:
        """until or since: first as from 0 on, then read at the window's edge and bounded by phi on the way there."""
        ahead, phi, psi, name = f.kind == "until", self.name(), self.name(), self.name()
        clean = operands(f, *[p.margin for p in f.parts])
        self.df = self.df.withColumns({phi: clean[0], psi: clean[1]})
        self.scanned(ahead, phi, psi, name)
        if f.low == 0:
            return name
        first = self.read(F.col(name), F.col(self.time) + F.lit(f.low - SLACK if ahead else SLACK - f.low), ahead, "first", F.coalesce, -INF)
        # on the way: from the sample itself to just before the edge
        way, short = self.name(), max(0.0, math.nextafter(f.low - SLACK, -INF) - SLACK)
        passed = Formula("always" if ahead else "historically", (Formula("atom", margin=F.col(phi)),), None, 0.0, short)
        self.df = robustness(self.df, passed, self.series, self.time, way, self.chunk, samples=self.samples | crowds(self.trace, widths(passed), self.series, self.time))
        out = self.name()
        self.df = self.df.withColumn(out, F.least(first, way))
        return out

    def scanned(self, ahead: bool, phi: str, psi: str, name: str) -> None:
        counts = self.trace.groupBy(*self.series, self.block(F.col(self.time)).alias("_chunk")).count().groupBy(*self.series).agg(F.max("count").alias("rows"), F.count(F.lit(1)).alias("chunks"))
        rows, chunks = (x or 0 for x in counts.agg(F.max("rows"), F.max("chunks")).first())
        keys = [*self.series, "_chunk"]
        values = self.df.withColumn("_chunk", self.block(F.col(self.time)))
        inner = Lowering(values, keys, self.time, rows)
        reached, way = inner.scan(phi, psi, ahead), inner.add(inner.over(f"min(`{phi}`)", "UNBOUNDED PRECEDING AND CURRENT ROW", ahead))
        # a chunk seen from its edge needs no scan: the best psi that phi reaches from there
        inward = Window.partitionBy(*keys).orderBy(F.col(self.time) if ahead else F.col(self.time).desc()).rowsBetween(Window.unboundedPreceding, -1)
        seen = values.withColumn("_way", F.min(phi).over(inward))
        sums = seen.groupBy(*keys).agg(F.max(F.least(psi, "_way")).alias("_p"), F.min(phi).alias("_q"))
        outer = Lowering(sums, self.series, "_chunk", chunks)
        total = outer.scan("_q", "_p", ahead)
        carried = outer.df.withColumn("_carry", (F.lead if ahead else F.lag)(total).over(Window.partitionBy(*self.series).orderBy("_chunk")))
        value = F.when(F.col("_carry").isNull(), F.col(reached)).otherwise(F.greatest(F.col(reached), F.least(way, "_carry")))
        self.df = joined(inner.df, carried, keys, "_carry").select(*self.df.columns, value.alias(name))


def joined(rows: DataFrame, sides: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with a column of sides, which has a row for each of their keys, nulls among them."""
    sides = sides.select(*[F.col(k).alias(f"_of_{k}") for k in keys], column)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(sides, same, "left")


def in_chunks(trace: DataFrame, f: Formula, series: list[str], chunk: float, time: str = "t", name: str = "rho") -> DataFrame:
    """robustness() by chunks of any formula, next and operators without an end included, wherever they are."""
    f.expect(trace.columns)
    work = Split(trace, f, series, chunk, time)
    column = work.of(f)
    return work.df.select(*trace.columns, F.col(column).alias(name))


def robustness(trace: DataFrame, formula: Formula, series: list[str], time: str = "t", name: str = "rho", chunk: float | None = None, rows: int | None = None, lowering: Callable[..., Lowering] = Lowering, samples: dict[float, float] | None = None) -> DataFrame:
    """trace with the formula's robustness at every sample.

    chunk: length in time of the chunks to split each series into; every chunk also gets the rows that
    its windows reach, and gives only its own. The formula's horizon and memory must be finite;
    in_chunks() takes more.
    """
    if chunk is None:
        return bank(trace, {name: formula}, series, time, rows, lowering, samples)
    ahead, back = formula.horizon() + SLACK, formula.memory() + SLACK
    if INF in (ahead, back):
        raise ValueError("chunks need a formula that looks a bounded way ahead and back")
    t = F.col(time)
    first, last = F.floor((t - ahead) / chunk), F.floor((t + back) / chunk)
    spread = trace.withColumn("_chunk", F.explode(F.sequence(first, last)))
    out = bank(spread, {name: formula}, [*series, "_chunk"], time, rows, lowering, crowds(trace, widths(formula), series, time) if samples is None else samples)
    return out.filter(F.floor(t / chunk) == F.col("_chunk")).drop("_chunk")


def from_start(trace: DataFrame, series: list[str], time: str = "t", within: float = INF) -> DataFrame:
    """trace with each series' first time as _start, and only the rows within so much of it.

    The first times are a partial minimum, joined back: rows beyond are gone before anything else is shuffled.
    """
    named = [F.col(c).alias(f"_of_{c}") for c in series]
    starts = trace.groupBy(*series).agg(F.min(time).alias("_start")).select(*named, "_start") if series else trace.agg(F.min(time).alias("_start"))
    same = F.lit(True)
    for c in series:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    near = same if within == INF else same & (F.col(time) <= F.col("_start") + (within + SLACK))
    return trace.join(starts, near).select(*trace.columns, "_start")


def at_start(trace: DataFrame, formula: Formula, series: list[str], time: str = "t", name: str = "rho") -> DataFrame:
    """One row a series: its first time and the robustness there; only the rows within the horizon are evaluated."""
    near = from_start(trace, series, time, formula.horizon())
    out = robustness(near, formula, series, time, name, samples=crowds(trace, widths(formula), series, time))
    return out.filter(F.col(time) == F.col("_start")).select(*series, time, name)


def violations(signal: DataFrame, series: list[str], time: str = "t", name: str = "rho", chunk: float | None = None) -> DataFrame:
    """Maximal runs of samples with negative robustness: series, start, end and their lowest value.

    chunk: the length of chunks of time that a series is split into. Runs inside one are settled there; of a series, only
    those at an edge of a chunk, two at most, and one row for each chunk meet in one task.
    """
    keys = [*series, "_chunk"]
    parts = signal.withColumns({"_chunk": F.floor(F.col(time) / chunk) if chunk else F.lit(0), "_bad": F.coalesce(F.col(name) < 0, F.lit(False))})
    w = Window.partitionBy(*keys).orderBy(time)
    before = F.lag("_bad").over(w)
    marked = parts.withColumns({"_new": (F.col("_bad") & ~F.coalesce(before, F.lit(False))).cast("long"), "_first": before.isNull(), "_last": F.lead("_bad").over(w).isNull()})
    runs = marked.withColumn("_run", F.sum("_new").over(w)).filter("_bad").groupBy(*keys, "_run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.min(name).alias("lowest"), F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    if not chunk:
        return runs.select(*series, "start", "end", "lowest")
    order = Window.partitionBy(*series).orderBy("_chunk")
    sums = parts.groupBy(*keys).agg(F.max_by("_bad", time).alias("_ends")).withColumn("_before", F.coalesce(F.lag("_ends").over(order), F.lit(False)))
    edges = joined(runs.filter("_first OR _last"), sums, keys, "_before")
    along = Window.partitionBy(*series).orderBy("start")
    edges = edges.withColumn("_run", F.sum((~(F.col("_first") & F.col("_before"))).cast("long")).over(along))
    merged = edges.groupBy(*series, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("lowest").alias("lowest"))
    out = [*series, "start", "end", "lowest"]
    return runs.filter("NOT (_first OR _last)").select(*out).unionByName(merged.select(*out))
