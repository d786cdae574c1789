"""Temporal operators: known values, brute force on irregular times, chunks and edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktl.functions import margins as m
from sparktl.operators import smooth, temporal
from sparktl.operators.formula import INF, Formula, atom

E = 1e-9


def trace(spark, times, **signals):
    names = sorted(signals)
    rows = [(1, float(t), *[float(signals[n][k]) for n in names]) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "s int, t double, " + ", ".join(f"{n} double" for n in names))


def values(df, name="rho"):
    return [r[name] for r in df.orderBy("s", "t").collect()]


X, Y = (lambda: atom(m.gt("x", 0))), (lambda: atom(m.gt("y", 0)))

# Published results for small traces with times 0, 1, 2, ...
KNOWN = [
    (lambda: atom(m.eq("x", 5)), {"x": [5, 3]}, [0, -2]),
    (lambda: X().always(1, 2), {"x": [5, 1, 2, 4]}, [1, 2, 4, INF]),
    (lambda: X().eventually(1, 2), {"x": [-3, -1, 4, -2]}, [4, 4, -2, -INF]),
    (lambda: X().historically(1, 2), {"x": [5, 1, 2, 4]}, [INF, 5, 1, 1]),
    (lambda: X().until(Y(), 0, 2), {"x": [5, 3, -2], "y": [-1, -1, 4]}, [3, 3, 4]),
    (lambda: X().since(Y()), {"x": [5, 3, 1], "y": [2, -1, -1]}, [2, 2, 1]),
    (lambda: X().next(), {"x": [5, -3, 2]}, [-3, 2, -INF]),
    (lambda: X().eventually(0, 1).always(0, 1), {"x": [-1, 2, -3, -1]}, [2, -1, -1, -1]),
    (lambda: (X() >> Y()).historically(0, 2), {"x": [1, 1, -1], "y": [2, -1, 3]}, [2, -1, -1]),
]


@pytest.mark.parametrize("case", range(len(KNOWN)))
def test_known(spark, case):
    make, signals, expected = KNOWN[case]
    times = range(len(expected))
    assert values(temporal.robustness(trace(spark, times, **signals), make(), ["s"])) == expected


def naive(f: Formula, times, leaf) -> list[float]:
    n = len(times)
    if f.kind == "atom":
        return leaf[id(f)]
    p = [naive(x, times, leaf) for x in f.parts]
    out = []
    for i in range(n):
        ahead = [j for j in range(n) if times[i] + f.low - E <= times[j] <= times[i] + f.high + E]
        back = [j for j in range(n) if times[i] - f.high - E <= times[j] <= times[i] - f.low + E]
        if f.kind == "not":
            r = -p[0][i]
        elif f.kind in ("and", "or", "implies"):
            r = {"and": min(p[0][i], p[1][i]), "or": max(p[0][i], p[1][i]), "implies": max(-p[0][i], p[1][i])}[f.kind]
        elif f.kind in ("always", "eventually"):
            r = min((p[0][j] for j in ahead), default=INF) if f.kind == "always" else max((p[0][j] for j in ahead), default=-INF)
        elif f.kind in ("historically", "once"):
            r = min((p[0][j] for j in back), default=INF) if f.kind == "historically" else max((p[0][j] for j in back), default=-INF)
        elif f.kind == "next":
            r = p[0][i + 1] if i + 1 < n else -INF
        elif f.kind == "until":
            r = max((min(p[1][j], min(p[0][i:j], default=INF)) for j in ahead if j >= i), default=-INF)
        else:
            r = max((min(p[1][j], min(p[0][j + 1 : i + 1], default=INF)) for j in back if j <= i), default=-INF)
        out.append(r)
    return out


def drawn(r, x, y, depth):
    if depth == 0:
        return r.choice([x, y])
    one, two = drawn(r, x, y, depth - 1), drawn(r, x, y, r.randrange(depth))
    low = r.choice([0, 0, 1, 2.5])
    high = r.choice([low, low + 3, low + 7.5, INF])
    kind = r.randrange(10)
    return [lambda: ~one, lambda: one & two, lambda: one | two, lambda: one >> two, lambda: one.always(low, high), lambda: one.eventually(low, high), lambda: one.historically(low, high), lambda: one.once(low, high), lambda: one.until(two, low, high), lambda: one.since(two, low, high)][kind]()


@pytest.mark.parametrize("seed", range(12))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    times = sorted(r.sample([k / 2 for k in range(80)], 25))
    xs, ys = ([r.randint(-9, 9) + 0.25 for _ in times] for _ in "xy")
    x, y = X(), Y()
    f = drawn(r, x, y, 3)
    ours = values(temporal.robustness(trace(spark, times, x=xs, y=ys), f, ["s"]))
    assert ours == naive(f, times, {id(x): xs, id(y): ys})


def test_chunks_agree(spark):
    r = random.Random(3)
    times = sorted(r.sample(range(300), 120))
    data = trace(spark, times, x=[r.random() - 0.5 for _ in times])
    f = X().eventually(0, 9).historically(2, 20)
    assert values(temporal.robustness(data, f, ["s"], chunk=37)) == values(temporal.robustness(data, f, ["s"]))
    with pytest.raises(ValueError):
        temporal.robustness(data, X().always(), ["s"], chunk=10)


def test_start_and_violations(spark):
    data = trace(spark, range(8), x=[1, -1, -2, 3, -4, 5, 6, -7])
    out = temporal.robustness(data, X(), ["s"])
    runs = [(r["start"], r["end"], r["lowest"]) for r in temporal.violations(out, ["s"]).orderBy("start").collect()]
    assert runs == [(1, 2, -2), (4, 4, -4), (7, 7, -7)]
    assert temporal.at_start(data, X().eventually(0, 3), ["s"]).first()["rho"] == 3


def test_one_shuffle(spark):
    data = trace(spark, range(4), x=[1, 2, 3, 4], y=[1, 2, 3, 4])
    shared = X().always(0, 2)
    plan = temporal.bank(data, {"a": shared, "b": shared.until(Y(), 1, 3)}, ["s"], rows=4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_and_single(spark):
    assert values(temporal.robustness(trace(spark, [], x=[]), X().until(X(), 0, 1), ["s"])) == []
    assert values(temporal.robustness(trace(spark, [3], x=[2]), X().always(0, 5), ["s"])) == [2]


def test_functions(spark):
    row = spark.range(1).select(m.ln(0).alias("a"), m.ln(-1).alias("b"), m.floor(1e300).alias("c"), m.maximum(float("nan"), 1).alias("d"), m.log(100).alias("e"), m.ceil(-0.5).alias("f")).first()
    assert row["a"] == -INF and math.isnan(row["b"]) and row["c"] == 1e300 and row["d"] == 1 and row["e"] == 2 and row["f"] == 0


def test_formula_values():
    f = X().eventually(0, 10).always(0, 100)
    assert f.horizon() == 110 and f.memory() == 0 and f.depth() == 3 and f.has_temporal()
    with pytest.raises(ValueError):
        X().always(3, 2)


def test_dense_window(spark):
    from sparktl.operators import dense

    r = random.Random(8)
    times = sorted(r.sample(range(60), 20))
    xs = [r.uniform(-3, 3) for _ in times]
    data = trace(spark, times, x=xs)

    def at(t):
        if t <= times[0] or t >= times[-1]:
            return xs[0] if t <= times[0] else xs[-1]
        k = max(i for i, v in enumerate(times) if v <= t)
        return xs[k] if times[k] == t else xs[k] + (xs[k + 1] - xs[k]) * (t - times[k]) / (times[k + 1] - times[k])

    for kind, low, high in (("always", 1.5, 7), ("eventually", 0, 4), ("historically", 2, 9), ("once", 0, 100)):
        side, pick = (1 if kind in ("always", "eventually") else -1), (min if kind in ("always", "historically") else max)
        want = []
        for t in times:
            a, b = sorted((t + side * low, t + side * high))
            want.append(pick([at(a), at(b), *[x for s, x in zip(times, xs) if a <= s <= b]]))
        assert values(dense.window(data, m.gt("x", 0), kind, low, high, ["s"])) == pytest.approx(want)


def test_mining(spark):
    from sparktl.stats.mining import tightest

    data = trace(spark, range(6), x=[1, 4, 2, 7.5, 3, 9])
    assert tightest(data, lambda c: atom(m.lt("x", c)).always(0, 4), 100.0, 0.0, ["s"]) == pytest.approx(7.5, abs=1e-3)


def test_mining_joins_before_it_copies(spark, monkeypatch):
    """A small file with many copies of its rows under a join would be broadcast by the file's size."""
    from sparktl.stats.mining import tightest

    data = trace(spark, range(6), x=[1, 4, 2, 7.5, 3, 9])
    plans, collect = [], type(data).collect
    monkeypatch.setattr(type(data), "collect", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) or collect(df))
    assert tightest(data, lambda c: atom(m.lt("x", c)).always(0, 4), 100.0, 0.0, ["s"]) == pytest.approx(7.5, abs=1e-3)
    joins = copies = 0
    for lines in plans:
        deep = [len(x) - len(x.lstrip(" :+-*(0123456789)")) for x in lines]
        for k, x in enumerate(lines):
            copies += "Generate explode" in x
            if "Join" in x:
                joins += 1
                below = [y for y, d in zip(lines[k + 1 :], deep[k + 1 :]) if d > deep[k]]
                assert not any("Generate explode" in y for y in below)
    assert joins and copies


@pytest.mark.parametrize("wide", [False, True])
def test_nan_is_passed_over(spark, monkeypatch, wide):
    monkeypatch.setattr(temporal, "FEW", 0)
    nan, inf = float("nan"), float("inf")
    step = 1.0 if wide else 1e-5
    rows = [(0, k * step, v, w) for k, (v, w) in enumerate([(nan, 2.0), (1.0, nan), (nan, nan), (-3.0, 4.0)])]
    data = spark.createDataFrame(rows, "s int, t double, x double, y double")
    x, y = atom(F.col("x")), atom(F.col("y"))
    out = temporal.bank(data, {"e": x.eventually(0, step), "a": x.always(0, step), "o": x.once(0, step), "u": x.eventually(), "or_": x | y, "imp": ~x >> y, "and_": x & y}, ["s"]).orderBy("t").collect()
    got = lambda c: [r[c] for r in out]
    assert got("e") == [1.0, 1.0, -3.0, -3.0] and got("a") == [1.0, 1.0, -3.0, -3.0] and got("u") == [1.0, 1.0, -3.0, -3.0]
    assert got("o") == [-inf, 1.0, 1.0, -3.0]
    assert got("or_")[:2] == [2.0, 1.0] and got("or_")[3] == 4.0 and got("or_")[2] != got("or_")[2]
    assert got("imp")[:2] == [2.0, 1.0] and got("and_")[:2] == [2.0, 1.0]


@pytest.mark.parametrize("few", [0, INF])
def test_wide_windows_against_brute_force(spark, monkeypatch, few):
    """Irregular times, gaps longer than the windows, and windows of many samples; in blocks and sample by sample."""
    monkeypatch.setattr(temporal, "FEW", few)
    r, times, t = random.Random(8), [], 0.0
    for _ in range(400):
        t += r.choice([0.001, 0.5, 1.0, 1.0, 1.0, r.random(), 40.0 if r.random() < 0.1 else 1.0])
        times.append(t)
    xs = [r.uniform(-9, 9) for _ in times]
    data = spark.createDataFrame([(0, a, b) for a, b in zip(times, xs)], "s int, t double, x double")
    x = atom(F.col("x"))
    spans = [(0, 1), (0, 30), (2.5, 17), (0.25, 0.5), (50, 90)][: 3 if few == 0 else 5]
    out = temporal.bank(data, {f"{k}{i}": getattr(x, k)(*span) for i, span in enumerate(spans) for k in ("always", "eventually", "historically", "once")}, ["s"]).orderBy("t").collect()
    for i, (a, b) in enumerate(spans):
        for row, now in zip(out, times):
            later = [v for u, v in zip(times, xs) if now + (a - 1e-9) <= u <= now + (b + 1e-9)]
            earlier = [v for u, v in zip(times, xs) if now - (b + 1e-9) <= u <= now - (a - 1e-9)]
            want = (min(later, default=float("inf")), max(later, default=float("-inf")), min(earlier, default=float("inf")), max(earlier, default=float("-inf")))
            assert tuple(row[f"{k}{i}"] for k in ("always", "eventually", "historically", "once")) == want


@pytest.mark.parametrize("kind", ["always", "eventually", "historically", "once", "until", "since"])
def test_unbounded_in_chunks(spark, kind):
    """Chunks settled by their summaries give what the whole series gives, for null series and NaN as well."""
    r = random.Random(11)
    rows = [(s, k + r.uniform(0, 0.9), r.uniform(-5, 5) if r.random() < 0.95 else math.nan, r.uniform(-5, 5)) for s in (1, 2, None) for k in range(70) if r.random() < 0.8 and not (s == 2 and 20 < k < 45)]
    df = spark.createDataFrame(rows, "s int, t double, x double, y double")
    inner = X().eventually(0, 3)
    f = getattr(inner, kind)(Y()) if kind in ("until", "since") else getattr(inner, kind)()
    got = {(v["s"], v["t"]): v["rho"] for v in temporal.in_chunks(df, f, ["s"], 7.0).collect()}
    want = {(v["s"], v["t"]): v["rho"] for v in temporal.robustness(df, f, ["s"]).collect()}
    assert len(got) == len(rows) and got == want


ANYWHERE = {
    "always_eventually": lambda x, y: x.eventually().always(),
    "late_past": lambda x, y: x.once(5),
    "late_future": lambda x, y: x.always(3) & y.eventually(2.5),
    "below_a_window": lambda x, y: (x.historically(1) | y).eventually(0, 6),
    "late_until": lambda x, y: x.until(y, 4),
    "late_since": lambda x, y: x.since(y, 2.5) >> y.until(x),
    "next_above": lambda x, y: x.eventually(0, 3).next(),
    "next_below": lambda x, y: (x.once(0, 2).next() | y).eventually(),
    "next_twice": lambda x, y: y.next().next().since(x.once(0, 1)),
    "next_in_a_window": lambda x, y: (y.until(x, 0, 4).next() & y).once(0, 9),
}


@pytest.mark.parametrize("name", sorted(ANYWHERE))
def test_unbounded_anywhere_in_chunks(spark, name):
    r = random.Random(12)
    rows = [(s, k + r.uniform(0, 0.9), r.uniform(-5, 5) if r.random() < 0.95 else math.nan, r.uniform(-5, 5)) for s in (1, 2, None) for k in range(60) if r.random() < 0.8 and not (s == 2 and 15 < k < 45)]
    df = spark.createDataFrame(rows, "s int, t double, x double, y double")
    f = ANYWHERE[name](X(), Y())
    got = {(v["s"], v["t"]): v["rho"] for v in temporal.in_chunks(df, f, ["s"], 7.0).collect()}
    want = {(v["s"], v["t"]): v["rho"] for v in temporal.robustness(df, f, ["s"]).collect()}
    assert len(got) == len(rows) and got == want


def test_next_over_chunks_without_samples(spark):
    """The next sample is chunks away, null or NaN, or there is none."""
    rows = [("a", 0.0, 1.0), ("a", 0.5, 2.0), ("a", 40.0, None), ("a", 81.0, 4.0), ("a", 82.0, math.nan), ("b", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "s string, t double, x double")
    for f in (X().next(), X().next().next()):
        whole, parts = (out.orderBy("s", "t").collect() for out in (temporal.robustness(df, f, ["s"]), temporal.in_chunks(df, f, ["s"], 7.0)))
        assert [repr(r) for r in whole] == [repr(r) for r in parts]
    assert repr([r["rho"] for r in temporal.in_chunks(df, X().next(), ["s"], 7.0).orderBy("s", "t").collect()]) == "[2.0, None, 4.0, nan, -inf, -inf]"


def test_dense_junctions(spark):
    """A junction is evaluated between samples as well: held to a fine grid of times."""
    from sparktl.operators import dense

    r = random.Random(3)
    times = [k + r.uniform(0, 0.5) for k in range(12)]
    x, y = [r.uniform(-3, 3) for _ in times], [r.uniform(-3, 3) for _ in times]
    df = trace(spark, times, x=x, y=y)
    line = lambda v, u: v[0] if u <= times[0] else v[-1] if u >= times[-1] else next(v[k] + (v[k + 1] - v[k]) * (u - times[k]) / (times[k + 1] - times[k]) for k in range(len(times) - 1) if times[k] <= u <= times[k + 1])
    for kind, pick in (("and", min), ("or", max), ("implies", lambda a, b: max(-a, b))):
        signal = dense.combine(df, kind, F.col("x"), F.col("y"), ["s"])
        got = values(dense.window(signal, F.col("rho"), "eventually", 0.5, 3.0, ["s"], samples="sample"))
        want = [max(pick(line(x, t + 0.5 + 2.5 * q / 2000), line(y, t + 0.5 + 2.5 * q / 2000)) for q in range(2001)) for t in times]
        assert len(got) == len(times) and all(w - 1e-9 <= g <= w + 0.02 for g, w in zip(got, want))


def test_chunks_without_series_and_rows(spark):
    df = trace(spark, range(40), x=[(k * 7) % 11 - 5 for k in range(40)], y=[(k * 5) % 13 - 6 for k in range(40)])
    for f in (X().always(), X().since(Y())):
        assert [r["rho"] for r in temporal.in_chunks(df, f, [], 6.0).orderBy("t").collect()] == values(temporal.robustness(df, f, []))
        assert temporal.in_chunks(df.filter("t < 0"), f, ["s"], 6.0).count() == 0


def soft(kind, beta, values, least):
    """The smooth minimum (or maximum) of a list, from its definition."""
    y = [v if least else -v for v in values if not math.isnan(v)]
    if not y:
        out = INF
    elif kind == "lse":
        low = min(y)
        out = low - math.log(sum(math.exp(-beta * (v - low)) for v in y)) / beta if math.isfinite(low) else low
    else:
        n = sum(v < INF for v in y)
        out = INF if n == 0 else math.exp(sum(math.log(v) for v in y if v < INF) / n) if min(y) > 0 else sum(v for v in y if v <= 0) / n
    return out if least else -out


@pytest.mark.parametrize("kind", ["lse", "agm"])
@pytest.mark.parametrize("span", [(0, 3), (2, 11), (0, 1e-4), (0, INF), (4, INF)])
def test_smooth_against_definition(spark, monkeypatch, kind, span):
    monkeypatch.setattr(temporal, "FEW", 0)
    r, times, t = random.Random(5), [], 0.0
    for _ in range(60):
        t += r.choice([0.25, 1.0, 9.0])
        times.append(t)
    xs = [r.choice([r.uniform(-2, 5), r.uniform(1, 5), 900.0, math.nan, INF]) for _ in times]
    ys = [r.uniform(-3, 3) for _ in times]
    data = trace(spark, times, x=xs, y=ys)
    make = smooth.log_sum_exp(4.0) if kind == "lse" else smooth.arithmetic_geometric()
    x, y = atom(F.col("x")), atom(F.col("y"))
    both = {k: getattr(x, k)(*span) for k in ("always", "eventually", "historically", "once")} | {"and": x & y, "or": x | y, "implies": y >> x}
    out = temporal.bank(data, both, ["s"], lowering=make).orderBy("t").collect()
    a, b = span
    for row, now, v, w in zip(out, times, xs, ys):
        later = [z for u, z in zip(times, xs) if now + (a - E) <= u <= now + (b + E)]
        earlier = [z for u, z in zip(times, xs) if now - (b + E) <= u <= now - (a - E)]
        want = {"always": (later, True), "eventually": (later, False), "historically": (earlier, True), "once": (earlier, False), "and": ([v, w], True), "or": ([v, w], False), "implies": ([v, -w], False)}
        for name, (values, least) in want.items():
            assert row[name] == pytest.approx(soft(kind, 4.0, values, least), rel=1e-9, abs=1e-9), name


def test_smooth_limits(spark):
    data = trace(spark, range(40), x=[(7 * k) % 11 - 4 for k in range(40)])
    f = X().eventually(0, 3).always(0, 9)
    hard, near = values(temporal.robustness(data, f, ["s"])), values(temporal.robustness(data, f, ["s"], lowering=smooth.log_sum_exp(1e4)))
    assert near == pytest.approx(hard, abs=1e-3)
    for make in (smooth.log_sum_exp(), smooth.arithmetic_geometric()):
        whole, parts = (values(temporal.robustness(data, f, ["s"], chunk=c, lowering=make)) for c in (None, 6.0))
        assert whole == pytest.approx(parts)
        assert temporal.robustness(data.limit(0), f, ["s"], lowering=make).count() == 0
    with pytest.raises(ValueError, match="temperature"):
        temporal.robustness(data, f, ["s"], lowering=smooth.log_sum_exp(0))


def by_frames(monkeypatch, df, formulas):
    """The columns of a bank in blocks and sample by sample."""
    out = []
    for few in (0, INF):
        monkeypatch.setattr(temporal, "FEW", few)
        out.append(temporal.bank(df, formulas, ["s"]).orderBy("s", "t").collect())
    return out


def test_windows_at_epoch_times(spark, monkeypatch):
    """Seconds since 1970 in steps of half a millisecond: no sample of a window is lost to rounding."""
    r = random.Random(4)
    xs = [r.uniform(-3, 3) for _ in range(4000)]
    df = spark.createDataFrame([(0, 1.75e9 + k / 2000, v) for k, v in zip(range(42_000, 46_000), xs)], "s int, t double, x double")
    f = {"a": X().always(0.05, 3 * 0.05), "o": X().once(0.05, 3 * 0.05)}
    blocks, frames = by_frames(monkeypatch, df, f)
    assert blocks == frames
    assert [v["a"] for v in blocks[:500]] == [min(xs[k + 100 : k + 301]) for k in range(500)]


@pytest.mark.parametrize("seed", range(2))
def test_blocks_equal_frames(spark, monkeypatch, seed):
    r, rows = random.Random(seed), []
    step, width, start = r.choice([0.001, 0.002, 0.005]), r.choice([0.02, 0.05, 0.1, 0.2]), r.choice([1.6e9, 1.75e9 + 1 / 3, 2.1e9])
    for s in (1, 2, 3, None):
        t = start
        for _ in range(400):
            t += step * r.choice([1, 1, 1, 2, 7 * width / step if r.random() < 0.03 else 1, r.random() + 0.01])
            rows.append((s, t, r.choice([r.uniform(-9, 9), math.nan, INF, -INF, 0.0])))
    df = spark.createDataFrame(rows, "s int, t double, x double")
    x = atom(F.col("x"))
    f = {f"{k}{i}": getattr(x, k)(a, b) for i, (a, b) in enumerate([(0, width), (width, 3 * width), (0.3 * width, 1.4 * width)]) for k in ("always", "eventually", "historically", "once")}
    blocks, frames = by_frames(monkeypatch, df, f)
    assert len(blocks) == len(rows) and all(a == b or (a != a and b != b) for p, q in zip(blocks, frames) for a, b in zip(p[3:], q[3:]))


def passing(pick, *values):
    kept = [v for v in values if v == v]
    return pick(kept) if kept else math.nan


def test_nan_in_until_and_since(spark):
    """By the definition in which a minimum or maximum of a number and NaN is the number."""
    r = random.Random(6)
    n = 30
    xs, ys = ([r.choice([math.nan, r.randint(-5, 5) + 0.5, r.randint(-5, 5) + 0.5]) for _ in range(n)] for _ in "xy")
    df = spark.createDataFrame([(0, float(k), xs[k], ys[k]) for k in range(n)], "s int, t double, x double, y double")
    x, y = atom(F.col("x")), atom(F.col("y"))
    spans = [(0, INF), (0, 3), (1, 2), (2, INF)]
    out = temporal.bank(df, {f"{k}{i}": getattr(x, k)(y, *span) for i, span in enumerate(spans) for k in ("until", "since")}, ["s"]).orderBy("t").collect()
    parts = {k: [v["rho"] for v in temporal.in_chunks(df, getattr(x, k)(y), ["s"], 7.0).orderBy("t").collect()] for k in ("until", "since")}
    for i, (a, b) in enumerate(spans):
        for k in range(n):
            best, way = -INF, INF
            for j in range(k, n):
                if a <= j - k <= b:
                    best = passing(max, best, passing(min, ys[j], way))
                way = passing(min, way, xs[j])
            if (a, b) == (0, INF):  # from the end: the greater of psi and the lesser of phi and what comes
                best = -INF
                for j in range(n - 1, k - 1, -1):
                    best = passing(max, ys[j], passing(min, xs[j], best))
            assert out[k][f"until{i}"] == best
            best, way = -INF, INF
            for j in range(k, -1, -1):
                way = passing(min, way, xs[j + 1]) if j < k else way
                if a <= k - j <= b:
                    best = passing(max, best, passing(min, ys[j], way))
            assert out[k][f"since{i}"] == best
    assert parts["until"] == [v["until0"] for v in out] and parts["since"] == [v["since0"] for v in out]


def test_rows_beyond_the_horizon_are_gone_before_the_shuffle(spark):
    from sparktl.stats import checks
    from sparktl.stats.noise import Noise

    df = spark.createDataFrame([(s, float(t), float((t * s) % 7)) for s in range(5) for t in range(3 + s, 60)] + [(None, 2.0, 1.0), (None, 3.0, -1.0)], "s int, t double, x double")
    f = X().always(0, 4)
    out = temporal.at_start(df, f, ["s"])
    assert {(r["s"], r["t"], r["rho"]) for r in out.collect()} == {(s, 3.0 + s, float(min((t * s) % 7 for t in range(3 + s, 8 + s)))) for s in range(5)} | {(None, 2.0, -1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert min(k for k, line in enumerate(plan) if "Window" in line) < min(k for k, line in enumerate(plan) if "Join" in line)  # the join is below
    runs = checks.realisations(df, f, {"x": Noise("uniform", (0.0, 0.0))}, 3, ["s"])
    assert {(r["s"], r["member"], r["rho"]) for r in runs.collect()} == {(r["s"], k, r["rho"]) for r in out.collect() for k in range(3)}
    assert temporal.at_start(df, f, []).count() == 1 and temporal.at_start(df.limit(0), f, ["s"]).count() == 0


def test_crowds(spark):
    df = spark.createDataFrame([(0, float(k)) for k in range(100)] + [(1, 1000 + k / 100) for k in range(100)], "s int, t double")
    got = temporal.crowds(df, {1.0, 10.0}, ["s"])
    assert got[1.0] == pytest.approx(50.5) and got[10.0] == pytest.approx(55.0) and temporal.crowds(df, set(), ["s"]) == {}
    assert temporal.widths(X().always(0, 5) & X().until(Y(), 1, 3) | X().once()) == {5.0, 2.0}


class Fine:
    """A formula in continuous time on a grid of steps of 1/400 s, from the definitions."""

    def __init__(self, times, signals, step=1 / 400):
        self.step = step
        self.u = times[0] + step * np.arange(round((times[-1] - times[0]) / step) + 1)
        self.x = {k: np.interp(self.u, times, v) for k, v in signals.items()}

    def moved(self, v, by):
        return v[np.clip(np.arange(len(v)) + by, 0, len(v) - 1)]

    def of(self, f, leaf):
        if f.kind == "atom":
            return leaf[id(f)](self.x)
        p = [self.of(q, leaf) for q in f.parts]
        if f.kind in ("not", "and", "or", "implies"):
            return {"not": lambda: -p[0], "and": lambda: np.minimum(*p), "or": lambda: np.maximum(*p), "implies": lambda: np.maximum(-p[0], p[1])}[f.kind]()
        n, low, high = len(self.u), round(f.low / self.step), round(min(f.high / self.step, 10 * len(self.u)))
        out = []
        for i in range(n):
            if f.kind in ("until", "since"):
                back = f.kind == "since"
                phi, psi = (v[: i + 1][::-1] if back else v[i:] for v in p)
                way = np.minimum.accumulate(np.append(INF, phi))[: len(psi)]
                out.append(np.minimum(psi, way)[low : high + 1].max(initial=-INF))
                continue
            a, b = (i + low, i + high) if f.kind in ("always", "eventually") else (i - high, i - low)
            part = p[0][min(max(a, 0), n - 1) : min(max(b, 0), n - 1) + 1]
            out.append(part.min() if f.kind in ("always", "historically") else part.max())
        return np.array(out)


def dense_cases():
    x, y = atom(m.gt("x", 0.25)), atom(m.lt(m.signal("y") * 2 - m.signal("x") / 4, 1))
    z = atom(m.eq("x", 0.5))
    return x, y, z, {
        "nested": x.eventually(0.5, 1.5).always(0, 3), "past": y.historically(0, 2).once(0.25, 1.75), "until": x.until(y, 0, 2), "late": (x | y).until(y, 0.75, 2.5), "ever": y.until(x),
        "since": y.since(x, 0, 2.25), "far": x.since(y, 1.5), "equal": z.eventually(0, 2), "not_equal": atom(m.ne("x", 0.5)).always(0, 1), "junction": (x & y | ~z).always(0.5, 2), "implies": (x >> y).historically(1, 4),
        "open": x.always(), "behind": y.once(), "deep": ((x & y).eventually(0, 1) | z).always(0, 2).once(0, 1),
    }


@pytest.mark.parametrize("name", "nested past late since equal deep".split())
def test_dense_against_a_fine_grid(spark, name):
    from sparktl.operators import dense

    r = random.Random(7)
    times = [round(k + r.uniform(0, 0.5), 1) for k in range(9)]
    xs, ys = ([r.uniform(-3, 3) for _ in times] for _ in "xy")
    x, y, z, cases = dense_cases()
    leaf = {id(x): lambda v: v["x"] - 0.25, id(y): lambda v: 1 - (2 * v["y"] - v["x"] / 4), id(z): lambda v: -abs(v["x"] - 0.5)}
    f = cases[name]
    for a in f.atoms():
        leaf.setdefault(id(a), lambda v: abs(v["x"] - 0.5))
    fine = Fine(times, {"x": xs, "y": ys})
    want = fine.of(f, leaf)
    at = [int(round((t - times[0]) / fine.step)) for t in times]
    df = trace(spark, times, x=xs, y=ys)
    rows = df.unionByName(df.withColumn("s", F.lit(None).cast("int")))
    out = dense.robustness(rows, f, ["s"])
    for s in ("s = 1", "s IS NULL"):
        assert values(out.filter(s)) == pytest.approx([want[k] for k in at], abs=0.06)
    if "until" not in str(f.kind) and "since" not in str(f.kind):  # between the samples too
        bends = dense.signal(df, f, ["s"]).orderBy("t").collect()
        line = np.interp(fine.u, [b["t"] for b in bends], [b["rho"] for b in bends])
        assert np.abs(line - want).max() < 0.08


def test_dense_edges(spark):
    from sparktl.operators import dense

    x, y = atom(m.gt("x", 0)), atom(m.gt("y", 0))
    # Published results
    assert values(dense.robustness(trace(spark, [0, 1, 2], x=[1, 1, -3]), x.always(0, 1.5), ["s"]))[0] == -1
    assert values(dense.robustness(trace(spark, [0, 2], x=[1, -1]), atom(m.eq("x", 0)).eventually(0, 2), ["s"]))[0] == 0
    assert values(dense.robustness(trace(spark, [0, 1, 2], x=[10] * 3, y=[-2, 0, 2]), x.until(y, 0, 2), ["s"]))[0] == 2
    assert values(dense.robustness(trace(spark, [0, 1, 2], x=[10, -5, 10], y=[2] * 3), x.until(y, 1, 2), ["s"]))[0] == -5
    assert values(dense.robustness(trace(spark, [0, 1, 2], x=[10] * 3, y=[2, 0, -2]), x.since(y, 0, 2), ["s"]))[2] == 2
    # a window past the last sample has its value, a witness past it does not exist
    assert values(dense.robustness(trace(spark, [0, 1], x=[1, 2]), x.always(5, 6), ["s"])) == [2, 2]
    assert values(dense.robustness(trace(spark, [0, 1], x=[1, 2]), x.until(x, 5, 6), ["s"])) == [-INF, -INF]
    # next to an infinity the value before holds
    assert values(dense.robustness(trace(spark, [0, 1, 2], x=[1, INF, 3]), x.always(0.5, 0.5), ["s"])) == [1, INF, 3]
    assert values(dense.robustness(trace(spark, [3], x=[2]), x.eventually(0, 1).always(0, 1), ["s"])) == [2]
    assert values(dense.robustness(trace(spark, [], x=[]), x.until(x, 0, 1), ["s"])) == []


def test_dense_takes_linear_margins_only(spark):
    from sparktl.operators import dense

    df = trace(spark, [0, 1], x=[1, 2], y=[1, 2])
    sx, sy = m.signal("x"), m.signal("y")
    for bad in (sx * sx, sx * sy, 1 / sx, m.absolute(sx) - 1, sx % 2, F.col("x") * F.col("x"), m.exp(sx)):
        with pytest.raises(ValueError, match="linear"):
            dense.window(df, bad, "always", 0, 1, ["s"])
        with pytest.raises(ValueError, match="linear"):
            dense.robustness(df, atom(m.gt(bad, 0)), ["s"])
    for good in (sx * 2 + sy / 4 - 1, m.gt(3 * sx, sy), m.sqrt(m.Term(F.lit(4.0))) * sx, F.col("x"), "y", -sx):
        assert dense.window(df, good, "always", 0, 1, ["s"]).count() == 2
    with pytest.raises(ValueError, match="next"):
        dense.robustness(df, atom(m.gt("x", 0)).next(), ["s"])


def test_signals_are_named_before_any_job(spark):
    f = atom(m.gt("x", 0)).until(atom(m.lt(m.signal("speed") + m.ln(m.signal("y")), "z")))
    assert f.variables() == {"x", "speed", "y", "z"} and len(f.atoms()) == 2
    df = trace(spark, [0, 1], x=[1, 2], y=[1, 2])
    for call in (lambda: temporal.robustness(df, f, ["s"]), lambda: temporal.at_start(df, f, ["s"])):
        with pytest.raises(ValueError, match="no such signal: speed, z"):
            call()
    with pytest.raises(ValueError, match="does not tell"):
        atom(F.col("x") - 1).variables()
    terms = m.gt(m.signal("x") * 2 + 1, "y")
    assert df.select(terms.column.alias("v")).first()["v"] == 2 and terms.signals == {"x", "y"} and terms.degree == 1 and m.power(terms, 2).degree is None


def test_violations_in_chunks(spark):
    r = random.Random(13)
    rows = [(s, k + r.uniform(0, 0.9), r.choice([-1, -1, -1, 1]) * r.uniform(0, 5)) for s in (1, None) for k in range(80) if r.random() < 0.8 and not 30 < k < 45]
    rows += [(3, float(k), -1.0) for k in range(30)] + [(4, float(k), 1.0) for k in range(30)] + [(5, 2.0, None), (5, 3.0, -2.0)]
    df = spark.createDataFrame(rows, "s int, t double, rho double")
    found = lambda **o: sorted(map(str, temporal.violations(df, ["s"], **o).collect()))
    assert found(chunk=4.0) == found(chunk=1000.0) == found() and len(found()) > 10


def test_resampling_in_chunks(spark):
    from sparktl.operators import resample as rs

    r = random.Random(14)
    rows = [(s, k + r.uniform(0, 0.9), r.uniform(-5, 5) if r.random() < 0.9 else None, r.choice([INF, 1.0, 2.0])) for s in (1, None) for k in range(60) if r.random() < 0.7 and not 20 < k < 40]
    df = spark.createDataFrame([*rows, (2, 1.0, None, 4.0)], "s int, t double, x double, y double")
    grid = spark.createDataFrame([(s, k * 0.75) for s in (1, 2, None) for k in range(-4, 90)], "s int, t double")
    for method in ("linear", "hold", "cubic"):
        signals = ["x"] if method == "cubic" else ["x", "y"]
        whole, parts = (sorted(map(str, rs.resample(df, grid, ["s"], signals, method=method, chunk=c).collect())) for c in (None, 5.0))
        assert whole == parts and len(whole) == 282


@pytest.mark.parametrize("kind", ["lse", "agm"])
def test_smooth_until_and_since(spark, kind):
    r, times, t = random.Random(15), [], 0.0
    for _ in range(25):
        t += r.choice([0.25, 1.0, 4.0])
        times.append(t)
    xs, ys = ([r.choice([r.uniform(-2, 5), r.uniform(1, 5), INF]) for _ in times] for _ in "xy")
    data = trace(spark, times, x=xs, y=ys)
    make = smooth.log_sum_exp(3.0) if kind == "lse" else smooth.arithmetic_geometric()
    x, y, spans = atom(F.col("x")), atom(F.col("y")), [(0, INF), (1, 6)] if kind == "lse" else [(1, 6)]
    out = temporal.bank(data, {f"{k}{i}": getattr(x, k)(y, *span) for i, span in enumerate(spans) for k in ("until", "since")}, ["s"], lowering=make).orderBy("t").collect()
    for i, (a, b) in enumerate(spans):
        for k, row in enumerate(out):
            later = [soft(kind, 3.0, [ys[j], soft(kind, 3.0, xs[k:j], True)], True) for j in range(k, 25) if times[k] + a <= times[j] <= times[k] + b]
            earlier = [soft(kind, 3.0, [ys[j], soft(kind, 3.0, xs[j + 1 : k + 1], True)], True) for j in range(k, -1, -1) if times[k] - b <= times[j] <= times[k] - a]
            assert row[f"until{i}"] == pytest.approx(soft(kind, 3.0, later, False), rel=1e-9, abs=1e-9)
            assert row[f"since{i}"] == pytest.approx(soft(kind, 3.0, earlier, False), rel=1e-9, abs=1e-9)
    if kind == "lse":  # the hotter, the nearer to the plain one
        f = x.until(y, 0, 6)
        finite = trace(spark, times, x=[min(v, 9) for v in xs], y=[min(v, 9) for v in ys])
        near, hard = (values(temporal.robustness(finite, f, ["s"], **o)) for o in ({"lowering": smooth.log_sum_exp(1e4)}, {}))
        assert near == pytest.approx(hard, abs=1e-2)
