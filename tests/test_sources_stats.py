"""Reading, validating and resampling traces; noise, intervals and sequential tests."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparktl.functions import margins as m
from sparktl.operators import resample as rs
from sparktl.operators.formula import atom
from sparktl.sources import traces
from sparktl.stats import checks, noise


def test_time_names():
    assert traces.time_column(["x", "T", " Time "]) == " Time " and traces.time_column(["a", "b"]) == "a"


@pytest.mark.parametrize("kind", ["csv", "tsv", "json", "parquet", "arrow"])
def test_read(spark, tmp_path, kind):
    path = str(tmp_path / f"x.{kind}")
    rows = [(0.0, 1.5), (1.0, -2.0), (2.5, 4.0)]
    if kind in ("csv", "tsv"):
        sep = "," if kind == "csv" else "\t"
        open(path, "w").write("\n".join([f"time{sep}x", *[f"{a}{sep}{b}" for a, b in rows]]))
    elif kind == "json":
        open(path, "w").write(str([{"time": a, "x": b} for a, b in rows]).replace("'", '"'))
    elif kind == "parquet":
        spark.createDataFrame(rows, "time double, x double").write.parquet(path)
    else:
        table = pa.table({"time": [a for a, _ in rows], "x": [b for _, b in rows]})
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
            out.write_table(table)
    out = traces.read_trace(spark, path)
    assert sorted(map(tuple, out.select("t", "x").collect())) == rows


def test_check(spark):
    good = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0)], "s int, t double, x double")
    assert traces.check(good, ["s"], ["x"]).count() == 2
    for bad in ([(1, 0.0, None)], [(1, 0.0, float("nan"))], [(1, 0.0, 1.0), (1, 0.0, 2.0)]):
        with pytest.raises(traces.TraceError):
            traces.check(spark.createDataFrame(bad, "s int, t double, x double"), ["s"], ["x"])


def test_resample(spark):
    data = spark.createDataFrame([(1, 1.0, 10.0), (1, 3.0, 20.0)], "s int, t double, x double")
    grid = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 1.5, 3.0, 9.0)], "s int, t double")
    get = lambda how: [r["x"] for r in rs.resample(data, grid, ["s"], ["x"], method=how).orderBy("t").collect()]
    assert get("linear") == [10, 10, 12.5, 20, 20] and get("hold") == [10, 10, 10, 20, 20]


def test_intervals(spark):
    low, high = checks.wilson(F.lit(50.0), F.lit(100.0))
    row = spark.range(1).select(low, high).first()
    assert row[0] == pytest.approx(0.403831, abs=1e-6) and row[1] == pytest.approx(0.596169, abs=1e-6)
    assert checks.clopper_pearson(50, 100) == pytest.approx((0.398321, 0.601679), abs=1e-6)
    assert checks.chernoff_samples(0.1, 0.05) == 185 and checks.wilson_samples(0.01, 0.95) == 9604
    assert checks.jeffreys(0, 10)[0] == 0 and checks.clopper_pearson(10, 10)[1] == 1


@pytest.mark.parametrize("family,params", [("gaussian", (1, 2)), ("uniform", (-1, 3)), ("exponential", (2,)), ("weibull", (1.5, 2)), ("rayleigh", (2,)), ("gumbel", (1, 2)), ("lognormal", (0, 0.5)), ("bootstrap", (1, 2, 6)), ("dirac", (4,))])
def test_noise_moments(spark, family, params):
    n = noise.Noise(family, params)
    row = spark.range(40_000).select(n.draw(noise.uniform("a", F.col("id")), noise.uniform("b", F.col("id"))).alias("x")).agg(F.avg("x"), F.var_pop("x")).first()
    assert row[0] == pytest.approx(n.mean(), abs=0.06) and row[1] == pytest.approx(n.variance(), rel=0.08, abs=1e-9)


@pytest.mark.parametrize("c,truth", [(0, 0.5), (-1, 0.841345), (-2, 0.97725), (1, 0.158655)])
def test_monte_carlo(spark, c, truth):
    data = spark.createDataFrame([(1, 0.0, 0.0)], "s int, t double, x double")
    runs = checks.realisations(data, atom(m.gt("x", c)), {"x": noise.Noise("gaussian", (0, 1))}, 20_000, ["s"])
    row = checks.check(runs, ["s"], 0.5, level=0.999).first()
    assert row["probability"] == pytest.approx(truth, abs=0.01) and row["low"] < truth < row["high"]


def test_sequential(spark):
    runs = spark.range(200).select(F.lit(1).alias("s"), F.col("id").alias("member"), F.lit(1.0).alias("rho"))
    row = checks.sequential(runs, ["s"], 0.4, 0.6, 0.05, 0.05).first()
    assert row["decision"] == "accept_h1" and row["members"] == math.ceil(math.log(0.95 / 0.05) / math.log(0.6 / 0.4))


@pytest.mark.parametrize(("p0", "p1", "alpha", "beta", "good", "decision", "members"), [(0.85, 0.95, 0.1, 0.1, 0, "accept_h0", 2), (0.05, 0.15, 0.1, 0.1, 1, "accept_h1", 2), (0.9, 0.99, 0.2, 0.008, 0, "accept_h0", 2)])
def test_sequential_bound_met_exactly(spark, p0, p1, alpha, beta, good, decision, members):
    # two failures of a third each are a ninth, and so on: the sum of logarithms is that of the bound
    runs = spark.range(20).select(F.lit(1).alias("s"), F.col("id").alias("member"), F.lit(good - 0.5).alias("rho"))
    row = checks.sequential(runs, ["s"], p0, p1, alpha, beta).first()
    assert (row["decision"], row["members"]) == (decision, members)


def test_fits(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, 1.0), (4.0, 3.5)], "a double, b double")
    found = noise.fit_gaussian(noise.residuals(df, "a", "b"))
    assert found.params[0] == pytest.approx(2 / 3)
    two = spark.range(4000).select((F.when(F.col("id") % 4 == 0, -5.0).otherwise(5.0) + noise.uniform("u", F.col("id")) - 0.5).alias("residual"))
    parts = sorted(noise.fit_mixture(two, 2), key=lambda p: p[1])
    assert parts[0][0] == pytest.approx(0.25, abs=0.02) and parts[0][1] == pytest.approx(-5, abs=0.1) and parts[1][1] == pytest.approx(5, abs=0.1)


def test_bayesian_and_chance(spark):
    runs = spark.range(300).select(F.lit(1).alias("s"), F.col("id").alias("member"), F.when(F.col("id") % 10 == 0, -1.0).otherwise(1.0).alias("rho"))
    assert checks.bayesian(runs, ["s"], 0.7).first()["decision"] == "holds" and checks.bayesian(runs, ["s"], 0.97).first()["decision"] == "fails"
    # a uniform prior with k of n: P(p >= x) is a binomial sum
    tail = sum(math.comb(11, j) * 0.3**j * 0.7 ** (11 - j) for j in range(5))
    assert 1 - checks.beta_cdf(0.3, 5, 7) == pytest.approx(tail, rel=1e-9)
    assert checks.chance(runs, ["s"], 0.85).first()["holds"] and not checks.chance(runs, ["s"], 0.85, tightening=0.1).first()["holds"]


@pytest.mark.parametrize(("cells", "says"), [(["1", "oops", "3"], "'oops' at time 1"), (["1", "", "3"], "null"), (["1", "2", "inf"], "finite")])
def test_bad_cells_are_refused(spark, tmp_path, cells, says):
    path = tmp_path / "bad.csv"
    path.write_text("time,x\n" + "".join(f"{k},{c}\n" for k, c in enumerate(cells)))
    with pytest.raises(traces.TraceError, match=says):
        traces.read_trace(spark, str(path))
    assert traces.read_trace(spark, str(path), strict=False).count() == 3


def test_repeated_times_are_refused(spark, tmp_path):
    path = tmp_path / "again.csv"
    path.write_text("time,x,y\n0,1,2\n0,3,4\n")
    with pytest.raises(traces.TraceError, match="twice"):
        traces.read_trace(spark, str(path))
    assert traces.read_trace(spark, str(path), rename={"speed": "y"}, strict=False).columns == ["t", "x", "speed"]


@pytest.mark.parametrize("law", [
    noise.Noise("student", (6.0, 1.0, 2.0)), noise.Noise("mixture", (0.25, -3.0, 0.5, 0.75, 2.0, 1.5)), noise.Noise("poisson", (4.5,)), noise.Noise("binomial", (12, 0.3)), noise.Noise("binomial", (5, 1.0)),
    noise.Noise("gamma", (2.5, 1.5)), noise.Noise("gamma", (0.4, 2.0)), noise.Noise("beta", (2.0, 5.0)), noise.Noise("beta", (0.5, 0.5)),
], ids=lambda n: n.family)
def test_more_families(spark, law):
    u, v = noise.uniform("a", F.col("id")), noise.uniform("b", F.col("id"))
    n, mean, variance = spark.range(40_000).select(law.draw(u, v).alias("x")).agg(F.count("x"), F.avg("x"), F.var_pop("x")).first()
    assert n == 40_000 and mean == pytest.approx(law.mean(), abs=0.06) and variance == pytest.approx(law.variance(), rel=0.08, abs=1e-12)


def test_fit_bootstrap(spark):
    df = spark.range(5000).select((F.col("id") % 10).cast("double").alias("residual")).union(spark.sql("SELECT double('NaN')"))
    found = noise.fit_bootstrap(df, 500)
    assert len(found.params) == 500 and found.params == noise.fit_bootstrap(df.repartition(7), 500).params
    assert found.mean() == pytest.approx(4.5, abs=0.5) and noise.fit_bootstrap(df, 9000).variance() == pytest.approx(8.25)


def test_conservative(spark):
    runs = spark.createDataFrame([(s, 1.0 if k < good else -1.0) for s, good in ((1, 50), (2, 99), (3, 99)) for k in range(100)], "s int, rho double")
    out = {r["s"]: r for r in checks.conservative(runs, ["s"], 0.9).collect()}
    assert (out[1]["low"], out[1]["high"]) == (pytest.approx(0.398321, abs=1e-6), pytest.approx(0.601679, abs=1e-6))
    assert [out[s]["holds"] for s in (1, 2, 3)] == [False, True, True]


def test_cubic(spark):
    """Against the spline's whole system of equations: runs shorter than a series, two series, nulls and one sample."""
    r, rows = np.random.default_rng(3), []
    for k, n in ((1, 700), (2, 5), (3, 2), (4, 1)):
        times = np.cumsum(r.choice([0.1, 1.0, 5.0], n))
        rows += [(k, float(t), float(v), None if i % 3 else float(i)) for i, (t, v) in enumerate(zip(times, r.normal(size=n)))]
    data = spark.createDataFrame(rows, "s int, t double, x double, y double")
    grid = spark.createDataFrame([(s, t / 3) for s in (1, 2, 3, 4, 5) for t in range(-6, 4500)], "s int, t double")
    small = rs.bent(data, ["s"], ["x", "y"], "t", run=100).filter("s = 1 AND x IS NOT NULL").orderBy("t").collect()
    out = rs.resample(data, grid, ["s"], ["x", "y"], method="cubic").toPandas()
    assert out[out["s"] == 5]["x"].isna().all() and (out[out["s"] == 4]["x"] == rows[-1][2]).all()
    for s in (1, 2, 3):
        for c, place in (("x", 2), ("y", 3)):
            t, v = (np.array([row[p] for row in rows if row[0] == s and row[place] is not None]) for p in (1, place))
            n, h = len(t), np.diff(t)
            a, b = np.eye(n), np.zeros(n)
            for i in range(1, n - 1):
                a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
                b[i] = 3 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
            m = np.linalg.solve(a, b)
            if (s, c) == (1, "x"):
                assert [row["_m_x"] for row in small] == pytest.approx(list(m), abs=1e-9)
            mine = out[out["s"] == s].sort_values("t")
            for at, got in zip(mine["t"], mine[c]):
                if n == 1 or at <= t[0] or at >= t[-1]:
                    want = v[0] if at <= t[0] else v[-1]
                else:
                    i = int(np.searchsorted(t, at, "right")) - 1
                    x = at - t[i]
                    slope = (v[i + 1] - v[i]) / h[i] - h[i] * (m[i + 1] + 2 * m[i]) / 3
                    want = v[i] + slope * x + m[i] * x**2 + (m[i + 1] - m[i]) / (3 * h[i]) * x**3
                assert got == pytest.approx(want, rel=1e-8, abs=1e-8)


def test_normal_quantile(spark):
    from statistics import NormalDist

    from sparktl.stats.noise import quantile

    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.07, 0.075, 0.3, 0.5, 0.92, 0.925, 0.99, 1 - 1e-12]
    got = [r["q"] for r in spark.createDataFrame([(k, p) for k, p in enumerate(ps)], "k int, p double").select("k", quantile(F.col("p")).alias("q")).orderBy("k").collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-14, abs=1e-14)


@pytest.mark.parametrize("params", [(1.0, 2.0, -0.5, 3.0), (0.0, 1.0, 4.0, 9.0), (0.0, 1.0, -30.0, -8.0), (5.0, 2.0, float("-inf"), float("inf")), (0.0, 1.0, 0.5, float("inf"))])
def test_truncated_normal(spark, params):
    from sparktl.stats.noise import Noise, uniform

    noise, n = Noise("truncated", params), 40_000
    draw = noise.draw(uniform("s", F.col("id"), 0), uniform("s", F.col("id"), 1))
    row = spark.range(n).select(draw.alias("x")).agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).first()
    assert row["n"] == n and params[2] <= row["low"] and row["high"] <= params[3]
    assert row["mean"] == pytest.approx(noise.mean(), abs=5 * (noise.variance() / n) ** 0.5)
    assert row["variance"] == pytest.approx(noise.variance(), rel=0.06)


def test_truncated_normal_is_refused(spark):
    from sparktl.stats.noise import Noise

    for params in ((0.0, 1.0, 2.0, 2.0), (0.0, 0.0, -1.0, 1.0)):
        with pytest.raises(ValueError):
            Noise("truncated", params).mean()
