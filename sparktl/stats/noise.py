"""Noise families as columns of uniforms drawn by hash.

A draw depends on the seed, the series, the member, the time, the signal and a counter, and on nothing
else: partitions, retries and lost executors do not change it. The hash is MD5, so that DuckDB can
repeat every draw.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A double in (0, 1), the same for the same key."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    hashed = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
    return (F.conv(hashed, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


# Numerators and denominators of the rational approximations of the normal quantile (Wichura 1988,
# algorithm AS 241), lowest power first: near the middle, in the tails, and far out in them.
QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def quantile(p: Column) -> Column:
    """The standard normal quantile of probabilities in (0, 1), to a double's precision."""

    def ratio(k: int, x: Column) -> Column:
        top, bottom = (functools.reduce(lambda sofar, c: sofar * x + c, reversed(cs), F.lit(0.0)) for cs in QUANTILE[k])
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.signum(q) * F.when(r <= 5, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(0, 0.180625 - q * q)).otherwise(tail)


def normal_cdf(x: float) -> float:
    return math.erfc(-x / math.sqrt(2)) / 2


def shares(family: str, p: tuple[float, ...]) -> list[float]:
    """Probabilities of 0, 1, ... of a counting family: all of them, or up to a tail below 1e-15."""
    if family == "binomial":
        n, q = int(p[0]), p[1]
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (k * math.log(q) if k else 0) + ((n - k) * math.log1p(-q) if n > k else 0) for k in range(n + 1)] if 0 < q < 1 else []
        return [math.exp(x) for x in logs] or [float(k == n * q) for k in range(n + 1)]
    rate, top = p[0], math.ceil(p[0] + 12 * math.sqrt(p[0]) + 30)
    return [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(top)] if rate > 0 else [1.0]


@dataclass(frozen=True)
class Noise:
    """draw(u1, u2) gives the noise from two independent uniforms; additive, or a factor.

    mixture: weight, mean, deviation of each normal part in turn. student: degrees of freedom, place, scale.
    gamma: shape, scale. beta: two shapes. truncated: mean and deviation of a normal, and the two ends it is kept within. poisson: rate. binomial: trials, probability; a table of at most MOST_COUNTS counts is looked up.
    """

    MOST_COUNTS = 4096
    #: Tries of a gamma draw; each is taken with a chance of 0.95 or more, and after the last the mode stands in.
    TRIES = 12

    family: str
    params: tuple[float, ...]
    additive: bool = True

    def counted(self, u: Column) -> Column:
        """The count whose cumulative probability is the first above u."""
        p = shares(self.family, self.params)
        if len(p) > self.MOST_COUNTS:
            raise ValueError(f"more than {self.MOST_COUNTS} counts: take a gaussian")
        ends = [sum(p[: k + 1]) for k in range(len(p) - 1)]
        return F.size(F.filter(F.array(*map(F.lit, ends)).cast("array<double>"), lambda end: end <= u)).cast("double")

    def mixed(self, u: Column, v: Column) -> Column:
        """u picks the part, and its place within the part's share is again uniform."""
        parts = [self.params[k : k + 3] for k in range(0, len(self.params), 3)]
        whole, start, out = sum(w for w, _, _ in parts), 0.0, None
        for weight, mean, deviation in parts:
            share = weight / whole
            # the ends are kept off, as rounding may reach them
            place = F.least(F.greatest((u - start) / share, F.lit(2.0**-53)), F.lit(1 - 2.0**-53))
            here = Noise("gaussian", (mean, deviation)).draw(place, v)
            start += share
            out = F.when(u < start, here) if out is None else out.when(u < start, here)
        return out.otherwise(here)

    def squeezed(self, shape: float, u: Column, v: Column, name: str) -> Column:
        """A gamma draw of this shape by rejection from a cubed normal (Marsaglia and Tsang), its tries hashed from u and v."""
        d = (shape + 1 if shape < 1 else shape) - 1 / 3
        tries = []
        for k in range(self.TRIES):
            a, b, c = (uniform(u, v, name, k, part) for part in range(3))
            normal = F.sqrt(F.lit(-2.0) * F.ln(a)) * F.cos(F.lit(2 * math.pi) * b)
            cube = F.pow(1 + normal / math.sqrt(9 * d), F.lit(3.0))
            taken = (cube > 0) & (F.ln(c) < normal * normal / 2 + d - d * cube + d * F.ln(cube))
            tries.append(F.when(taken, d * cube))
        value = F.coalesce(*tries, F.lit(d))
        # a shape below 1 is one of shape + 1, shrunk by a power of a uniform
        return value * F.pow(uniform(u, v, name, "power"), F.lit(1 / shape)) if shape < 1 else value

    def shared(self, u: Column, v: Column) -> Column:
        x, y = self.squeezed(self.params[0], u, v, "x"), self.squeezed(self.params[1], u, v, "y")
        return x / (x + y)

    def standard(self) -> tuple[float, float, float, float]:
        """Of a truncated normal: its ends in deviations, the density at both ends, each over the share between them."""
        mean, deviation, low, high = self.params
        if not (low < high and deviation > 0):
            raise ValueError(f"not a truncated normal: {self.params}")
        a, b = (low - mean) / deviation, (high - mean) / deviation
        # the same share, from the side on which the tails are small
        share = normal_cdf(b) - normal_cdf(a) if a <= 0 else normal_cdf(-a) - normal_cdf(-b)
        density = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi) / share if math.isfinite(x) else 0.0
        return a, b, density(a), density(b)

    def between(self, u: Column) -> Column:
        """A normal kept within two ends, by its quantile; above the mean it is mirrored, where tails keep their digits."""
        mean, deviation, low, high = self.params
        a, b, _, _ = self.standard()
        side = 1.0 if a <= 0 else -1.0
        start, end = (normal_cdf(a), normal_cdf(b)) if a <= 0 else (normal_cdf(-a), normal_cdf(-b))
        p = F.least(F.greatest(F.lit(start) + u * F.lit(end - start), F.lit(2.0**-1022)), F.lit(1 - 2.0**-53))
        return F.least(F.greatest(F.lit(mean) + quantile(p) * F.lit(side * deviation), F.lit(low)), F.lit(high))

    def draw(self, u: Column, v: Column) -> Column:
        p = [float(x) for x in self.params]
        normal = F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v)
        draws = {
            "dirac": lambda: F.lit(p[0]),
            "gaussian": lambda: F.lit(p[0]) + F.lit(p[1]) * normal,
            "uniform": lambda: F.lit(p[0]) + F.lit(p[1] - p[0]) * u,
            "lognormal": lambda: F.exp(F.lit(p[0]) + F.lit(p[1]) * normal),
            "exponential": lambda: -F.ln(u) / F.lit(p[0]),
            "weibull": lambda: F.lit(p[1]) * F.pow(-F.ln(u), F.lit(1 / p[0])),
            "rayleigh": lambda: F.lit(p[0]) * F.sqrt(F.lit(-2.0) * F.ln(u)),
            "gumbel": lambda: F.lit(p[0]) - F.lit(p[1]) * F.ln(-F.ln(u)),
            "cauchy": lambda: F.lit(p[0]) + F.lit(p[1]) * F.tan(F.lit(math.pi) * (u - 0.5)),
            "bootstrap": lambda: F.element_at(F.array(*map(F.lit, p)), (F.floor(u * len(p)) + 1).cast("int")),
            "student": lambda: F.lit(p[1]) + F.lit(p[2]) * F.sqrt(F.lit(p[0]) * (F.pow(u, F.lit(-2 / p[0])) - 1)) * F.cos(F.lit(2 * math.pi) * v),
            "mixture": lambda: self.mixed(u, v),
            "gamma": lambda: F.lit(p[1]) * self.squeezed(p[0], u, v, "x"),
            "beta": lambda: self.shared(u, v),
            "truncated": lambda: self.between(u),
            "poisson": lambda: self.counted(u),
            "binomial": lambda: self.counted(u),
        }
        if self.family not in draws:
            raise ValueError(f"no such family: {self.family}")
        return draws[self.family]()

    def apply(self, x: Column, u: Column, v: Column) -> Column:
        return x + self.draw(u, v) if self.additive else x * self.draw(u, v)

    def mean(self) -> float | None:
        p = self.params
        if self.family == "truncated":
            _, _, low, high = self.standard()
            return p[0] + p[1] * (low - high)
        return {
            "dirac": lambda: p[0], "gaussian": lambda: p[0], "uniform": lambda: (p[0] + p[1]) / 2, "lognormal": lambda: math.exp(p[0] + p[1] ** 2 / 2),
            "exponential": lambda: 1 / p[0], "weibull": lambda: p[1] * math.gamma(1 + 1 / p[0]), "rayleigh": lambda: p[0] * math.sqrt(math.pi / 2),
            "gumbel": lambda: p[0] + 0.5772156649015329 * p[1], "cauchy": lambda: None, "bootstrap": lambda: sum(p) / len(p),
            "student": lambda: p[1] if p[0] > 1 else None, "mixture": lambda: sum(w * m for w, m in zip(p[::3], p[1::3])) / sum(p[::3]), "poisson": lambda: p[0], "binomial": lambda: p[0] * p[1],
            "gamma": lambda: p[0] * p[1], "beta": lambda: p[0] / (p[0] + p[1]),
        }[self.family]()

    def variance(self) -> float | None:
        p = self.params
        if self.family == "truncated":
            a, b, low, high = self.standard()
            edges = (a * low if low else 0.0) - (b * high if high else 0.0)
            return p[1] ** 2 * (1 + edges - (low - high) ** 2)
        return {
            "dirac": lambda: 0.0, "gaussian": lambda: p[1] ** 2, "uniform": lambda: (p[1] - p[0]) ** 2 / 12, "lognormal": lambda: (math.exp(p[1] ** 2) - 1) * math.exp(2 * p[0] + p[1] ** 2),
            "exponential": lambda: 1 / p[0] ** 2, "weibull": lambda: p[1] ** 2 * (math.gamma(1 + 2 / p[0]) - math.gamma(1 + 1 / p[0]) ** 2), "rayleigh": lambda: (2 - math.pi / 2) * p[0] ** 2,
            "gumbel": lambda: math.pi**2 / 6 * p[1] ** 2, "cauchy": lambda: None, "bootstrap": lambda: sum((x - sum(p) / len(p)) ** 2 for x in p) / len(p),
            "student": lambda: p[2] ** 2 * p[0] / (p[0] - 2) if p[0] > 2 else None, "poisson": lambda: p[0], "binomial": lambda: p[0] * p[1] * (1 - p[1]),
            "gamma": lambda: p[0] * p[1] ** 2, "beta": lambda: p[0] * p[1] / ((p[0] + p[1]) ** 2 * (p[0] + p[1] + 1)),
            "mixture": lambda: sum(w * (d**2 + m**2) for w, m, d in zip(p[::3], p[1::3], p[2::3])) / sum(p[::3]) - self.mean() ** 2,
        }[self.family]()


def lift(trace: DataFrame, noise: dict[str, Noise], members: int, series: list[str], time: str = "t", seed: int = 42) -> DataFrame:
    """``members`` noisy copies of every row, numbered by ``member``; signals without noise are copied.

    The copies of a row are made where the row is; nothing is shuffled.
    """
    out = trace.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    key = [F.lit(str(seed)), *[F.col(s) for s in series], F.col("member"), F.unix_micros(F.timestamp_micros(F.round(F.col(time) * 1e6).cast("long")))]
    return out.withColumns({s: n.apply(F.col(s), uniform(*key, s, 0), uniform(*key, s, 1)) for s, n in noise.items()})


def residuals(df: DataFrame, sensor: str, truth: str, additive: bool = True) -> DataFrame:
    """df with residual: sensor - truth, or sensor / truth where truth is not within 1e-9 of zero."""
    if additive:
        return df.withColumn("residual", F.col(sensor) - F.col(truth))
    return df.filter(F.abs(truth) >= 1e-9).withColumn("residual", F.col(sensor) / F.col(truth))


def fit_gaussian(df: DataFrame, column: str = "residual") -> Noise:
    """Mean and sample deviation of the finite values; two at least."""
    x = F.col(column)
    n, mean, deviation = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    if n < 2:
        raise ValueError("a fit needs two values")
    return Noise("gaussian", (mean, deviation))


def fit_bootstrap(df: DataFrame, size: int = 1000, column: str = "residual", seed: int = 42) -> Noise:
    """A sample of ``size`` finite values, each as likely as any other: those with the smallest hashes.

    The sample is the feature; size bounds what reaches the driver. Equal values are told apart by a number.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))).groupBy("x").count()
    drawn = values.select("x", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("k")).orderBy(F.xxhash64(F.lit(seed), "x", "k"), "x", "k").limit(size)
    found = [r["x"] for r in drawn.collect()]
    if not found:
        raise ValueError("a fit needs a value")
    return Noise("bootstrap", tuple(found))


def fit_mixture(df: DataFrame, parts: int, rounds: int = 50, column: str = "residual", least: float = 1e-6) -> list[tuple[float, float, float]]:
    """(weight, mean, variance) of a mixture of normals by expectation maximisation, one aggregate a round."""
    x = df.select(F.col(column).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").persist()
    edges = x.agg(F.percentile_approx("x", [(2 * k + 1) / (2 * parts) for k in range(parts)], 10_000), F.var_pop("x")).first()
    model = [(1 / parts, m, max(edges[1] / parts**2, least)) for m in edges[0]]
    for _ in range(rounds):
        dense = [F.lit(w / math.sqrt(2 * math.pi * v)) * F.exp(-((F.col("x") - F.lit(m)) ** 2) / F.lit(2 * v)) for w, m, v in model]
        total = sum(dense[1:], dense[0]) + F.lit(1e-300)
        sums = []
        for k, d in enumerate(dense):
            r = d / total
            sums += [F.sum(r).alias(f"n{k}"), F.sum(r * F.col("x")).alias(f"s{k}"), F.sum(r * F.col("x") * F.col("x")).alias(f"q{k}")]
        row = x.agg(F.count("x").alias("n"), *sums).first()
        new = [(row[f"n{k}"] / row["n"], row[f"s{k}"] / row[f"n{k}"], max(row[f"q{k}"] / row[f"n{k}"] - (row[f"s{k}"] / row[f"n{k}"]) ** 2, least)) for k in range(len(model)) if row[f"n{k}"] / row["n"] > least]
        moved = max((abs(a[1] - b[1]) for a, b in zip(model, new)), default=0) if len(new) == len(model) else 1
        model = new
        if moved < 1e-6:
            break
    x.unpersist()
    return model
