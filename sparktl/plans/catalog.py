"""The temporal-logic queries registered with the driver, and their DuckDB counterparts.

Every query reads whole driver tables. Infinite robustness is written as +-1e308 so that it survives
any comparison of results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktl.functions import margins as m
from sparktl.operators import resample as rs
from sparktl.operators import smooth, temporal
from sparktl.operators.formula import INF, Formula, atom
from sparktl.sources.traces import daily, events
from sparktl.stats import checks
from sparktl.stats.noise import Noise, fit_gaussian, lift, residuals

HOUR, DAY = 3600.0, 86400.0
CHUNK = 10 * DAY
USER = ["user_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS t, value FROM events)"


def finite(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x == INF, F.lit(1e308)).when(x == -INF, F.lit(-1e308)).otherwise(x) + F.lit(0.0)


def sql_finite(x: str) -> str:
    return f"(CASE WHEN {x} = 'inf'::DOUBLE THEN 1e308::DOUBLE WHEN {x} = '-inf'::DOUBLE THEN -1e308::DOUBLE ELSE {x} END + 0.0::DOUBLE)"


def low_value() -> Formula:
    return atom(m.lt("value", 400))


def high_value() -> Formula:
    return atom(m.gt("value", 100))


def register(name: str, formula: Callable[[], Formula], sql: str, chunk: float | None = None) -> None:
    """A formula over events, by user; sql: SELECT user_id, event_id, t, rho over ev."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = formula()
        # one user with a third of very many events is several tasks where the formula can be split
        ev = events(spark, sf_dir)
        split = f.has_temporal() and (chunk or temporal.heavy(ev, USER))
        out = temporal.in_chunks(ev, f, USER, chunk or CHUNK) if split else temporal.robustness(ev, f, USER)
        return out.select("user_id", "event_id", "t", finite("rho").alias("rho"))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {EV}, x AS ({sql}) SELECT user_id, event_id, t, {sql_finite('rho')} AS rho FROM x"


def plain(name: str, formula: Callable[[], Formula], expression: str) -> None:
    register(name, formula, f"SELECT user_id, event_id, t, ({expression})::DOUBLE AS rho FROM ev")


plain("pred_gt", high_value, "value - 100")
plain("pred_le", low_value, "400 - value")
plain("pred_eq", lambda: atom(m.eq("value", 250)), "-abs(value - 250)")
plain("pred_ne", lambda: atom(m.ne("value", 250)), "abs(value - 250)")
plain("pred_arith", lambda: atom(m.gt(m.absolute(F.col("value") - 200) + F.col("value") % 7.0 * 2.0 - m.minimum(F.col("value"), 50), 10)), "abs(value - 200) + (value % 7.0::DOUBLE) * 2 - least(value, 50) - 10")
plain("pred_rounding", lambda: atom(m.gt(m.floor("value") + m.ceil(F.col("value") / 3.0) + m.sqrt("value"), 90)), "floor(value) + ceil(value / 3.0::DOUBLE) + sqrt(value) - 90")
plain("pred_power", lambda: atom(m.gt(m.power(F.col("value") / 100.0, 2), 4)), "pow(value / 100.0::DOUBLE, 2) - 4")
# rounded inside: library functions of two engines may differ in the last place
plain("pred_logs", lambda: atom(m.gt(F.round(m.ln("value") + m.log("value") * m.exp(F.col("value") / -500.0) + 1e-9, 6), 5)), "round(ln(value) + log10(value) * exp(value / -500.0::DOUBLE) + 1e-9, 6) - 5")
plain("pred_waves", lambda: atom(m.lt(F.round(m.sin("value") + m.cos("value") + m.tan(F.col("value") / 400.0) + 1e-9, 6), 1)), "1 - round(sin(value) + cos(value) + tan(value / 400.0::DOUBLE) + 1e-9, 6)")
plain("pred_maximum", lambda: atom(m.le(m.maximum("value", 30), 320)), "320 - greatest(value, 30)")
plain("bool_not", lambda: ~high_value(), "-(value - 100)")
plain("bool_and", lambda: high_value() & low_value(), "least(value - 100, 400 - value)")
plain("bool_or", lambda: high_value() | ~low_value(), "greatest(value - 100, value - 400)")
plain("bool_implies", lambda: high_value() >> low_value(), "greatest(100 - value, 400 - value)")

P = "PARTITION BY user_id"


def frame(low: str, high: str, order: str = "t") -> str:
    return f"OVER ({P} ORDER BY {order} RANGE BETWEEN {low} AND {high})"


def ahead(a: float, b: float) -> str:
    return frame("1e-9::DOUBLE PRECEDING" if a == 0 else f"{a - 1e-9!r}::DOUBLE FOLLOWING", f"{b + 1e-9!r}::DOUBLE FOLLOWING")


def behind(a: float, b: float) -> str:
    return frame(f"{b + 1e-9!r}::DOUBLE PRECEDING", "1e-9::DOUBLE FOLLOWING" if a == 0 else f"{a - 1e-9!r}::DOUBLE PRECEDING")


def window(name: str, make: Callable[[Formula], Formula], call: str, over: str, empty: str, chunk: float | None = None) -> None:
    register(name, lambda: make(low_value()), f"SELECT user_id, event_id, t, coalesce({call}(400 - value) {over}, '{empty}'::DOUBLE) AS rho FROM ev", chunk)


window("always_bounded", lambda f: f.always(0, DAY), "min", ahead(0, DAY), "inf")
window("always_offset", lambda f: f.always(HOUR, DAY), "min", ahead(HOUR, DAY), "inf")
window("always_unbounded", lambda f: f.always(), "min", frame("1e-9::DOUBLE PRECEDING", "UNBOUNDED FOLLOWING"), "inf")
window("eventually_bounded", lambda f: f.eventually(0, DAY), "max", ahead(0, DAY), "-inf")
window("eventually_offset", lambda f: f.eventually(HOUR, 2 * DAY), "max", ahead(HOUR, 2 * DAY), "-inf")
window("eventually_unbounded", lambda f: f.eventually(DAY), "max", frame(f"{DAY - 1e-9!r}::DOUBLE FOLLOWING", "UNBOUNDED FOLLOWING"), "-inf")
window("historically_bounded", lambda f: f.historically(0, DAY), "min", behind(0, DAY), "inf")
window("historically_offset", lambda f: f.historically(HOUR, DAY), "min", behind(HOUR, DAY), "inf")
window("historically_unbounded", lambda f: f.historically(), "min", frame("UNBOUNDED PRECEDING", "1e-9::DOUBLE FOLLOWING"), "inf")
window("once_bounded", lambda f: f.once(0, DAY), "max", behind(0, DAY), "-inf")
window("once_offset", lambda f: f.once(HOUR, 2 * DAY), "max", behind(HOUR, 2 * DAY), "-inf")
window("once_unbounded", lambda f: f.once(), "max", frame("UNBOUNDED PRECEDING", "1e-9::DOUBLE FOLLOWING"), "-inf")
window("always_chunked", lambda f: f.always(0, DAY), "min", ahead(0, DAY), "inf", chunk=5 * DAY)
register("next_op", lambda: low_value().next(), f"SELECT user_id, event_id, t, coalesce(lead(400 - value) OVER ({P} ORDER BY t), '-inf'::DOUBLE) AS rho FROM ev")
register(
    "next_chunked",
    lambda: low_value().next().eventually(),
    f"SELECT user_id, event_id, t, max(n) OVER ({P} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rho FROM (SELECT *, coalesce(lead(400 - value) OVER ({P} ORDER BY t), '-inf'::DOUBLE) AS n FROM ev)",
    chunk=CHUNK,
)


def nested(inner: str, inner_over: str, inner_empty: str, outer: str, outer_over: str, outer_empty: str, margin: str) -> str:
    return f"""SELECT user_id, event_id, t, coalesce({outer}(y) {outer_over}, '{outer_empty}'::DOUBLE) AS rho
  FROM (SELECT *, coalesce({inner}({margin}) {inner_over}, '{inner_empty}'::DOUBLE) AS y FROM ev)"""


register("always_eventually", lambda: high_value().eventually(0, DAY).always(0, 5 * DAY), nested("max", ahead(0, DAY), "-inf", "min", ahead(0, 5 * DAY), "inf", "value - 100"))
register("eventually_always", lambda: low_value().always(0, DAY).eventually(0, 5 * DAY), nested("min", ahead(0, DAY), "inf", "max", ahead(0, 5 * DAY), "-inf", "400 - value"))
register("response", lambda: (atom(m.gt("value", 300)) >> atom(m.lt("value", 100)).eventually(0, DAY)).always(0, 3 * DAY), f"""
  SELECT user_id, event_id, t, coalesce(min(greatest(300 - value, y)) {ahead(0, 3 * DAY)}, 'inf'::DOUBLE) AS rho
  FROM (SELECT *, coalesce(max(100 - value) {ahead(0, DAY)}, '-inf'::DOUBLE) AS y FROM ev)""")  # fmt: skip


def pairwise(low: float, high: float, forward: bool) -> str:
    """until or since from the definition: for each pair of samples the least phi on the way."""
    order = "s.t >= i.t" if forward else "s.t <= i.t"
    gap = "s.t - i.t" if forward else "i.t - s.t"
    way = f"w.t >= i.t AND w.t < s.t" if forward else "w.t <= i.t AND w.t > s.t"  # noqa: F541
    top = "" if high == INF else f" AND {gap} <= {high + 1e-9!r}"
    return f"""
  SELECT i.user_id, i.event_id, i.t, coalesce(max(least(p.psi, p.way)), '-inf'::DOUBLE) AS rho FROM ev i LEFT JOIN (
    SELECT i.user_id, i.t, s.t AS st, s.value - 100 AS psi, coalesce(min(400 - w.value), 'inf'::DOUBLE) AS way
    FROM ev i JOIN ev s ON i.user_id = s.user_id AND {order} AND {gap} >= {low - 1e-9!r}{top}
    LEFT JOIN ev w ON w.user_id = i.user_id AND {way} GROUP BY i.user_id, i.t, s.t, s.value) p ON p.user_id = i.user_id AND p.t = i.t
  GROUP BY i.user_id, i.event_id, i.t"""


OPEN = frame("1e-9::DOUBLE PRECEDING", "UNBOUNDED FOLLOWING")
register("always_eventually_unbounded", lambda: high_value().eventually().always(), nested("max", OPEN, "-inf", "min", OPEN, "inf", "value - 100"))

for _name, _low, _high in (("unbounded", 0, INF), ("late", DAY, INF), ("bounded", 0, 2 * DAY), ("offset", HOUR, 3 * DAY)):
    register(f"until_{_name}", lambda a=_low, b=_high: low_value().until(high_value(), a, b), pairwise(_low, _high, True))
    register(f"since_{_name}", lambda a=_low, b=_high: low_value().since(high_value(), a, b), pairwise(_low, _high, False))


def chunked(ev: DataFrame) -> float | None:
    """The length of chunks where users have so many events that one is more than a task should sort."""
    return CHUNK if temporal.heavy(ev, USER) else None


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("robustness_at_start", f"""
WITH {EV}, x AS (SELECT *, coalesce(max(value - 300) {ahead(0, 2 * DAY)}, '-inf'::DOUBLE) AS rho, row_number() OVER ({P} ORDER BY t) AS k FROM ev)
SELECT user_id, t, {sql_finite("rho")} AS rho, rho >= 0 AS holds FROM x WHERE k = 1""")  # fmt: skip
def robustness_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.at_start(events(spark, sf_dir), atom(m.gt("value", 300)).eventually(0, 2 * DAY), USER)
    return out.select("user_id", "t", finite("rho").alias("rho"), (F.col("rho") >= 0).alias("holds"))


def one_trace(a: float, b: float) -> str:
    return f"OVER (ORDER BY t RANGE BETWEEN {a + 1e-9!r}::DOUBLE PRECEDING AND {b + 1e-9!r}::DOUBLE FOLLOWING)"


@query("one_trace", f"""
WITH o AS (SELECT event_id, event_id::DOUBLE AS t, value FROM events), x AS (SELECT *, max(value - 250) {one_trace(0, 10)} AS y FROM o)
SELECT event_id, t, {sql_finite(f"min(y) {one_trace(0, 100)}")} AS rho FROM x""")
def one_trace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one trace by number, in chunks: always within 100 a value over 250 within 10."""
    trace = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("double").alias("t"), "value")
    out = temporal.robustness(trace, atom(m.gt("value", 250)).eventually(0, 10).always(0, 100), [], chunk=10_000.0)
    return out.select("event_id", "t", finite("rho").alias("rho"))


@query("one_trace_wide", f"""
WITH o AS (SELECT event_id, event_id::DOUBLE AS t, value FROM events)
SELECT event_id, t, {sql_finite(f"min(400 - value) {one_trace(0, 5000)}")} AS rho FROM o""")
def one_trace_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 5,000 samples costs what one of 100 costs."""
    trace = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_id").cast("double").alias("t"), "value")
    return temporal.robustness(trace, low_value().always(0, 5000), [], chunk=20_000.0).select("event_id", "t", finite("rho").alias("rho"))


@query("violations", f"""
WITH {EV}, x AS (SELECT *, min(300 - value) {behind(0, DAY)} AS rho FROM ev),
y AS (SELECT *, rho < 0 AS bad, coalesce(lag(rho < 0) OVER ({P} ORDER BY t), false) AS was FROM x),
z AS (SELECT *, sum((bad AND NOT was)::INT) OVER ({P} ORDER BY t) AS run FROM y)
SELECT user_id, min(t) AS "start", max(t) AS "end", min(rho) AS lowest FROM z WHERE bad GROUP BY user_id, run""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return temporal.violations(temporal.robustness(ev, atom(m.lt("value", 300)).historically(0, DAY), USER, chunk=chunked(ev)), USER, chunk=chunked(ev))


@query("bank_multi", f"""
WITH {EV} SELECT user_id, event_id, t, min(400 - value) {ahead(0, DAY)} AS calm, max(-(min_)) {ahead(0, DAY)} AS storm, least(min_, value - 100) AS steady
FROM (SELECT *, min(400 - value) {behind(0, HOUR)} AS min_ FROM ev)""")
def bank_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = low_value()
    recent = low.historically(0, HOUR)
    return temporal.bank(events(spark, sf_dir), {"calm": low.always(0, DAY), "storm": (~recent).eventually(0, DAY), "steady": recent & high_value()}, USER).select("user_id", "event_id", "t", "calm", "storm", "steady")


GRID = "g AS (SELECT user_id, unnest(range(0, 30)) * 86400.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM ev))"


def grid(ev: DataFrame) -> DataFrame:
    return ev.select("user_id").distinct().withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: k * F.lit(DAY))))


@query("resample_linear", f"""
WITH {EV}, {GRID}, b AS (SELECT g.user_id, g.t, e.t AS t0, e.value AS v0 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.t >= e.t),
c AS (SELECT b.*, e.t AS t1, e.value AS v1 FROM b ASOF LEFT JOIN ev e ON b.user_id = e.user_id AND b.t <= e.t)
SELECT user_id, t, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 WHEN t1 = t THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS value FROM c""")
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return rs.resample(ev, grid(ev), USER, ["value"], chunk=chunked(ev))


@query("resample_hold", f"""
WITH {EV}, {GRID}, b AS (SELECT g.user_id, g.t, e.value AS v0 FROM g ASOF LEFT JOIN ev e ON g.user_id = e.user_id AND g.t >= e.t)
SELECT user_id, t, coalesce(v0, first) AS value FROM b JOIN (SELECT user_id, arg_min(value, t) AS first FROM ev GROUP BY user_id) USING (user_id)""")
def resample_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return rs.resample(ev, grid(ev), USER, ["value"], method="hold", chunk=chunked(ev))


# natural cubic splines: the second derivatives by a sweep forward and one back over each user's samples
@query("resample_cubic", f"""
WITH RECURSIVE {EV}, {GRID},
k AS (SELECT user_id, t, value AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, (value - lag(value) OVER w) / (t - lag(t) OVER w) AS s0, (lead(value) OVER w - value) / (lead(t) OVER w - t) AS s1 FROM ev WINDOW w AS ({P} ORDER BY t)),
f(user_id, i, c, d) AS (SELECT user_id, i, 0::DOUBLE, 0::DOUBLE FROM k WHERE i = 1 UNION ALL
  SELECT k.user_id, k.i, CASE WHEN k.i < k.n THEN h1 / (2 * (h0 + h1) - h0 * c) ELSE 0 END, CASE WHEN k.i < k.n THEN (3 * (s1 - s0) - h0 * d) / (2 * (h0 + h1) - h0 * c) ELSE 0 END FROM f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1),
b(user_id, i, m) AS (SELECT user_id, n, 0::DOUBLE FROM k WHERE i = 1 UNION ALL SELECT f.user_id, f.i, d - c * m FROM b JOIN f ON f.user_id = b.user_id AND f.i = b.i - 1),
z AS (SELECT k.user_id, k.t, k.v, m FROM k JOIN b USING (user_id, i)),
x AS (SELECT a.*, q.t AS t1, q.v AS v1, q.m AS m1 FROM (SELECT g.user_id, g.t, p.t AS t0, p.v AS v0, p.m AS m0 FROM g ASOF LEFT JOIN z p ON g.user_id = p.user_id AND g.t >= p.t) a ASOF LEFT JOIN z q ON a.user_id = q.user_id AND a.t <= q.t)
SELECT user_id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 WHEN t1 = t THEN v1
  ELSE v0 + (t - t0) * (((v1 - v0) / (t1 - t0) - (t1 - t0) * (m1 + 2 * m0) / 3) + (t - t0) * (m0 + (t - t0) * (m1 - m0) / (3 * (t1 - t0)))) END, 6) AS value FROM x""")
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return rs.resample(ev, grid(ev), USER, ["value"], method="cubic").withColumn("value", F.round("value", 6))


# rounded: sums in another order differ in the last places
@query("smooth_always", f"""
WITH {EV} SELECT user_id, event_id, t, round(low - ln(list_sum(list_transform(near, lambda v: exp(-0.05::DOUBLE * (v - low))))) / 0.05::DOUBLE, 6) + 0.0::DOUBLE AS rho
FROM (SELECT *, min(400 - value) {ahead(0, DAY)} AS low, list(400 - value) {ahead(0, DAY)} AS near FROM ev)""")
def smooth_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.robustness(events(spark, sf_dir), low_value().always(0, DAY), USER, chunk=CHUNK, lowering=smooth.log_sum_exp(0.05))
    return out.select("user_id", "event_id", "t", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))


@query("smooth_once", f"""
WITH {EV}, y AS (SELECT *, 100 - value AS y FROM ev), w AS (SELECT *, min(y) {behind(0, DAY)} AS least, count(*) {behind(0, DAY)} AS n,
  sum(CASE WHEN y > 0 THEN ln(y) ELSE 0 END) {behind(0, DAY)} AS logs, sum(CASE WHEN y <= 0 THEN y ELSE 0 END) {behind(0, DAY)} AS low FROM y)
SELECT user_id, event_id, t, round(-(CASE WHEN least > 0 THEN exp(logs / n) ELSE low / n END), 6) + 0.0::DOUBLE AS rho FROM w""")
def smooth_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.robustness(events(spark, sf_dir), high_value().once(0, DAY), USER, chunk=CHUNK, lowering=smooth.arithmetic_geometric())
    return out.select("user_id", "event_id", "t", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))


@query("buffer_stats", f"""
WITH {EV} SELECT user_id, event_id, t, count(value) OVER w AS recent_n, round(avg(value) OVER w, 6) AS recent_mean, round(var_samp(value) OVER w + 3.7e-7, 5) AS recent_var,
min(value) OVER w AS recent_min, max(value) OVER w AS recent_max FROM ev WINDOW w AS ({P} ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def buffer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.recent(events(spark, sf_dir), USER, "value", 10)
    return out.select("user_id", "event_id", "t", "recent_n", F.round("recent_mean", 6).alias("recent_mean"), F.round(F.col("recent_var") + 3.7e-7, 5).alias("recent_var"), "recent_min", "recent_max")


@query("buffer_closest", f"""
WITH {EV} SELECT user_id, event_id, t, value FROM (SELECT *, row_number() OVER ({P} ORDER BY abs(t - 1e6), t) AS k FROM ev) WHERE k = 1""")
def buffer_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.closest(events(spark, sf_dir), USER, 1e6).select("user_id", "event_id", "t", "value")


@query("buffer_latest", f"WITH {EV} SELECT user_id, event_id, t, value FROM (SELECT *, row_number() OVER ({P} ORDER BY t DESC) AS k FROM ev) WHERE k <= 5")
def buffer_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.latest(events(spark, sf_dir), USER, 5).select("user_id", "event_id", "t", "value")


@query("buffer_between", f"WITH {EV} SELECT user_id, event_id, t, value FROM ev WHERE t >= {5 * DAY - 1e-9!r} AND t <= {9 * DAY + 1e-9!r}")
def buffer_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.between(events(spark, sf_dir), 5 * DAY, 9 * DAY).select("user_id", "event_id", "t", "value")


MEMBERS, SPREAD = 20, 80.0
RUNS = f"""{EV}, n AS (SELECT ev.*, k AS member FROM ev, range({MEMBERS}) r(k) WHERE t <= (SELECT min(t) FROM ev e WHERE e.user_id = ev.user_id) + {DAY + 1e-9!r}),
u AS (SELECT *, (('0x' || substr(md5('42|' || user_id || '|' || member || '|' || round(t * 1e6)::BIGINT || '|value|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52) AS u FROM n),
r AS (SELECT user_id, member, min(400 - (value + ({-SPREAD!r}::DOUBLE + {2 * SPREAD!r}::DOUBLE * u))) AS rho FROM u GROUP BY user_id, member)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.realisations(events(spark, sf_dir), low_value().always(0, DAY), {"value": Noise("uniform", (-SPREAD, SPREAD))}, MEMBERS, USER)


Z = checks.z_of(0.95)
WILSON = f"""greatest(0.0, (p + {Z!r} * {Z!r} / (n * 2) - {Z!r} * sqrt(p * (1 - p) / n + {Z!r} * {Z!r} / (n * n * 4))) / (1 + {Z!r} * {Z!r} / n)) AS low,
least(1.0, (p + {Z!r} * {Z!r} / (n * 2) + {Z!r} * sqrt(p * (1 - p) / n + {Z!r} * {Z!r} / (n * n * 4))) / (1 + {Z!r} * {Z!r} / n)) AS high"""


@query("smc_check", f"""
WITH {RUNS}, c AS (SELECT user_id, count(*) AS samples, count(CASE WHEN rho >= 0 THEN 1 END) AS satisfied, count(*)::DOUBLE AS n, count(CASE WHEN rho >= 0 THEN 1 END)::DOUBLE / count(*) AS p FROM r GROUP BY user_id),
w AS (SELECT *, {WILSON} FROM c)
SELECT user_id, samples, satisfied, p AS probability, round(low, 9) AS low, round(high, 9) AS high, p >= 0.9 AS holds FROM w""")
def smc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = checks.check(runs(spark, sf_dir), USER, 0.9)
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9)})


@query("smc_distribution", f"WITH {RUNS} SELECT user_id, count(*) AS samples, round(avg(rho), 6) AS mean, round(var_pop(rho), 4) AS variance, min(rho) AS least, max(rho) AS greatest FROM r GROUP BY user_id")
def smc_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.distribution(runs(spark, sf_dir), USER).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query("smc_sequential", f"""
WITH {RUNS}, s AS (SELECT user_id, count(*) OVER w AS n, count(CASE WHEN rho >= 0 THEN 1 END) OVER w AS k FROM r WINDOW w AS ({P} ORDER BY member)),
v AS (SELECT *, k * ln(0.95 / 0.85) + (n - k) * ln((1 - 0.95) / (1 - 0.85)) AS ratio FROM s),
d AS (SELECT *, CASE WHEN ratio >= ln(0.9 / 0.1) THEN 'accept_h1' WHEN ratio <= ln(0.1 / 0.9) THEN 'accept_h0' END AS decision FROM v)
SELECT user_id, coalesce(arg_min(decision, n) FILTER (decision IS NOT NULL), 'inconclusive') AS decision, coalesce(min(n) FILTER (decision IS NOT NULL), max(n)) AS members FROM d GROUP BY user_id""")
def smc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.sequential(runs(spark, sf_dir), USER, 0.85, 0.95, 0.1, 0.1)


@query("intervals", f"""
WITH c AS (SELECT user_id, count(*)::DOUBLE AS n, count(CASE WHEN value < 50 THEN 1 END)::DOUBLE AS k FROM events GROUP BY user_id),
a AS (SELECT user_id, n, k / n AS p, n + {Z!r} * {Z!r} AS m, (k + {Z!r} * {Z!r} / 2) / (n + {Z!r} * {Z!r}) AS q FROM c), w AS (SELECT *, {WILSON} FROM a)
SELECT user_id, round(low, 9) AS wilson_low, round(high, 9) AS wilson_high, round(greatest(0.0, q - {Z!r} * sqrt(q * (1 - q) / m)), 9) AS agresti_low, round(least(1.0, q + {Z!r} * sqrt(q * (1 - q) / m)), 9) AS agresti_high FROM w""")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("value") < 50).cast("double").alias("k"))
    (wl, wh), (al, ah) = checks.wilson(F.col("k"), F.col("n")), checks.agresti_coull(F.col("k"), F.col("n"))
    return counts.select("user_id", F.round(wl, 9).alias("wilson_low"), F.round(wh, 9).alias("wilson_high"), F.round(al, 9).alias("agresti_low"), F.round(ah, 9).alias("agresti_high"))


@query("fit_gaussian", "SELECT round(avg(l_extendedprice / l_quantity - p_retailprice), 6) AS mean, round(stddev_samp(l_extendedprice / l_quantity - p_retailprice), 6) AS deviation FROM lineitem JOIN part ON l_partkey = p_partkey")
def fit_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit")).join(part, "l_partkey")
    found = fit_gaussian(residuals(items, "unit", "p_retailprice"))
    return spark.range(1).select(F.round(F.lit(found.params[0]), 6).alias("mean"), F.round(F.lit(found.params[1]), 6).alias("deviation"))


def days(table: str, key: str, date: str, value: str) -> str:
    return f"d AS (SELECT {key}, (epoch_us({date}) / 86400000000)::DOUBLE AS t, {value} AS x FROM {table} GROUP BY ALL)"


@query("recurrence_orders", f"""
WITH {days("orders", "o_custkey", "o_orderdate", "max(o_totalprice)")},
y AS (SELECT *, max(x - 250000) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN 1e-9::DOUBLE PRECEDING AND 365.000000001::DOUBLE FOLLOWING) AS e FROM d)
SELECT o_custkey, t, min(e) OVER (PARTITION BY o_custkey ORDER BY t RANGE BETWEEN 1e-9::DOUBLE PRECEDING AND 730.000000001::DOUBLE FOLLOWING) AS rho FROM y""")
def recurrence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir, "orders", "o_custkey", "o_orderdate", F.max("o_totalprice"))
    return temporal.robustness(d, atom(m.gt("x", 250000)).eventually(0, 365).always(0, 730), ["o_custkey"]).select("o_custkey", "t", "rho")


@query("drawdown_shipments", f"""
WITH {days("lineitem", "l_suppkey", "l_shipdate", "max(l_quantity)")}
SELECT l_suppkey, t, greatest(10 - x, max(x - 30) OVER (PARTITION BY l_suppkey ORDER BY t RANGE BETWEEN 1e-9::DOUBLE PRECEDING AND 30.000000001::DOUBLE FOLLOWING)) + 0.0::DOUBLE AS rho FROM d""")
def drawdown_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", F.max("l_quantity"))
    f = atom(m.gt("x", 10)) >> atom(m.gt("x", 30)).eventually(0, 30)
    return temporal.robustness(d, f, ["l_suppkey"]).select("l_suppkey", "t", finite("rho").alias("rho"))


# the least of 400 - value and value - 100, which meet at 250, with a breakpoint where they do
BAND = """SELECT user_id, t, least(400 - value, value - 100) AS x, true AS s FROM ev UNION ALL
  SELECT user_id, t + (t1 - t) * f, (400 - value) + ((400 - v1) - (400 - value)) * f, false FROM (
    SELECT *, d0 / (d0 - d1) AS f FROM (SELECT *, (400 - value) - (value - 100) AS d0, (400 - v1) - (v1 - 100) AS d1 FROM (
      SELECT *, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t))) WHERE sign(d0) * sign(d1) < 0)"""


def dense(name: str, kind: str, call: str, pick: str, low: float, high: float, over: str, band: bool = False) -> None:
    from sparktl.operators import dense as operators

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ev = events(spark, sf_dir)
        if band:
            signal = operators.combine(ev, "and", m.lt("value", 400), m.gt("value", 100), USER)
            return operators.window(signal, F.col("rho"), kind, low, high, USER, samples="sample")
        return operators.window(ev, m.lt("value", 400), kind, low, high, USER)

    side = 1 if kind in ("always", "eventually") else -1
    edge = lambda n, by: f"""
e{n} AS (SELECT b.user_id, b.at, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 WHEN t1 = t THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS x FROM (
  SELECT a.*, n.t AS t1, n.x AS v1 FROM (SELECT q.user_id, q.at, q.t, p.t AS t0, p.x AS v0 FROM (SELECT user_id, t AS at, t + ({side * by!r}::DOUBLE) AS t FROM d) q ASOF LEFT JOIN d p ON q.user_id = p.user_id AND q.t >= p.t) a
  ASOF LEFT JOIN d n ON a.user_id = n.user_id AND a.t <= n.t) b)"""
    QUERIES[f"dense_{name}"] = run
    ORACLES[f"dense_{name}"] = f"""WITH {EV}, d AS ({BAND if band else "SELECT user_id, t, 400 - value AS x, true AS s FROM ev"}), {edge(0, low)}, {edge(1, high)},
i AS (SELECT user_id, t, s, {call}(x) {over} AS y FROM d)
SELECT i.user_id, i.t, {pick}(coalesce(y, e0.x), e0.x, e1.x) AS rho FROM i JOIN e0 ON e0.user_id = i.user_id AND e0.at = i.t JOIN e1 ON e1.user_id = i.user_id AND e1.at = i.t WHERE i.s"""


dense("always", "always", "min", "least", HOUR, DAY, ahead(HOUR, DAY))
dense("once", "once", "max", "greatest", 0.0, DAY, behind(0, DAY))
dense("eventually_band", "eventually", "max", "greatest", HOUR, DAY, ahead(HOUR, DAY), band=True)
dense("historically_band", "historically", "min", "least", 0.0, DAY, behind(0, DAY), band=True)


def read_off(name: str, asked: str, by: str = "ev", value: str = "value") -> str:
    """The values of by at the asked (user_id, t), on the lines between its rows."""
    return f"""{name} AS (SELECT user_id, t, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = t THEN v0 WHEN t1 = t THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM (
  SELECT a.*, n.t AS t1, n.{value} AS v1 FROM (SELECT q.user_id, q.t, p.t AS t0, p.{value} AS v0 FROM ({asked}) q ASOF LEFT JOIN {by} p ON q.user_id = p.user_id AND q.t >= p.t) a
  ASOF LEFT JOIN {by} n ON a.user_id = n.user_id AND a.t <= n.t))"""


def dense_chain(kind: str, low: float, high: float) -> None:
    """until or since in continuous time; rounded, as the rows between samples are found in another order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from sparktl.operators import dense as operators

        f = getattr(low_value(), kind)(high_value(), low, high)
        return operators.robustness(events(spark, sf_dir), f, USER).select("user_id", "t", F.round(finite("rho"), 6).alias("rho"))

    side = 1 if kind == "until" else -1
    reach, gap, order = (f"s.t >= i.t AND s.t <= i.t + {high + 1e-9!r}::DOUBLE", "s.t - i.t", "s.t") if kind == "until" else (f"s.t <= i.t AND s.t >= i.t - {high + 1e-9!r}::DOUBLE", "i.t - s.t", "s.t DESC")
    own = "greatest(rho, psi)" if low == 0 else "rho"
    QUERIES[f"dense_{kind}"] = run
    ORACLES[f"dense_{kind}"] = f"""
WITH {EV}, b AS ({BAND}), dom AS (SELECT user_id, min(t) AS low, max(t) AS high FROM ev GROUP BY user_id),
p AS (SELECT p.user_id, p.t FROM (SELECT user_id, t FROM b UNION SELECT user_id, t + ({side * low!r}::DOUBLE) FROM ev UNION SELECT user_id, t + ({side * high!r}::DOUBLE) FROM ev) p JOIN dom USING (user_id) WHERE p.t BETWEEN dom.low AND dom.high),
{read_off("g", "SELECT user_id, t FROM p")},
w AS (SELECT i.user_id, i.t, i.value - 100 AS psi, {gap} AS gap, least(400 - s.v, s.v - 100) AS h, min(400 - s.v) OVER (PARTITION BY i.user_id, i.t ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS way
  FROM ev i JOIN g s ON i.user_id = s.user_id AND {reach}),
x AS (SELECT user_id, t, any_value(psi) AS psi, coalesce(max(least(h, coalesce(way, 'inf'::DOUBLE))) FILTER (gap >= {low - 1e-9!r}), '-inf'::DOUBLE) AS rho FROM w GROUP BY user_id, t)
SELECT user_id, t, round({sql_finite(own)}, 6) AS rho FROM x"""


dense_chain("until", 0.0, 2 * DAY)
dense_chain("since", HOUR, 3 * DAY)


@query("dense_always_eventually", f"""
WITH {EV}, dom AS (SELECT user_id, min(t) AS low, max(t) AS high FROM ev GROUP BY user_id),
q AS (SELECT q.user_id, q.t, q.t + {DAY!r}::DOUBLE AS u FROM (SELECT user_id, t FROM ev UNION SELECT user_id, t - {DAY!r}::DOUBLE FROM ev UNION SELECT user_id, t + {2 * DAY!r}::DOUBLE FROM ev) q JOIN dom USING (user_id) WHERE q.t BETWEEN dom.low AND dom.high),
{read_off("r", "SELECT user_id, t FROM q UNION SELECT user_id, u FROM q")},
e AS (SELECT q.user_id, q.t, q.u, a.v AS low0, b.v AS high0, lead(q.t) OVER w AS t1, lead(a.v) OVER w AS low1, lead(b.v) OVER w AS high1
  FROM q JOIN r a ON a.user_id = q.user_id AND a.t = q.t JOIN r b ON b.user_id = q.user_id AND b.t = q.u WINDOW w AS (PARTITION BY q.user_id ORDER BY q.t)),
c AS (SELECT e.user_id, e.t, any_value(e.t1) AS t1, any_value(low0) AS low0, any_value(high0) AS high0, any_value(low1) AS low1, any_value(high1) AS high1,
  max(ev.value) AS here, max(ev.value) FILTER (ev.t >= e.t1) AS c FROM e LEFT JOIN ev ON ev.user_id = e.user_id AND ev.t BETWEEN e.t AND e.u GROUP BY e.user_id, e.t),
y AS (SELECT user_id, t, t1, greatest(low0, high0, coalesce(here, low0)) AS y, greatest(coalesce(c, '-inf'::DOUBLE), least(greatest(low0, high0), greatest(low1, high1),
  CASE WHEN sign(low0 - high0) * sign(low1 - high1) < 0 THEN low0 + (low1 - low0) * (low0 - high0) / ((low0 - high0) - (low1 - high1)) ELSE 'inf'::DOUBLE END)) AS m FROM c)
SELECT i.user_id, i.t, round(min(least(y.y, CASE WHEN y.t1 <= i.t + {2 * DAY!r}::DOUBLE THEN y.m ELSE 'inf'::DOUBLE END)) - 100, 6) AS rho
FROM ev i JOIN y ON y.user_id = i.user_id AND y.t >= i.t AND y.t <= i.t + {2 * DAY!r}::DOUBLE GROUP BY i.user_id, i.t""")
def dense_always_eventually(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window within a window in continuous time: the inner one is a signal with a row at each bend."""
    from sparktl.operators import dense as operators

    f = high_value().eventually(0, DAY).always(0, 2 * DAY)
    return operators.robustness(events(spark, sf_dir), f, USER).select("user_id", "t", F.round("rho", 6).alias("rho"))


@query("mine_threshold", f"""
WITH {EV} SELECT round(max(value), 3) AS theta FROM (SELECT *, min(t) OVER ({P}) AS t0 FROM ev) WHERE t <= t0 + {10 * DAY + 1e-9!r}""")
def mine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest bound (to 1e-3) that the first ten days of every user stay below."""
    from sparktl.stats.mining import tightest

    found = tightest(events(spark, sf_dir), lambda theta: atom(m.lt("value", theta)).always(0, 10 * DAY), 1000.0, 0.0, USER)
    return spark.createDataFrame([(float(found),)], "theta double").select(F.round("theta", 3).alias("theta"))


@query("smc_bayesian", f"""
WITH {RUNS}, s AS (SELECT user_id, row_number() OVER w AS n, count(CASE WHEN rho >= 0 THEN 1 END) OVER w AS k FROM r WINDOW w AS ({P} ORDER BY member)),
p AS (SELECT n, k, sum(exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n - j + 2) + j * ln(0.8) + (n + 1 - j) * ln(0.2))) AS p
  FROM (SELECT DISTINCT n, k, unnest(range(0, k + 1)) AS j FROM s) GROUP BY n, k),
v AS (SELECT user_id, n, CASE WHEN p * 0.8 >= 10 * (1 - p) * 0.2 THEN 'holds' WHEN (1 - p) * 0.2 >= 10 * p * 0.8 THEN 'fails' END AS v FROM s JOIN p USING (n, k))
SELECT user_id, coalesce(arg_min(v, n) FILTER (v IS NOT NULL), 'inconclusive') AS decision, coalesce(min(n) FILTER (v IS NOT NULL), max(n)) AS members FROM v GROUP BY user_id""")
def smc_bayesian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.bayesian(runs(spark, sf_dir), USER, 0.8, 10.0)


@query("smc_conservative", f"""
WITH {RUNS}, c AS (SELECT user_id, count(*) AS samples, count(CASE WHEN rho >= 0 THEN 1 END) AS satisfied FROM r GROUP BY user_id),
j AS (SELECT *, unnest(range(satisfied, samples + 1)) AS j FROM c)
SELECT user_id, samples, satisfied, satisfied / samples AS probability, sum(exp(lgamma(samples + 1) - lgamma(j + 1) - lgamma(samples - j + 1) + j * ln(0.8) + (samples - j) * ln(0.2))) <= 0.025 AS holds
FROM j GROUP BY ALL""")
def smc_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact interval's lower end reaches 0.8 where so many successes have a chance of 2.5 % at most under 0.8."""
    return checks.conservative(runs(spark, sf_dir), USER, 0.8).select("user_id", "samples", "satisfied", "probability", "holds")


@query("lift_factor", f"""
WITH {EV}, n AS (SELECT ev.*, k AS member FROM ev, range(3) r(k)),
u AS (SELECT *, (('0x' || substr(md5('42|' || user_id || '|' || member || '|' || round(t * 1e6)::BIGINT || '|value|0'), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52) AS u FROM n)
SELECT user_id, event_id, t, member, value * (0.9::DOUBLE + {1.1 - 0.9!r}::DOUBLE * u) AS value FROM u""")
def lift_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lift(events(spark, sf_dir), {"value": Noise("uniform", (0.9, 1.1), additive=False)}, 3, USER)
    return out.select("user_id", "event_id", "t", F.col("member").cast("long").alias("member"), "value")


@query("smc_chance", f"""
WITH {RUNS}, c AS (SELECT user_id, count(*)::DOUBLE AS n, count(CASE WHEN rho >= 0 THEN 1 END)::DOUBLE / count(*) AS p FROM r GROUP BY user_id), w AS (SELECT *, {WILSON} FROM c)
SELECT user_id, p AS probability, low >= {0.65 + 0.05!r} AS holds FROM w""")
def smc_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.chance(runs(spark, sf_dir), USER, 0.65, 0.05).select("user_id", "probability", "holds")
