"""Live robustness with Structured Streaming state, for formulas whose future operators have an end.

``monitor`` and ``monitor_bank`` give every sample's verdict once, when the watermark has passed what it depends
on. ``verdicts`` also gives bounds of it before that, renewed whenever a batch moves them, and the rows that are
refused; ``live_probability`` the same for the probability that a formula holds over noisy copies. Past operators
without an end and next are taken as well.

State for a series holds the samples that some window still reaches, in order of time, and one value for each past
operator without an end, so it follows the width of the windows and not the length of the stream. Samples may come
in any order within the delay. Of rows with one time the first is kept (in one batch: the one with the smallest margins).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparktl.operators.formula import INF, Formula
from sparktl.stats.noise import Noise, lift
from sparktl.streaming.bounds import Node, Seen, bounds, compiled, fold

STATE = "t array<double>, margins array<double>, given array<double>, done array<boolean>, until array<double>, carried array<double>, newest double"


@dataclass
class Machine:
    """What is done with the samples of one series: state in, rows out."""

    nodes: dict[str, Node]
    leaves: int
    carried: list[Node]
    members: int = 1
    strict: bool = False
    summed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = field(default=lambda low, high: (low[:, 0], high[:, 0]))

    @staticmethod
    def of(formulas: dict[str, Formula], **options) -> tuple[Machine, list[Formula]]:
        leaves: list[Formula] = []
        carried: list[Node] = []
        nodes = {name: compiled(f, leaves, carried) for name, f in formulas.items()}
        return Machine(nodes, len(leaves), carried, **options), leaves

    def opened(self, state: GroupState) -> tuple[Seen, np.ndarray, np.ndarray, float]:
        """The samples at hand, the bounds that were given for them, whether they are settled, and the newest time."""
        t, margins, given, done, until, carried, newest = state.get if state.exists else ([], [], [], [], [-INF] * len(self.carried), [n.empty() for n in self.carried for _ in range(self.members)], -INF)
        seen = Seen(np.array(t, float), np.array(margins, float).reshape(len(t), self.leaves, self.members), -INF, list(until), [*np.array(carried, float).reshape(len(self.carried), self.members)])
        return seen, np.array(given, float).reshape(len(t), 2 * len(self.nodes)), np.array(done, bool), newest

    def added(self, seen: Seen, given: np.ndarray, done: np.ndarray, rows: pd.DataFrame) -> tuple[Seen, np.ndarray, np.ndarray, pd.DataFrame]:
        """With a batch's rows taken in, all members of a sample or none; the rows that are not, and why."""
        margins, keys = [f"m{k}" for k in range(self.leaves)], ["t", "member"] if self.members > 1 else ["t"]
        rows = rows.sort_values([*keys, *margins], kind="stable").reset_index(drop=True)
        bad = ~np.isfinite(rows[margins].to_numpy(float)).all(1) & self.strict
        bad = rows["t"].isin(rows["t"][bad]) if self.members > 1 else bad
        why = np.select([rows["t"].isna(), rows["t"] <= seen.settled, bad, rows["t"].isin(seen.t)], ["no time", "late", "not finite", "repeated"], "").astype(object)
        why[(why == "") & ~rows.index.isin(rows[why == ""].drop_duplicates(keys).index)] = "repeated"
        new = rows[why == ""]
        t = new["t"].to_numpy(float)[:: self.members]
        values = new[margins].to_numpy(float).reshape(len(t), self.members, self.leaves).transpose(0, 2, 1)
        order = np.argsort(np.append(seen.t, t), kind="stable")
        join = lambda a, b: np.concatenate([a, b])[order]
        seen = Seen(join(seen.t, t), join(seen.margins, values), seen.settled, seen.until, seen.values)
        given, done = join(given, np.full((len(t), given.shape[1]), np.nan)), join(done, np.zeros(len(t), bool))
        return seen, given, done, rows.assign(refused=why)[why != ""]

    def judged(self, seen: Seen) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of every formula side by side, and whether all are settled."""
        found = [bounds(node, seen) for node in self.nodes.values()]
        both = [v for low, high, _ in found for v in self.summed(low, high)]
        return np.column_stack(both) if both else np.zeros((len(seen.t), 0)), np.logical_and.reduce([k for *_, k in found])

    def kept(self, seen: Seen, given: np.ndarray, done: np.ndarray, newest: float, state: GroupState) -> None:
        """Writes the state: what is settled and out of every window's reach is let go."""
        waiting = seen.t[~done]
        base = min(seen.settled, waiting.min(initial=INF))
        if base > -INF:
            needed = min([base, *[fold(node, seen, base) for node in self.nodes.values()]])
            stay = seen.t >= needed
            seen.t, seen.margins, given, done = seen.t[stay], seen.margins[stay], given[stay], done[stay]
        carried = np.concatenate(seen.values).tolist() if seen.values else []
        state.update((seen.t.tolist(), seen.margins.ravel().tolist(), given.ravel().tolist(), done.tolist(), list(map(float, seen.until)), carried, newest))


def _rows(samples: DataFrame, leaves: list[Formula], series: str, time: str, *more: Column) -> DataFrame:
    for leaf in leaves:
        leaf.expect(samples.columns)
    margins = [leaf.margin.cast("double").alias(f"m{k}") for k, leaf in enumerate(leaves)]
    return samples.select(F.col(series).cast("string").alias("series"), F.col(time).alias("_ts"), (F.unix_micros(F.col(time)) / F.lit(1e6)).alias("t"), *more, *margins)


def monitor(samples: DataFrame, formula: Formula, series: str, time: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """A streaming DataFrame (series, t, rho) with a verdict for every sample, in seconds since the epoch: see monitor_bank()."""
    return monitor_bank(samples, {"rho": formula}, series, time, delay)


def monitor_bank(samples: DataFrame, formulas: dict[str, Formula], series: str, time: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """Verdicts of several formulas over one state, in append mode: a column for each, given once all are settled.

    samples: streaming rows with the series column (string or number), a timestamp and the signals. Spark's own
    watermark says what is complete; Spark drops and counts the rows that are older. Atoms that are one object are kept once.
    """
    machine, leaves = Machine.of(formulas)
    horizon = max(n.horizon() for n in machine.nodes.values())

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, given, done, newest = machine.opened(state)
        mark = state.getCurrentWatermarkMs()
        seen.settled = mark / 1000 if mark > 0 else -INF
        for rows in batches:  # none, or an empty one, where time alone has passed
            seen, given, done, _ = machine.added(seen, given, done, rows)
        found, known = machine.judged(seen)
        ready = known & ~done
        if ready.any():
            yield pd.DataFrame({"series": key[0], "t": seen.t[ready], **{name: found[ready, 2 * k] for k, name in enumerate(machine.nodes)}})
        done = done | known
        waiting = seen.t[~done]
        machine.kept(seen, given, done, newest, state)
        if len(waiting):
            state.setTimeoutTimestamp(max(int((waiting[0] + horizon) * 1000) + 1, mark + 1))

    names = ", ".join(f"`{n}` double" for n in formulas)
    rows = _rows(samples.withWatermark(time, delay), leaves, series, time)
    return rows.groupBy("series").applyInPandasWithState(step, f"series string, t double, {names}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def verdicts(samples: DataFrame, formulas: dict[str, Formula], series: str, time: str = "ts", delay: float = 10.0, strict: bool = True) -> DataFrame:
    """Bounds of each formula at each sample, in update mode, and the rows that are not taken in.

    (series, t, <name>_low, <name>_high and <name>_decided for each formula, settled, refused). What comes later moves no
    value out of its bounds. A sample has a row in every batch that moves its bounds and a last one, settled, in which
    they meet. decided is the bound that tells the sign, once one does. A series' samples are complete up to its newest
    time less the delay in seconds, so a quiet series waits; no watermark is set, and no row is lost to one: each is
    taken in, or is a row with the reason in refused: "late", "repeated", "no time" or (strict) "not finite".
    """
    machine, leaves = Machine.of(formulas, strict=strict)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _moved(machine, key[0], pd.concat(list(batches)), state, delay)

    return _rows(samples, leaves, series, time).groupBy("series").applyInPandasWithState(step, "series string, t double, " + _columns(formulas) + "settled boolean, refused string", STATE, "update", GroupStateTimeout.NoTimeout)


def _columns(names) -> str:
    return "".join(f"`{n}_low` double, `{n}_high` double, `{n}_decided` double, " for n in names)


def _moved(machine: Machine, key: str | None, rows: pd.DataFrame, state: GroupState, delay: float) -> Iterator[pd.DataFrame]:
    """The rows of a batch: what is refused, and the samples whose bounds moved or that are now settled."""
    seen, given, done, newest = machine.opened(state)
    seen.settled = newest - delay
    seen, given, done, refused = machine.added(seen, given, done, rows)
    if len(refused):
        refused = refused[refused["member"] == 0] if "member" in refused else refused
        yield _given(machine, key, refused["t"].to_numpy(), np.full((len(refused), given.shape[1]), np.nan), np.zeros(len(refused), bool), refused["refused"].to_numpy())
    newest = max(newest, seen.t.max(initial=-INF))
    seen.settled = newest - delay
    found, known = machine.judged(seen)
    same = ((found == given) | (np.isnan(found) & np.isnan(given))).all(1)
    now = ~done & (known | ~same)
    if now.any():
        yield _given(machine, key, seen.t[now], found[now], known[now], None)
    machine.kept(seen, found, done | known, newest, state)


def _given(machine: Machine, key: str | None, t: np.ndarray, found: np.ndarray, known: np.ndarray, why: np.ndarray | None) -> pd.DataFrame:
    out = {"series": np.full(len(t), key, object), "t": t}
    for k, name in enumerate(machine.nodes):
        low, high = found[:, 2 * k], found[:, 2 * k + 1]
        out |= {f"{name}_low": low, f"{name}_high": high, f"{name}_decided": np.where(high < 0, high, np.where(low >= 0, low, np.where(known, low, np.nan)))}
    return pd.DataFrame(out | {"settled": known, "refused": why if why is not None else np.full(len(t), None, object)})


def live_probability(samples: DataFrame, formula: Formula, noise: dict[str, Noise], members: int, series: str, threshold: float, time: str = "ts", delay: float = 10.0, seed: int = 42) -> DataFrame:
    """Bounds of the share of noisy copies for which the formula holds, as verdicts() gives those of its robustness.

    (series, t, probability_low, probability_high, holds, settled, refused). low counts the copies that hold whatever
    comes, high those that still may; holds is null while these are on both sides of the threshold. Draws are those of
    ``stats.noise.lift`` for the same seed, series, member and time, so settled shares are those of the whole trace.
    """
    shares = lambda low, high: ((low >= 0).mean(1), (high >= 0).mean(1))
    machine, leaves = Machine.of({"probability": formula}, members=members, strict=True, summed=shares)
    timed = samples.select("*", (F.unix_micros(F.col(time)) / F.lit(1e6)).alias("_t"))
    rows = _rows(lift(timed, noise, members, [series], "_t", seed), leaves, series, time, F.col("member"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for out in _moved(machine, key[0], pd.concat(list(batches)), state, delay):
            low, high = out["probability_low"], out["probability_high"]
            holds = np.where(low >= threshold, True, np.where(high < threshold, False, None))
            yield out.assign(holds=holds)[["series", "t", "probability_low", "probability_high", "holds", "settled", "refused"]]

    return rows.groupBy("series").applyInPandasWithState(step, "series string, t double, probability_low double, probability_high double, holds boolean, settled boolean, refused string", STATE, "update", GroupStateTimeout.NoTimeout)


def align(*streams: tuple[DataFrame, dict[str, str]], time: str = "ts") -> DataFrame:
    """Several sources as one stream of rows: each row has the signals of its source, null for the others.

    A batch of such rows becomes a trace by ``hold``.
    """
    signals = sorted({s for _, names in streams for s in names})
    parts = [df.select(time, *[(F.col(names[s]).cast("double") if s in names else F.lit(None).cast("double")).alias(s) for s in signals]) for df, names in streams]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def align_live(rows: DataFrame, series: str, source: str, signals: list[str], sources: list[str], time: str = "ts") -> DataFrame:
    """hold() on a stream, in append mode: (series, t, signals), a row for each event time that every source has passed.

    rows: streaming, with the series, the name of the row's source, a timestamp and the signals it has, null for the others (as
    align() gives them). A source may be behind the others. A row at or before a time that was already given makes no row: its
    values are taken where no later ones are known. Rows before all signals have a value are left out, as are rows of unknown
    sources, and those without time. State is the rows that the slowest source has not passed.
    """
    signals, sources = list(signals), list(sources)
    columns = [F.col(series).cast("string").alias("series"), F.col(source).alias("_source"), (F.unix_micros(F.col(time)) / F.lit(1e6)).alias("t"), *[F.col(s).cast("double").alias(s) for s in signals]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # passed: newest time by source; held and since: last values and their times; waiting: rows not yet given
        passed, held, since, waiting = (list(x) for x in (state.get if state.exists else ([-INF] * len(sources), [np.nan] * len(signals), [-INF] * len(signals), [])))
        for rows in batches:
            rows = rows[rows["t"].notna() & rows["_source"].isin(sources)]
            for name, t in rows.groupby("_source")["t"].max().items():
                passed[sources.index(name)] = max(passed[sources.index(name)], t)
            waiting += rows[["t", *signals]].to_numpy(float).ravel().tolist()
        table = np.array(waiting, float).reshape(-1, 1 + len(signals))
        table = table[np.argsort(table[:, 0], kind="stable")]
        given = max(since, default=-INF)
        ready = table[:, 0] <= min(passed)
        out = []
        for row in table[ready]:
            fresh = row[0] > given
            for k, value in enumerate(row[1:]):
                if not np.isnan(value) and row[0] >= since[k]:
                    held[k], since[k] = value, row[0]
            if fresh and not np.isnan(held).any():
                out = out[:-1] if out and out[-1][0] == row[0] else out
                out.append([row[0], *held])
        if out:
            yield pd.DataFrame(out, columns=["t", *signals]).assign(series=key[0])[["series", "t", *signals]]
        state.update((*[list(map(float, x)) for x in (passed, held, since)], table[~ready].ravel().tolist()))

    schema = "series string, t double, " + ", ".join(f"`{s}` double" for s in signals)
    return rows.select(*columns).groupBy("series").applyInPandasWithState(step, schema, "passed array<double>, held array<double>, since array<double>, waiting array<double>", "append", GroupStateTimeout.NoTimeout)


def hold(rows: DataFrame, series: list[str], signals: list[str], time: str = "t") -> DataFrame:
    """Every signal's last value at each time of any signal; rows before all have one are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(*series).orderBy(time).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.groupBy(*series, time).agg(*[F.last(s, ignorenulls=True).alias(s) for s in signals])
    out = out.withColumns({s: F.last(s, ignorenulls=True).over(w) for s in signals})
    return out.dropna(subset=signals)
