"""Streaming verdicts equal those of the whole trace, whatever the order of arrival within the delay."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparktl.functions import margins as m
from sparktl.operators import temporal
from sparktl.operators.formula import INF, atom
from sparktl.stats import checks
from sparktl.stats.noise import Noise
from sparktl.streaming import files
from sparktl.streaming import monitor as live
from sparktl.streaming.bounds import Seen, bounds


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(s, 1_700_000_000 + 3 * k, r.uniform(-5, 5), r.uniform(-5, 5)) for s in ("a", "b") for k in range(60)]
    x, y = atom(m.gt("x", 0)), atom(m.gt("y", 0))
    f = (x.until(y, 0, 12) | y.historically(3, 15)) & x.eventually(0, 9)
    order = sorted(rows, key=lambda q: q[1] + r.uniform(0, 8))
    path = str(tmp_path / "in")
    for k in range(0, len(order), 30):
        spark.createDataFrame(order[k : k + 30], "s string, e long, x double, y double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("s string, e long, x double, y double").option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_seconds("e"))
    out = live.monitor(stream, f, "s")
    q = out.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(v["series"], v["t"]): v["rho"] for v in spark.table("verdicts").collect()}
    whole = temporal.robustness(spark.createDataFrame([(a, float(b), c, d) for a, b, c, d in rows], "s string, t double, x double, y double"), f, ["s"])
    want = {(v["s"], v["t"]): v["rho"] for v in whole.collect()}
    assert len(got) >= 60 and all(want[k] == v for k, v in got.items())


def test_unbounded_is_refused(spark):
    with pytest.raises(ValueError):
        live.monitor(spark.range(1).withColumn("ts", F.current_timestamp()), atom(m.gt("id", 0)).always(), "id")
    with pytest.raises(ValueError):
        live.verdicts(spark.range(1).withColumn("ts", F.current_timestamp()), {"f": atom(m.gt("id", 0)).until(atom(m.gt("id", 0)), 2)}, "id")


def test_hold(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0, None), (1, 1.0, None, 7.0), (1, 2.0, 6.0, None), (1, 2.0, None, 8.0)], "s int, t double, x double, y double")
    assert [tuple(r)[1:] for r in live.hold(rows, ["s"], ["x", "y"]).orderBy("t").collect()] == [(1.0, 5.0, 7.0), (2.0, 6.0, 8.0)]


def test_bank_of_formulas_and_nan(spark, tmp_path):
    """Several formulas share one state, and NaN is passed over as in the whole trace."""
    r = random.Random(9)
    rows = [("a", 1_700_000_000 + 2 * k, float("nan") if k % 7 == 3 else r.uniform(-5, 5), r.uniform(-5, 5)) for k in range(60)]
    x, y = atom(m.gt("x", 0)), atom(m.gt("y", 0))
    formulas = {"seen": x.once(0, 6) & y, "soon": (x | y).eventually(0, 4), "calm": (x >> y).always(0, 4)}
    path = str(tmp_path / "in")
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], "s string, e long, x double, y double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("s string, e long, x double, y double").option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_seconds("e"))
    q = live.monitor_bank(stream, formulas, "s").writeStream.format("memory").queryName("bank").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {v["t"]: (v["seen"], v["soon"], v["calm"]) for v in spark.table("bank").collect()}
    whole = temporal.bank(spark.createDataFrame([(a, float(b), c, d) for a, b, c, d in rows], "s string, t double, x double, y double"), formulas, ["s"])
    want = {v["t"]: (v["seen"], v["soon"], v["calm"]) for v in whole.collect()}
    assert len(got) >= 30 and all(want[k] == v for k, v in got.items())


class State:
    """What the state of a group is to a step function."""

    value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def drawn(r, x, y, depth):
    if depth == 0:
        return r.choice([x, y])
    one, two = drawn(r, x, y, depth - 1), drawn(r, x, y, r.randrange(depth))
    low = r.choice([0, 0, 1, 2.5])
    high = low + r.choice([0, 3, 7.5])
    end = r.choice([high, INF])
    kinds = [
        lambda: ~one, lambda: one & two, lambda: one | two, lambda: one >> two, lambda: one.always(low, high), lambda: one.eventually(low, high), lambda: one.historically(low, end),
        lambda: one.once(low, end), lambda: one.until(two, low, high), lambda: one.since(two, low, end), lambda: one.next(),
    ]
    return kinds[r.randrange(len(kinds))]()


@pytest.mark.parametrize("seed", range(60))
def test_bounds_are_sound_and_meet(seed):
    """Whatever the batches and the order within the delay, no final value leaves its bounds, and both meet at settlement."""
    r = random.Random(seed)
    times = sorted(r.sample([k / 2 for k in range(160)], 60))
    x, y = atom("x"), atom("y")
    f = drawn(r, x, y, 3)
    machine, leaves = live.Machine.of({"f": f})
    value = {id(x): [r.choice([r.randint(-9, 9) + 0.25, r.randint(-9, 9) + 0.75, math.nan]) for _ in times], id(y): [r.randint(-9, 9) + 0.5 for _ in times]}
    rows = [(t, *[value[id(leaf)][k] for leaf in leaves]) for k, t in enumerate(times)]
    whole = Seen(np.array(times), np.array([v[1:] for v in rows]).reshape(60, len(leaves), 1), INF, [-INF] * len(machine.carried), [np.array([c.empty()]) for c in machine.carried])
    final = dict(zip(times, bounds(machine.nodes["f"], whole)[0][:, 0]))
    state, settled, taken = State(), {}, set()
    coming = sorted(rows, key=lambda v: v[0] + r.uniform(0, 7.9))
    while coming:
        n = r.randint(1, 9)
        batch, coming = pd.DataFrame(coming[:n], columns=["t", *[f"m{k}" for k in range(len(leaves))]]), coming[n:]
        for row in itertools.chain.from_iterable(out.itertuples() for out in live._moved(machine, "a", batch, state, 8.0)):
            want = final[row.t]
            assert row.refused is None and row.t not in settled
            assert math.isnan(want) or row.f_low <= want <= row.f_high
            assert math.isnan(row.f_decided) or math.isnan(want) or (row.f_decided >= 0) == (want >= 0)
            taken.add(row.t)
            if row.settled:
                settled[row.t] = row.f_low
                assert row.f_low == row.f_high == want or math.isnan(want)
    # a sample whose bounds say nothing yet has them as well
    assert taken == set(times)


@pytest.mark.parametrize("make", [lambda x, y: x.once(), lambda x, y: x.historically(2), lambda x, y: x.since(y), lambda x, y: x.since(y, 3).once(1).next(), lambda x, y: x.next() | y])
def test_state_stays_small(make):
    """Past operators without an end and next: equal to the whole trace, and no larger state after ten batches than after two."""
    r = random.Random(1)
    x, y = atom("x"), atom("y")
    machine, leaves = live.Machine.of({"f": make(x, y)})
    n = 400
    value = {id(v): [r.uniform(-5, 5) for _ in range(n)] for v in (x, y)}
    rows = pd.DataFrame([(float(k), *[value[id(leaf)][k] for leaf in leaves]) for k in range(n)], columns=["t", *[f"m{k}" for k in range(len(leaves))]])
    whole = Seen(rows["t"].to_numpy(), rows.to_numpy()[:, 1:, None], INF, [-INF] * len(machine.carried), [np.array([c.empty()]) for c in machine.carried])
    final = bounds(machine.nodes["f"], whole)[0][:, 0]
    state, sizes, got = State(), [], {}
    for k in range(0, n, 20):
        for out in live._moved(machine, "a", rows[k : k + 20].sample(frac=1, random_state=k), state, 5.0):
            got |= {v.t: v.f_low for v in out.itertuples() if v.settled}
        sizes.append(len(state.value[0]))
    assert max(sizes) <= max(sizes[:2]) <= 20 and len(got) >= n - 15 and all(final[int(t)] == v for t, v in got.items())


def streamed(spark, tmp_path, rows, schema, per_file):
    path = str(tmp_path / "in")
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_micros((F.col("e") * 1e6).cast("long")))


def run(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_every_row_is_a_verdict_or_refused(spark, tmp_path):
    r = random.Random(2)
    good = [("a" if k % 3 else None, 1_700_000_000.0 + k, r.uniform(-5, 5), k) for k in range(60)]
    bad = [("a", None, 1.0, 100), ("a", 1_700_000_031.0, math.nan, 101), ("a", 1_700_000_032.0, None, 102), ("a", 1_700_000_040.0, INF, 103)]
    again = [("a", 1_700_000_001.0, 0.0, 104), ("a", 1_700_000_058.0, 99.0, 105)]
    rows = good[:40] + bad + good[40:] + again
    stream = streamed(spark, tmp_path, rows, "s string, e double, x double, k long", 22)
    f = {"soon": atom(m.gt("x", 0)).eventually(0, 5), "ever": atom(m.gt("x", 4)).once()}
    out = live.verdicts(stream, f, "s", delay=6.0)
    files.write_verdicts(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    whole = temporal.bank(spark.createDataFrame([v[:3] for v in good], "s string, t double, x double"), {"soon": f["soon"], "ever": f["ever"]}, ["s"])
    want = {(v["s"], v["t"]): (v["soon"], v["ever"]) for v in whole.collect()}
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    refused = sorted((v["refused"], v["t"] or 0) for v in written if v["kind"] == "refused")
    assert refused == [("late", 1_700_000_001.0), ("no time", 0), ("not finite", 1_700_000_031.0), ("not finite", 1_700_000_032.0), ("not finite", 1_700_000_040.0), ("repeated", 1_700_000_058.0)]
    verdicts = [v for v in written if v["kind"] == "verdicts"]
    assert {(v["series"], v["t"]) for v in verdicts} == set(want) and len(refused) + len(want) == len(rows)
    for v in verdicts:
        assert v["soon_low"] <= want[v["series"], v["t"]][0] <= v["soon_high"] and v["ever_low"] <= want[v["series"], v["t"]][1] <= v["ever_high"]
    settled = {(v["series"], v["t"]): (v["soon_low"], v["ever_high"]) for v in verdicts if v["settled"]}
    assert len(settled) == sum(v["settled"] for v in verdicts) >= 40 and all(want[k] == v for k, v in settled.items())
    newest = files.latest_verdicts(spark, str(tmp_path / "out"))
    assert newest.count() == len(want) and newest.filter("settled").count() == len(settled)
    # a batch that is run again is there once: with its commit gone, the last one is
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    files.write_verdicts(out, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, written))


def test_unbounded_past_and_next_by_watermark(spark, tmp_path):
    r = random.Random(3)
    rows = [(s, 1_700_000_000.0 + 2 * k, r.uniform(-5, 5), r.uniform(-5, 5)) for k in range(60) for s in ("a", "b")]
    stream = streamed(spark, tmp_path, rows, "s string, e double, x double, y double", 24)
    x, y = atom(m.gt("x", 0)), atom(m.gt("y", 0))
    f = {"since": x.since(y), "ever": x.once(4) & y.next(), "never": (~y).historically()}
    run(live.monitor_bank(stream, f, "s").writeStream.format("memory").queryName("past"), tmp_path)
    whole = temporal.bank(spark.createDataFrame(rows, "s string, t double, x double, y double"), f, ["s"])
    want = {(v["s"], v["t"]): (v["since"], v["ever"], v["never"]) for v in whole.collect()}
    got = {(v["series"], v["t"]): (v["since"], v["ever"], v["never"]) for v in spark.table("past").collect()}
    assert len(got) >= 100 and all(want[k] == v for k, v in got.items())


def test_live_probability_is_that_of_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(s, 1_700_000_000.0 + k, r.uniform(-3, 3)) for k in range(24) for s in ("a", "b")]
    stream = streamed(spark, tmp_path, rows + [("a", 1_700_000_020.0, 9.0)], "s string, e double, x double", 13)
    f, noise, members = atom(m.gt("x", 0)).eventually(0, 4), {"x": Noise("gaussian", (0.0, 2.0))}, 25
    run(live.live_probability(stream, f, noise, members, "s", 0.6, delay=6.0).writeStream.outputMode("update").format("memory").queryName("odds"), tmp_path)
    rows_of = [v for v in spark.table("odds").collect()]
    assert [v["refused"] for v in rows_of if v["refused"]] == ["repeated"]
    batch = spark.createDataFrame(rows, "s string, t double, x double")
    start = {v["s"]: v["probability"] for v in checks.check(checks.realisations(batch, f, noise, members, ["s"]), ["s"], 0.6).collect()}
    settled = {(v["series"], v["t"]): v for v in rows_of if v["settled"]}
    assert len(settled) >= 2 * 12
    for s in "ab":
        assert settled[s, 1_700_000_000.0]["probability_low"] == settled[s, 1_700_000_000.0]["probability_high"] == start[s]
    for v in rows_of:
        if not v["refused"] and (v["series"], v["t"]) in settled:
            last = settled[v["series"], v["t"]]
            assert v["probability_low"] <= last["probability_low"] <= v["probability_high"] and v["holds"] in (None, last["holds"])
    assert any(v["holds"] is not None and not v["settled"] for v in rows_of if not v["refused"])


def test_live_alignment_equals_hold(spark, tmp_path):
    r = random.Random(5)
    rows = [("a", "one" if k % 2 else "two", 1_700_000_000.0 + k // 2 * 3 + (0 if k % 2 else k % 3), r.uniform(0, 9) if k % 2 else None, None if k % 2 else r.uniform(0, 9)) for k in range(60)]
    coming = sorted(rows, key=lambda v: v[2] + (20 if v[1] == "two" else 0))  # one source is behind
    stale = [("a", "one", 1_700_000_004.0, 77.0, None), ("a", "other", 1_700_000_500.0, 1.0, 1.0)]
    stream = streamed(spark, tmp_path, coming[:40] + stale + coming[40:], "s string, src string, e double, x double, y double", 11)
    run(live.align_live(stream, "s", "src", ["x", "y"], ["one", "two"]).writeStream.format("memory").queryName("aligned"), tmp_path)
    held = live.hold(spark.createDataFrame([(v[0], v[2], v[3], v[4]) for v in rows], "s string, t double, x double, y double"), ["s"], ["x", "y"])
    want = {v["t"]: (v["x"], v["y"]) for v in held.collect()}
    got = [(v["t"], (v["x"], v["y"])) for v in spark.table("aligned").collect()]
    end = min(max(v[2] for v in rows if v[1] == s) for s in ("one", "two"))
    assert len(dict(got)) == len(got) and dict(got) == {t: v for t, v in want.items() if t <= end}


def test_ndjson_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"s": "a", "x": 1.5}\n{"s": "b", "x": "no number"}\nnot json\n')
    out = files.read_ndjson(spark, str(tmp_path / "in"), "s string, x double")
    run(out.writeStream.format("memory").queryName("lines"), tmp_path)
    got = {(v["s"], v["x"], v["malformed"]) for v in spark.table("lines").collect()}
    assert ("a", 1.5, None) in got and {v[2] for v in got} == {None, '{"s": "b", "x": "no number"}', "not json"}
    with pytest.raises(ValueError):
        files.read_ndjson(spark, str(tmp_path / "in"), "malformed string")
    from sparktl.stats.noise import lift

    lifted = lift(spark.createDataFrame([(1, 0.0, 2.0)], "s int, t double, x double"), {"x": Noise("gaussian", (0.0, 1.0))}, 3, ["s"])
    files.write_lifted(lifted, str(tmp_path / "lifted"))
    again = spark.read.parquet(str(tmp_path / "lifted"))
    assert sorted(again.collect()) == sorted(lifted.select(again.columns).collect()) and again.count() == 3
