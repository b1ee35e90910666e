"""Ordered operators against small simulators, on the plain and on the split path."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perfloom.operators import events as EV
from perfloom.operators import timeline as TL
from perfloom.operators.sequence import KeyedSequence, percentiles

SPLITS = [0, 7]


def lifo(rows):
    """rows (key, seq, ts, ph) -> sorted results of a plain stack."""
    stacks, out = {}, []
    for key, seq, ts, ph in sorted(rows, key=lambda r: r[1]):
        if ph == "B":
            stacks.setdefault(key, []).append((seq, ts))
        elif stacks.get(key):
            _, b = stacks[key].pop()
            out.append((key, seq, b, ts - b, "X"))
        else:
            out.append((key, seq, ts, 0, "E"))
    left = [(k, s, t, 0, "X") for k, v in stacks.items() for s, t in v]
    return sorted(out), sorted(out + left)


@pytest.mark.parametrize("split", SPLITS)
def test_begin_end_matches_stack(spark, split):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", i, i * 10 + rng.randrange(10), rng.choice("BE")) for i in range(600)]
    df = spark.createDataFrame([("t", k, 1, 1, s, t, 0, p, "c") for k, s, t, p in rows],
                               "trace_id string, name string, pid long, tid long, seq long, ts long, dur long, ph string, cat string")
    plain, flushed = lifo(rows)
    got = EV.pair_begin_end(df, split_rows=split)
    assert sorted((r.name, r.seq, r.ts, r.dur, r.ph) for r in got.collect()) == plain
    got = EV.pair_begin_end(df, flush=True, split_rows=split)
    assert sorted((r.name, r.seq, r.ts, r.dur, r.ph) for r in got.collect()) == flushed


@pytest.mark.parametrize("split", SPLITS)
def test_pairing_matches_simulation(spark, split):
    rng = random.Random(9)
    rows = [("t", rng.choice(["a", "a", "b"]), i * 3, i, rng.random() < 0.5) for i in range(500)]
    open_, want = {}, []
    for _, k, ts, seq, start in rows:
        if start:
            open_[k] = ts
        elif k in open_:
            want.append((k, open_.pop(k), ts))
    df = spark.createDataFrame(rows, "trace_id string, k string, ts long, seq long, is_start boolean")
    got = TL.pair_last_start(df, ["trace_id", "k"], split_rows=split)
    assert sorted((r.k, r.start_ts, r.end_ts) for r in got.collect()) == sorted(want)


def greedy(ts, width):
    out, start = [], None
    for t in ts:
        if start is None:
            start = t
        out.append(start)
        if t - start >= width:
            start = None
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(steps=st.lists(st.integers(0, 40), min_size=30, max_size=160), width=st.sampled_from([5, 37, 200]))
def test_anchored_windows_match_greedy(spark, steps, width):
    ts, t = [], 1000
    for s in steps:
        t += s
        ts.append(t)
    want = dict(enumerate(greedy(ts, width)))
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(ts)], "trace_id string, seq long, ts long")
    for split in (0, 11):
        got = {r.seq: r.window_start for r in TL.anchored_windows(df, window_us=width, split_rows=split).collect()}
        assert got == want


@pytest.mark.parametrize("split", SPLITS)
@pytest.mark.parametrize("how", ["sum", "min", "max", "last"])
def test_running_matches_python(spark, split, how):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "cold", i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = KeyedSequence(df, ["k"], ["i"], split).running("r", how, "v").result()
    have = {r.i: r.r for r in got.collect()}
    state = {}
    for k, i, v in rows:
        p = state.get(k)
        if v is not None:
            p = v if p is None or how == "last" else {"sum": p + v, "min": min(p, v), "max": max(p, v)}[how]
        state[k] = p
        assert have[i] == p, (i, how)


@pytest.mark.parametrize("split", SPLITS)
def test_scan_folds_together_as_one_by_one(spark, split):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else "cold", i, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([-1, 1])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long, s long")
    got = KeyedSequence(df, ["k"], ["i"], split).scan(
        {"total": ("sum", "v"), "least": ("min", "v"), "seen": ("last", "v"), "coming": ("next", "v"), "at": ("sum", "s"), "low": ("low", "s")},
        {"n": ("count", F.lit(1)), "top": ("max", "v")}).result()
    have = {r.i: r for r in got.collect()}
    for key in ("hot", "cold"):
        own = [r for r in rows if r[0] == key]
        at = low = 0
        for x, (_, i, v, s) in enumerate(own):
            before = [r[2] for r in own[: x + 1] if r[2] is not None]
            after = [r[2] for r in own[x:] if r[2] is not None]
            at += s
            low = at if not x else min(low, at)
            want = (sum(before) if before else None, min(before, default=None), before[-1] if before else None, after[0] if after else None, at, low,
                    len(own), max(r[2] for r in own if r[2] is not None))
            r = have[i]
            assert (r.total, r.least, r.seen, r.coming, r.at, r.low, r.n, r.top) == want, i


def test_operators_of_several_steps_rewrite_rows_once(spark, monkeypatch):
    """Chunks are written once, then once for all folds; pairs need one more for the shift inside their levels."""
    from perfloom.operators import lookup, sequence

    writes, real = [], sequence.written
    monkeypatch.setattr(sequence, "written", lambda df: writes.append(1) or real(df))

    def count(make):
        writes.clear()
        make()
        return len(writes)

    df = spark.range(400).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("w"))
    assert count(lambda: TL.pareto(df, ["k"], "v", ties=["i"], split_rows=50)) == 2
    assert count(lambda: TL.ffill(df, ["k"], ["i"], ["v", "w"], split_rows=50)) == 2
    assert count(lambda: lookup.nearest(df, df.where("i < 40"), ["k"], "v", "i", "w", "i", split_rows=50)) == 2
    ev = df.select(F.lit("t").alias("trace_id"), F.lit("n").alias("name"), F.lit(1).alias("pid"), F.lit(1).alias("tid"), F.col("i").alias("seq"),
                   F.col("i").alias("ts"), F.lit(0).cast("long").alias("dur"), F.when(F.col("v") < 3, "B").otherwise("E").alias("ph"), F.lit("c").alias("cat"))
    assert count(lambda: EV.pair_begin_end(ev, split_rows=50)) == 3


def test_split_balances_a_hot_key(spark):
    """One key with most rows and one repeated time stamp is cut into chunks near the target."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") < 9_000, F.lit(5)).otherwise(F.col("id")).alias("ts"), F.col("id").alias("seq"))
    seq = KeyedSequence(df, ["k"], ["ts", "seq"], 1000)
    sizes = [r["count"] for r in seq.df.groupBy("k", "_chunk").count().collect()]
    assert max(sizes) < 2500 and len(sizes) > 15
    back = seq.shift({"p": "seq"}).result()
    bad = back.where("k = 'hot'").where("p is null").count()
    assert bad == 1


@pytest.mark.parametrize("split", SPLITS)
def test_percentiles(spark, split):
    rng = random.Random(1)
    vals = [rng.randrange(1000) for _ in range(1500)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7)], "k string, v long")
    s = sorted(vals)
    lin = {r.k: r for r in percentiles(df, ["k"], "v", {"p99": 0.99}, split_rows=split).collect()}
    pos = 0.99 * (len(s) - 1)
    lo = int(pos)
    assert lin["a"].p99 == pytest.approx(s[lo] + (s[lo + 1] - s[lo]) * (pos - lo))
    assert lin["b"].p99 == 7
    near = {r.k: r for r in percentiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99, "p999": 0.999}, "nearest", split).collect()}
    assert (near["a"].p50, near["a"].p99, near["a"].p999) == (s[750], s[int(1500 * 0.99)], s[int(1500 * 0.999)])
    assert (near["b"].p50, near["b"].p99) == (7, 7)


def test_cut_depends_on_counted_rows_only(spark):
    """An exploded key, of which the optimizer knows nothing, is cut; keys within the bound are not."""
    big = spark.range(1).select(F.lit("hot").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(300_000))).alias("i"))
    seq = KeyedSequence(big, ["k"], ["i"], 50_000)
    assert seq.split and seq.df.select("_chunk").distinct().count() >= 5
    got = seq.running("s", "sum", F.lit(1).cast("long")).shift({"p": "i"}).result()
    assert got.where("s <> i OR coalesce(p, 0) <> i - 1").count() == 0
    assert not KeyedSequence(big, ["k"], ["i"], 400_000).split


def test_downsample_spans_the_range(spark):
    df = spark.range(999).select(F.lit("a").alias("k"), F.col("id").alias("i"))
    got = sorted(r.i for r in TL.downsample(df, ["k"], ["i"], keep=500).collect())
    assert got == list(range(0, 999, 2))


@pytest.mark.parametrize("split", [0, 20_000])
def test_next_value_is_not_folded_anew_for_each_row(spark, split, capsys):
    n = 60_000
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 25_000 == 24_999, F.col("id")).alias("v"))
    got = KeyedSequence(df, ["k"], ["i"], split).running("r", "next", "v").result()
    got.explain()
    assert "currentrow$(), unboundedfollowing$()" not in capsys.readouterr().out
    assert {(r.r, r["n"]) for r in got.groupBy("r").agg(F.count("i").alias("n")).collect()} == {(24_999, 25_000), (49_999, 25_000), (None, 10_000)}
