import random

import pytest
from pyspark.sql import functions as F

from perfloom.operators import correlate as CO
from perfloom.operators import ranges as RG
from perfloom.operators import timeline as TL
from perfloom.plans.trace_queries import OFFSET, sig_gaps, tv

SF = "/root/testdata/sf0.001"
EVENT = "trace_id string, seq long, ts long, dur long, device_id long, stream_id long, name string, cat string"


def _data(spark):
    rng = random.Random(4)
    gaps, t = [], 0
    for i in range(60):
        t += rng.randrange(1, 400)
        e = t + rng.choice([5, 50, 3000])
        gaps.append(("t", 0, 0, t, e, e - t))
        t = e
    hosts = [("t", i, rng.randrange(0, t), rng.choice([0, 3, 90, 5000]), -1, -1, f"h{i}", "io") for i in range(400)]
    g = spark.createDataFrame(gaps, "trace_id string, device_id long, stream_id long, gap_start long, gap_end long, gap_dur long")
    return gaps, hosts, g, spark.createDataFrame(hosts, EVENT)


@pytest.mark.parametrize("offset", [40, None])
@pytest.mark.parametrize("bucket", [16, 1000])
def test_join_matches_nested_loops(spark, offset, bucket):
    gaps, hosts, g, h = _data(spark)
    want = set()
    for _, _, _, gs, ge, _ in gaps:
        near = [x for x in hosts if x[2] <= ge and x[2] + x[3] >= gs and (offset is None or x[2] >= max(0, gs - offset))]
        near.sort(key=lambda x: (-x[3], x[2], x[1]))
        want |= {(gs, x[1], i + 1) for i, x in enumerate(near[:5])} or {(gs, None, None)}
    got = CO.gap_host_join(g, h, max_offset_us=offset, bucket_us=bucket)
    assert {(r.gap_start, r.host_seq, r.rank) for r in got.collect()} == want


def _nested(want_gaps, want_hosts, top=5):
    out = set()
    for gs, ge in want_gaps:
        near = sorted((x for x in want_hosts if x[1] <= ge and x[1] + x[2] >= gs), key=lambda x: (-x[2], x[1], x[0]))[:top]
        out |= {(gs, x[0], i + 1) for i, x in enumerate(near)} or {(gs, None, None)}
    return out


def test_long_spans_and_long_gaps_match_nested_loops(spark):
    """Spans nested over the whole trace, spans of every length, gaps from microseconds to an hour."""
    rng = random.Random(11)
    hour = 3_600_000_000
    gaps = []
    t = 1000
    for _ in range(120):
        t += rng.randrange(1, 1 << rng.randrange(2, 26))
        e = t + rng.randrange(1, 1 << rng.choice([3, 12, 18, 24, 31]))
        gaps.append((t, e))
        t = e
    hosts = [(i, i * 7, t - 14 * i + 1) for i in range(20)]  # each inside the one before
    hosts += [(100 + i, rng.randrange(t), rng.randrange(1 << rng.randrange(1, 37))) for i in range(1500)]
    hosts += [(3000, -5_000_000, 6_000_000), (3001, 0, 1 << 44), (3002, gaps[3][0], 0), (3003, gaps[4][1], 0), (3004, gaps[5][0] - 1, 1)]
    assert t > hour
    g = spark.createDataFrame([("t", 0, 0, a, b, b - a) for a, b in gaps], "trace_id string, device_id long, stream_id long, gap_start long, gap_end long, gap_dur long")
    h = spark.createDataFrame([("t", i, a, d, -1, -1, f"h{i}", "io") for i, a, d in hosts], EVENT)
    got = CO.gap_host_join(g, h, max_offset_us=None)
    assert {(r.gap_start, r.host_seq, r.rank) for r in got.collect()} == _nested(gaps, hosts)


def test_spans_are_listed_once_and_covers_are_small(spark):
    hour = 3_600_000_000
    spans = spark.range(20).select((F.col("id") * 1000).alias("lo"), (F.col("id") * 1000 + hour).alias("hi"))
    assert RG.listed_spans(spans, "lo", "hi").count() == 20
    cells = RG.covering_cells(spark.range(1).select(F.lit(77).cast("long").alias("a"), F.lit(720_000 + 77).cast("long").alias("b")), "a", "b").collect()
    covered = sorted(x for r in cells for x in range(r._node << 6 * r._floor, (r._node + 1) << 6 * r._floor))
    assert covered == list(range(77, 720_078)) and len(cells) < 400
    points = spark.createDataFrame([(k, x) for k, x in enumerate([0, -1, -5000, 1 << 20, hour, hour + 19_000, hour + 19_001, 1 << 50])], "p long, at long")
    got = RG.spans_around(points.withColumn("k", F.lit(1)), spans.withColumn("k", F.lit(1)), ["k"], "at", "lo", "hi")
    want = {(p.p, i) for p in points.collect() for i in range(20) if i * 1000 <= p.at <= i * 1000 + hour}
    assert {(r.p, r.lo // 1000) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("split", [0, 50])
def test_lookback_matches_all_pairs(spark, split):
    rng = random.Random(split)
    gaps = [("t", d, 0, s, s + 10, 10) for d in range(2) for s in range(100, 4000, 37)]
    signals = [("t", rng.randrange(4000), *(rng.random() < 0.03 for _ in range(5))) for _ in range(900)] + [("t", 137, True, True, False, False, False)]
    g = spark.createDataFrame(gaps, "trace_id string, device_id long, stream_id long, gap_start long, gap_end long, gap_dur long")
    flags = ["queue_high", "sched_delay", "io_pending", "d_state", "major_fault"]
    sig = spark.createDataFrame(signals, "trace_id string, ts long, " + ", ".join(f"{f} boolean" for f in flags))
    look = {"CPU_SCHED_CONTENTION": 50, "IO_BLOCK": 100, "MEMORY_PRESSURE": 200}
    want = set()
    for _, d, _, s, _, dur in gaps:
        def seen(k, back):
            return any(x[2 + k] and s - back <= x[1] < s for x in signals)
        pattern = ("CPU_SCHED_CONTENTION" if seen(0, 50) and seen(1, 50) else "IO_BLOCK" if seen(2, 100) and seen(3, 100)
                   else "MEMORY_PRESSURE" if seen(4, 200) else None)
        want.add((d, s, pattern, max((x[1] for x in signals if any(x[2:]) and s - 200 <= x[1] < s), default=None)))
    got = CO.gap_lookback(g, sig, lookback_us=look, split_rows=split).collect()
    assert {(r.device_id, r.gap_start, r.pattern, r.closest_ts) for r in got} == want and len(got) == len(gaps)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("offset", [OFFSET, None])
def test_no_nested_loop_or_product(spark, offset):
    ev = tv(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = _plan(CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=offset, bucket_us=OFFSET))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan


def test_windows_are_partitioned(spark):
    ev = tv(spark, SF)
    for df in (TL.gap_scan(ev), TL.cpu_slices(ev), TL.pareto(TL.gap_scan(ev), ["trace_id"], "gap_dur"), TL.sched_latency(ev)):
        assert "SinglePartition" not in _plan(df)


def test_gap_scan_reads_only_needed_columns(spark):
    plan = _plan(TL.gap_scan(tv(spark, SF)))
    schema = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "event_id" in schema and plan.count("Exchange hashpartitioning") == 1
    assert "PushedFilters" in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    ev = tv(spark, SF)
    assert "WindowGroupLimit" in _plan(CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=OFFSET))


def test_exact_gaps_ignore_covered_kernels(spark):
    rows = [("t", i, ts, d, 0, 0, f"k{i}", "npu_kernel") for i, (ts, d) in enumerate([(0, 100), (10, 5), (50, 5), (200, 10)])]
    ev = spark.createDataFrame(rows, EVENT)
    assert sorted(r.gap_dur for r in TL.gap_scan(ev, min_gap_us=1).collect()) == [35, 145]
    assert [r.gap_dur for r in TL.gap_scan(ev, min_gap_us=1, exact=True).collect()] == [100]
    assert TL.gap_scan(ev, min_gap_us=1, exact=True).where(F.col("gap_start") == 100).count() == 1
