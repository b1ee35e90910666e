import random

from pyspark.sql import functions as F

from perfloom import streaming as SM
from perfloom.operators import events as EV
from perfloom.operators import timeline as TL

DDL = ("trace_id string, seq long, ts long, dur long, cpu long, device_id long, stream_id long, name string, cat string, "
       "prev_state string, next_pid long, wake_pid long, latency_ms double")


def _files(spark, root, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{root}/b{i}")
    return f"{root}/b*"


def _rows():
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(300):
        t += rng.randrange(1, 40) * 1_000_000
        if i % 3:
            rows.append(("t", i, t, rng.randrange(5) * 1_000_000, -1, 0, i % 2, f"k{i}", "npu_kernel", None, None, None, None))
        else:
            wake = rng.random() < 0.5
            pid = rng.randrange(3)
            rows.append(("t", i, t, 0, 0, -1, -1, "sched_wakeup" if wake else "sched_switch", "cpu_sched", "D", None if wake else pid,
                         pid if wake else None, 20.0 if i % 9 == 0 else 1.0))
    return rows


def _run(spark, tmp_path, build, rows):
    """Out of order inside the delay, three rows per file batch, and a far row to move the watermark."""
    rng = random.Random(8)
    shuffled = [r for i in range(0, len(rows), 10) for r in rng.sample(rows[i:i + 10], len(rows[i:i + 10]))]
    parts = [shuffled[i:i + 75] for i in range(0, len(shuffled), 75)]
    end = rows[-1][2] + 10**12
    far = [("z", 10**6, end, 0, -1, 0, 0, "x", "npu_kernel", None, None, None, None),
           ("z", 10**6 + 1, end, 0, 0, -1, -1, "sched_switch", "cpu_sched", "S", 9, None, None)]
    path = _files(spark, tmp_path / "in", parts + [far])
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)
    out = SM.drain(build(SM.with_event_time(s, "600 seconds")), "t", str(tmp_path / "out"))
    return out.where("trace_id = 't'")


def test_gap_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    got = _run(spark, tmp_path, lambda s: SM.gap_scan(s, min_gap_us=1), rows)
    want = TL.gap_scan(spark.createDataFrame(rows, DDL), min_gap_us=1)
    key = lambda df: sorted((r.stream_id, r.gap_start, r.gap_end, r.prev_kernel, r.next_kernel) for r in df.collect())
    assert key(got) == key(want) and got.count() > 50


def test_latency_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    got = _run(spark, tmp_path, SM.sched_latency, rows)
    want = TL.sched_latency(spark.createDataFrame(rows, DDL))
    key = lambda df: sorted((r.pid, r.wake_ts, r.switch_ts) for r in df.collect())
    assert key(got) == key(want) and got.count() > 10


def test_tumbling_stream_equals_batch(spark, tmp_path):
    rows = _rows()
    w = 60_000_000
    got = _run(spark, tmp_path, lambda s: SM.tumbling_summary(s, window_us=w), rows)
    want = TL.window_summary(spark.createDataFrame(rows, DDL), window_us=w)
    key = lambda df: sorted((r.window_start, r.sched_switch_count, r.runnable_count, r.wakeup_count) for r in df.collect())
    assert key(got) == key(want)


def test_late_rows_are_dropped(spark, tmp_path):
    first = ("t", 1, 10**12, 0, 0, -1, -1, "sched_switch", "cpu_sched", "R", 1, None, None)
    late = ("t", 2, 5, 0, 0, -1, -1, "sched_switch", "cpu_sched", "R", 1, None, None)
    far = ("z", 3, 10**13, 0, 0, -1, -1, "x", "unknown", None, None, None, None)
    path = _files(spark, tmp_path / "in", [[first], [far], [late], [far]])
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)
    out = SM.drain(SM.tumbling_summary(SM.with_event_time(s, "1 second"), window_us=10**6), "late", str(tmp_path / "out"))
    assert {r.window_start for r in out.where("trace_id = 't'").collect()} == {10**12}


def test_late_rows_land_in_a_table_of_their_own(spark, tmp_path):
    """Batches one after the other: what is later than the delay goes aside, and both tables together are the input."""
    times = [[100, 200, 300], [290, 251, 249, 10], [900, None], [849, 850, 901, 5]]  # a delay of 50
    rows = [[("t", 10 * b + k, t, 0, 0, -1, -1, "x", "c", None, None, None, None) for k, t in enumerate(part)] for b, part in enumerate(times)]
    args = [str(tmp_path / n) for n in ("on_time", "late", "marks", "ck")]
    for i, part in enumerate(rows):  # a run for each, so the last mark comes from the folder
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        s = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in/b*")
        SM.split_late(s, 50, *args, available_now=True).awaitTermination()
    late = {(r.batch, r.ts) for r in spark.read.parquet(args[1]).collect()}
    assert late == {(1, 249), (1, 10), (3, 849), (3, 5)}
    both = [r.seq for path in args[:2] for r in spark.read.parquet(path).collect()]
    assert sorted(both) == sorted(r[1] for part in rows for r in part)


def test_key_events_go_to_their_own_table(spark, tmp_path):
    rows = _rows()
    path = _files(spark, tmp_path / "in", [rows[:150], rows[150:]])
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(path)
    q = SM.split_key_events(s, EV.window_key_event(), str(tmp_path / "all"), str(tmp_path / "key"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 300
    want = spark.createDataFrame(rows, DDL).where(F.coalesce(EV.window_key_event(), F.lit(False))).count()
    assert spark.read.parquet(str(tmp_path / "key")).count() == want > 0


def _kernels(times, stream=0, trace="t", first=0):
    return [(trace, first + i, t * 1_000_000, 1_000_000, -1, 0, stream, f"k{i}", "npu_kernel", None, None, None, None) for i, t in enumerate(times)]


def _state_rows(spark, checkpoint):
    """Entries of every state variable in the last batch of a checkpoint."""
    out = {}
    for name in ("waiting", "carry", "seen"):
        out[name] = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()
    return out


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """The second run finds the rows that wait and the last kernels of the first in the checkpoint."""
    rows = _kernels(range(5, 405, 5))
    out, ck, path = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "in")
    far = _kernels([10_000], trace="z")

    def go():
        s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")
        SM.write_table(SM.gap_scan(SM.with_event_time(s, "20 seconds"), min_gap_us=1), out, ck, available_now=True).awaitTermination()
        return spark.read.parquet(out).where("trace_id = 't'").count()

    for i, part in enumerate((rows[:30], rows[30:50])):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{path}/b{i}")
    assert 0 < go() < 49 and _state_rows(spark, ck)["waiting"] > 0
    for i, part in ((2, rows[50:]), (3, far), (4, far)):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{path}/b{i}")
    assert go() == len(rows) - 1
    got = sorted(r.gap_start for r in spark.read.parquet(out).where("trace_id = 't'").collect())
    assert got == sorted(r.gap_start for r in TL.gap_scan(spark.createDataFrame(rows, DDL), min_gap_us=1).collect())


def test_idle_keys_leave_the_state(spark, tmp_path):
    path, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    parts = [_kernels([10, 15], s) for s in range(6)], [_kernels([100, 105], 7)], [_kernels([2000, 2005], 7, first=10)], [_kernels([2300, 2305], 7, first=20)], [
        _kernels([2400], 7, first=30)]
    for i, groups in enumerate(parts):
        spark.createDataFrame([r for g in groups for r in g], DDL).coalesce(1).write.parquet(f"{path}/b{i}")
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")
    q = SM.gap_scan(SM.with_event_time(s, "1 second"), min_gap_us=1, idle_us=600_000_000)
    SM.write_table(q, str(tmp_path / "out"), ck, available_now=True).awaitTermination()
    left = _state_rows(spark, ck)
    assert left["carry"] == left["seen"] == 1  # only stream 7, which came back
    gaps = {(r.stream_id, r.gap_start // 1_000_000) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # stream 7 was away for longer than a key is kept, so no gap is measured across that time
    assert gaps == {(s, 11) for s in range(6)} | {(7, 101), (7, 2001), (7, 2006), (7, 2301)}


def test_state_is_kept_for_buckets_of_keys(spark, tmp_path):
    """More keys than buckets, over two batches with rows that wait in between: each key has its own answer, few groups hold all."""
    n, path, ck = 1500, str(tmp_path / "in"), str(tmp_path / "ck")
    rows = [[r for s in range(n) for r in _kernels([t + s % 7, t + 9 + s % 3], s, None if s % 5 == 0 else "t", first=t)] for t in (5, 200)]
    for i, part in enumerate([*rows, _kernels([10_000], trace="z"), _kernels([20_000], trace="z")]):
        spark.createDataFrame(part, DDL).coalesce(1).write.parquet(f"{path}/b{i}")
    s = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")
    SM.write_table(SM.gap_scan(SM.with_event_time(s, "100 seconds"), min_gap_us=1), str(tmp_path / "out"), ck, available_now=True).awaitTermination()
    key = lambda df: sorted(str((r.trace_id, r.stream_id, r.gap_start, r.gap_end, r.prev_kernel, r.next_kernel)) for r in df.collect())
    got = key(spark.read.parquet(str(tmp_path / "out")).where("trace_id is null or trace_id <> 'z'"))
    assert got == key(TL.gap_scan(spark.createDataFrame(rows[0] + rows[1], DDL), min_gap_us=1)) and len(got) == 3 * n
    state = spark.read.format("statestore").option("stateVarName", "carry").load(ck)
    assert state.count() == n + 1 and state.select("key").distinct().count() < 1100
