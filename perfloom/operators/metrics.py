"""Host metrics of traces: wide one-row-per-trace records and the parts they are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators import timeline as TL
from perfloom.operators.events import K
from perfloom.operators.sequence import KeyedSequence, percentiles


def _copy_sums() -> list[Column]:
    """Bytes and time per direction; copy rows only count through their category."""
    copy = F.col("cat") == "npu_memcpy"
    d = F.when(copy, X.memcpy_direction("direction", "op"))
    sums = [F.coalesce(F.sum(F.when(d == s, F.col(c))), F.lit(0)).alias(f"_{s}_{c}") for s in ("H2D", "D2H") for c in ("bytes", "dur")]
    return sums + [F.coalesce(F.sum(F.when(copy, F.col("dur"))), F.lit(0)).alias("memcpy_total_us")]


def _bandwidths() -> list[Column]:
    return [X.safe_div(f"_{s}_bytes", f"_{s}_dur").alias(f"{s.lower()}_bandwidth_mbs") for s in ("H2D", "D2H")]


def copy_bandwidth(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Bytes per microsecond (= MB/s) per direction, and copy time over all directions."""
    return ev.where("cat = 'npu_memcpy'").groupBy(*K).agg(*_copy_sums()).select(*K, *_bandwidths(), "memcpy_total_us")


def launch_stats(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Launch count and mean distance.  The mean needs no order: (last - first) / (n - 1)."""
    n = F.count(F.lit(1))
    mean = F.when(n < 2, F.lit(0.0)).otherwise(F.try_divide((F.max("ts") - F.min("ts")).cast("double"), n - 1))
    return ev.where("cat = 'cuda_npu_api'").groupBy(*K).agg(n.alias("launch_count"), mean.alias("launch_avg_gap_us"))


def balance_score(values: DataFrame, K: Sequence[str], value: str) -> DataFrame:
    """1 - stdev/mean clamped to [0, 1]; 1 for fewer than two values or a mean of 0 or less.  Also the plain CV."""
    s = values.groupBy(*K).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    cv = F.try_divide(F.col("_sd"), F.col("_m"))
    flat = (F.col("_n") < 2) | (F.col("_m") <= 0)
    return s.select(
        *K,
        F.when(flat, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))).alias("balance_score"),
        F.when(flat, 0.0).otherwise(cv).alias("cv"))


def latency_stats(lat: DataFrame, K: Sequence[str], value: str = "latency_us", method: str = "linear") -> DataFrame:
    """Mean, p50/p99/p99.9 and maximum."""
    return percentiles(lat, K, value, {"p50": 0.5, "p99": 0.99, "p99_9": 0.999}, method, stats=True)


def nearest_rank(lat: DataFrame, K: Sequence[str], value: str) -> DataFrame:
    return percentiles(lat, K, value, {"p50": 0.5, "p99": 0.99, "p99_9": 0.999}, "nearest")


def ctx_switch_rate(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    span = F.max(F.greatest(F.col("ts"), F.col("ts") + F.col("dur"))) - F.min("ts")
    sw = (F.col("cat") == "cpu_sched") & F.lower("name").contains("switch")
    return ev.groupBy(*K).agg(F.count_if(sw).alias("switches"), span.alias("duration_us")).withColumn(
        "ctx_switch_rate", X.safe_div(F.col("switches") * 1e6, "duration_us"))


def host_scalars(ev: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000, percent: bool = False) -> DataFrame:
    """Wide metric record per trace.  ``percent`` turns the utilisation fractions into percent for the rule set."""
    K = list(K)
    scale = 100.0 if percent else 1.0
    launch = F.col("cat") == "cuda_npu_api"
    switch = (F.col("cat") == "cpu_sched") & F.lower("name").contains("switch")
    launch_ts = F.when(launch, F.col("ts"))
    n = F.count(launch_ts)
    base = ev.groupBy(*K).agg(      # everything that needs no order, in one pass
        (F.max(F.greatest(F.col("ts"), F.col("ts") + F.col("dur"))) - F.min("ts")).alias("duration_us"),
        (F.max("cpu") + 1).alias("cpu_cores"), F.count_if(switch).alias("_sw"), n.alias("launch_count"),
        F.when(n < 2, 0.0).otherwise(F.try_divide((F.max(launch_ts) - F.min(launch_ts)).cast("double"), n - 1)).alias("launch_avg_gap_us"),
        *_copy_sums())
    base = base.select(*K, "duration_us", "cpu_cores", X.safe_div(F.col("_sw") * 1e6, "duration_us").alias("ctx_switch_rate"),
                       "launch_count", "launch_avg_gap_us", *_bandwidths(), "memcpy_total_us")
    cpu = TL.cpu_util(ev, K).groupBy(*K).agg(
        F.count("util").alias("_n"), F.avg("util").alias("_m"), F.max("util").alias("_x"), F.stddev_samp("util").alias("_sd"))
    cpu = cpu.select(
        *K, (F.col("_m") * scale).alias("cpu_util_avg"), (F.col("_x") * scale).alias("cpu_util_max"),
        F.greatest((1 - F.col("_m")) * scale, F.lit(0.0)).alias("cpu_idle_avg"),
        F.when((F.col("_n") < 2) | (F.col("_m") <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), 1 - F.try_divide(F.col("_sd"), F.col("_m"))))).alias("cpu_balance_score"))
    rq = TL.timeline(ev, "runqueue", K, window_us).groupBy(*K).agg(
        F.avg("value").alias("runqueue_avg"), F.max("value").alias("runqueue_max"))
    lat = percentiles(TL.sched_latency(ev, K), K, "latency_us", {"sched_latency_p99_us": 0.99}, stats=True).select(
        *K, F.col("mean").alias("sched_latency_avg_us"), "sched_latency_p99_us",
        F.col("max").cast("double").alias("sched_latency_max_us"))
    out = base
    for part in (cpu, rq, lat):
        out = out.join(part, K, "left")
    # a trace without cpu slices has no spread: balance 1, idle all; other absent metrics are 0
    return out.fillna({"cpu_balance_score": 1.0, "cpu_idle_avg": scale}).fillna(0.0).fillna(0)


def series_spikes(ev: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000, cpus: int = 1) -> DataFrame:
    """(metric, spike) for the series the temporal rule patterns look at."""
    parts = {"runqueue": TL.timeline(ev, "runqueue", K, window_us), "ctx_switch": TL.timeline(ev, "ctx_rate", K, window_us),
             "cpu_util": TL.timeline(ev, "cpu_util", K, window_us, cpus),
             "sched_latency": TL.sched_latency(ev, K).select(*K, F.col("switch_ts").alias("ts"), F.col("latency_us").cast("double").alias("value"))}
    out = None
    for name, df in parts.items():
        df = df.select(*K, "ts", "value", F.lit(name).alias("metric"))
        out = df if out is None else out.unionByName(df)
    return TL.spikes(out, [*K, "metric"]).select(*K, "metric", "spike")


def to_long(wide: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """(metric, value) rows of a wide numeric record."""
    cols = [c for c in wide.columns if c not in K]
    return wide.select(*K, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(K), cols, "metric", "value").where("value is not null")


# ---------------------------------------------------------------- line-trace records

def window_rollup(windows: DataFrame, K: Sequence[str] = K, window_us: int = 100_000, cpu_count: int = 1) -> DataFrame:
    rate = F.avg(F.col("sched_switch_count") / F.lit(window_us / 1e6))
    return windows.groupBy(*K).agg(
        rate.alias("context_switch_rate"),
        F.least(rate / F.lit(cpu_count * 1000.0) * 100, F.lit(100.0)).alias("cpu_util_avg"),
        F.avg("runnable_count").alias("runqueue_avg"), F.max("runnable_count").alias("runqueue_max"),
        (F.avg("runnable_count") / F.lit(float(max(cpu_count, 1)))).alias("runqueue_pressure"))


def core_share(dist: DataFrame, K: Sequence[str] = K, cpu_count: int = 1) -> DataFrame:
    """Mean over windows of each cpu's share of switches, in percent of all cores."""
    total = F.sum("switches").over(Window.partitionBy(*K, "window_start"))   # at most one row per cpu and window
    return dist.withColumn("_s", F.col("switches") / total).groupBy(*K, "cpu").agg(
        (F.avg("_s") * 100 * cpu_count).alias("core_util"))


def numa_ratio(ev: DataFrame, K: Sequence[str] = K, local: str = "numa_local", remote: str = "numa_remote") -> DataFrame:
    out = ev.groupBy(*K).agg(F.count_if(F.col("name") == local).alias("local_count"),
                             F.count_if(F.col("name") == remote).alias("remote_count"))
    total = F.col("local_count") + F.col("remote_count")
    return out.withColumns({
        "remote_ratio": F.try_divide(F.col("remote_count") * 100.0, total),
        "hit_ratio": F.try_divide(F.col("local_count") * 100.0, total)})


def io_pending(ev: DataFrame, K: Sequence[str] = K, issue: str = "block_rq_issue", complete: str = "block_rq_complete") -> DataFrame:
    span = (F.max("ts") - F.min("ts")) / F.lit(1e6)
    out = ev.groupBy(*K).agg(F.count_if(F.col("name") == issue).alias("io_issue_count"),
                             F.count_if(F.col("name") == complete).alias("io_complete_count"), span.alias("_s"))
    i, c = F.col("io_issue_count"), F.col("io_complete_count")
    return out.select(
        *K, "io_issue_count", "io_complete_count",
        F.when(i > 0, F.least((i - c) / i * 100, F.lit(100.0))).alias("io_wait_pct"),
        F.when(i > 0, i / F.greatest("_s", F.lit(1.0))).alias("io_issue_rate"))


def disk_bandwidth(io: DataFrame, K: Sequence[str] = K, complete: str = "block_rq_complete") -> DataFrame:
    """MB/s read and written; columns ``name, ts, sectors, rwbs``."""
    done = F.col("name") == complete
    write = F.col("rwbs").startswith("W")
    out = io.groupBy(*K).agg(
        F.coalesce(F.sum(F.when(done & ~write, F.col("sectors") * 512)), F.lit(0)).alias("read_bytes"),
        F.coalesce(F.sum(F.when(done & write, F.col("sectors") * 512)), F.lit(0)).alias("write_bytes"),
        ((F.max("ts") - F.min("ts")) / F.lit(1e6)).alias("_s"))
    return out.select(
        *K, "read_bytes", "write_bytes",
        (X.safe_div("read_bytes", "_s") / (1024 * 1024)).alias("read_bw_mbs"),
        (X.safe_div("write_bytes", "_s") / (1024 * 1024)).alias("write_bw_mbs"))


def io_latency(io: DataFrame, K: Sequence[str] = K, issue: str = "block_rq_issue", complete: str = "block_rq_complete",
               split_rows: int | None = None) -> DataFrame:
    """Issue to complete per (dev, sector)."""
    marks = io.where(F.col("name").isin(issue, complete)).select(
        *K, "dev", "sector", "ts", "seq", (F.col("name") == issue).alias("is_start"))
    return TL.pair_last_start(marks, [*K, "dev", "sector"], split_rows=split_rows).select(
        *K, "dev", "sector", F.col("start_ts").alias("issue_ts"),
        (F.col("end_ts") - F.col("start_ts")).alias("latency_us"))


def fault_counts(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Page faults by kind and switches that left in uninterruptible sleep."""
    fault = F.col("name") == "mm_page_fault"
    out = ev.groupBy(*K).agg(
        F.count_if(fault & (F.col("fault_type") == "major")).alias("major_page_faults"),
        F.count_if(fault & (F.col("fault_type") == "minor")).alias("minor_page_faults"),
        F.count_if((F.col("name") == "sched_switch") & F.col("prev_state").startswith("D")).alias("thread_block_count"),
        ((F.max("ts") - F.min("ts")) / F.lit(1e6)).alias("_s"))
    return out.withColumn("minor_page_fault_rate", X.safe_div("minor_page_faults", "_s")).drop("_s")


def npu_idle(ev: DataFrame, K: Sequence[str] = K, threshold_us: int = 10_000, split_rows: int | None = None) -> DataFrame:
    """Device idle share of the trace on one timeline, gaps above the threshold, spacing of the device events."""
    dev = TL.device_kernels(ev)
    span = ev.groupBy(*K).agg((F.max("ts") - F.min("ts")).alias("_span"))
    seq = KeyedSequence(dev.select(*K, "ts", "seq", "dur"), K, TL.ORDER, split_rows)
    seq.shift({"_pt": "ts", "_pd": "dur"}, by=-1)
    rows = seq.result().withColumn("_gap", F.col("ts") - F.col("_pt") - F.col("_pd"))
    big = F.when(F.col("_gap") > threshold_us, F.col("_gap"))
    agg = rows.groupBy(*K).agg(
        F.sum("dur").alias("_busy"), F.count(F.lit(1)).alias("npu_op_count"), F.count(big).alias("npu_idle_gap_count"),
        (F.coalesce(F.max(big), F.lit(0)) / 1000).alias("npu_idle_max_gap_ms"),
        (F.avg(big) / 1000).alias("npu_idle_avg_gap_ms"),
        (F.avg(F.col("ts") - F.col("_pt")) / 1000).alias("kernel_launch_gap_avg_ms"))
    p99 = percentiles(rows.withColumn("_step", F.col("ts") - F.col("_pt")), K, "_step", {"_p": 0.99}, "nearest")
    out = agg.join(span, list(K)).join(p99, list(K), "left")
    return out.select(
        *K, ((1 - X.safe_div("_busy", F.greatest("_span", F.lit(1)))) * 100).alias("npu_idle_ratio"), "npu_op_count",
        "npu_idle_gap_count", "npu_idle_max_gap_ms", "npu_idle_avg_gap_ms", "kernel_launch_gap_avg_ms",
        (F.col("_p") / 1000).alias("kernel_launch_gap_p99_ms"))


def cpu_util_idle(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    """Busy share per cpu from idle enter (state > 0) and exit (state 0) marks: columns ``cpu, ts, state``."""
    span = ev.groupBy(*K).agg((F.max("ts") - F.min("ts")).alias("_span"))
    marks = ev.where("cpu >= 0 and state is not null").select(*K, "cpu", "ts", "seq", (F.col("state") > 0).alias("is_start"))
    idle = TL.pair_last_start(marks, [*K, "cpu"], split_rows=split_rows).groupBy(*K, "cpu").agg(
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("idle_us"))
    return idle.join(span, list(K)).select(
        *K, "cpu", "idle_us", ((1 - X.safe_div("idle_us", "_span")) * 100).alias("util_pct"))


def cpu_util_bucket(ev: DataFrame, K: Sequence[str] = K, bucket_us: int = 10_000) -> DataFrame:
    """Share of (cpu, bucket) cells holding a switch; cells are made distinct before the trace total."""
    sw = TL.switches(ev).where("cpu >= 0")
    cells = sw.groupBy(*K, "cpu", F.floor(F.col("ts") / F.lit(int(bucket_us)).cast("long")).alias("_b")).agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    per = cells.groupBy(*K, "cpu").agg(F.count(F.lit(1)).alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    out = per.groupBy(*K).agg(
        F.sum("_n").alias("busy_cells"), F.count(F.lit(1)).alias("cpus"),
        ((F.max("_hi") - F.min("_lo")) / F.lit(float(bucket_us))).alias("_buckets"))
    return out.withColumn(
        "util_pct", X.safe_div("busy_cells", F.col("_buckets") * F.col("cpus")) * 100).drop("_buckets")


def loader_share(ev: DataFrame, K: Sequence[str] = K, start: str = "dataloader_start", end: str = "dataloader_end",
                 split_rows: int | None = None) -> DataFrame:
    """Time between start and end marks as percent of the trace; a later start replaces an open one."""
    span = ev.groupBy(*K).agg((F.max("ts") - F.min("ts")).alias("_span"))
    marks = ev.where(F.col("name").isin(start, end)).select(*K, "ts", "seq", (F.col("name") == start).alias("is_start"))
    busy = TL.pair_last_start(marks, K, split_rows=split_rows).groupBy(*K).agg(
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("loader_us"))
    return span.join(busy, list(K), "left").select(
        *K, F.coalesce("loader_us", F.lit(0)).alias("loader_us"),
        (X.safe_div(F.coalesce("loader_us", F.lit(0)), "_span") * 100).alias("dataloader_time_pct"))


def metric_record(ev: DataFrame, K: Sequence[str] = K, window_us: int = 100_000, cpu_count: int = 1) -> DataFrame:
    """Wide line-trace record per trace, the input of the boolean rules.  Absent parts stay null, so their rules are false."""
    K = list(K)
    windows = window_rollup(TL.window_summary(ev, K, window_us), K, window_us, cpu_count)
    cores = core_share(TL.cpu_distribution(ev, K, window_us), K, cpu_count).groupBy(*K).agg(
        F.max("core_util").alias("cpu_util_max"),
        F.when(F.count("core_util") > 1, F.try_divide(F.stddev_samp("core_util"), F.avg("core_util"))).otherwise(0.0).alias("cpu_balance"))
    lat = latency_stats(TL.sched_latency(ev, K), K, method="nearest").select(
        *K, (F.col("mean") / 1000).alias("sched_latency_avg_ms"), (F.col("p99") / 1000).alias("sched_latency_p99_ms"),
        (F.col("p99_9") / 1000).alias("sched_latency_p99_9_ms"), (F.col("max") / 1000).alias("sched_latency_max_ms"))
    span = ev.groupBy(*K).agg(((F.max("ts") - F.min("ts")) / F.lit(1e6)).alias("duration_s"))
    moves = TL.cpu_migration(ev, K).join(span, K).select(*K, X.safe_div("migrations", "duration_s").alias("cpu_migration_rate"))
    parts = [windows, cores, lat, numa_ratio(ev, K), io_pending(ev, K), moves]
    if "fault_type" in ev.columns:
        parts.append(fault_counts(ev, K))
    parts += [loader_share(ev, K)]
    if "device_id" in ev.columns:
        parts.append(npu_idle(ev, K))
    out = span.withColumn("cpu_count", F.lit(cpu_count))
    for part in parts:
        out = out.join(part, K, "left")
    return out
