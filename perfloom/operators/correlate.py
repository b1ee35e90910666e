"""Device idle gaps against host events: overlap join, attribution, look-back patterns, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.events import K, host_events
from perfloom.operators.ranges import covering_cells, spans_around, upper_cells
from perfloom.operators.sequence import KeyedSequence, same_keys, top_k

GAP_ID = ("device_id", "stream_id", "gap_start")
HOST_COLS = ("host_seq", "host_name", "host_cat", "host_ts", "host_dur")


def _hosts(ev: DataFrame, K: Sequence[str]) -> DataFrame:
    return host_events(ev).select(
        *K, F.col("seq").alias("host_seq"), F.col("name").alias("host_name"), F.col("cat").alias("host_cat"),
        F.col("ts").alias("host_ts"), F.col("dur").alias("host_dur"))


def gap_host_join(gaps: DataFrame, ev: DataFrame, K: Sequence[str] = K, max_offset_us: int | None = 5000,
                  top_n: int = 5, bucket_us: int | None = None, keep_empty: bool = True) -> DataFrame:
    """Host events overlapping each gap, longest ``top_n`` first.

    With ``max_offset_us`` a host event that started earlier than that before the gap is left out (the default rule);
    None takes every overlap.  Gaps without host events stay with null host columns.
    """
    bucket_us = bucket_us or max(max_offset_us or 0, 5000)
    order = [F.desc("host_dur"), F.asc("host_ts"), F.asc("host_seq")]
    hosts = _hosts(ev, K).withColumn("host_end", F.col("host_ts") + F.col("host_dur"))
    width = F.lit(int(bucket_us)).cast("long")
    lo = F.col("gap_start") if max_offset_us is None else F.greatest(F.lit(0).cast("long"), F.col("gap_start") - max_offset_us)
    slim = gaps.select(*K, *GAP_ID, "gap_end").withColumn("_lo", lo).where("_lo <= gap_end").withColumns({
        "_in0": F.ceil(F.col("gap_start") / width), "_in1": F.floor((F.col("gap_end") + 1) / width) - 1})
    starts = hosts.withColumn("_bucket", F.floor(F.col("host_ts") / width))
    cols = [*K, *GAP_ID, *HOST_COLS]

    # Host events that start in a bucket inside the gap: of each cell that covers these buckets the best are enough.
    best = top_k(starts, [*K, "_bucket"], order, top_n, "_r").drop("_r")
    higher = top_k(upper_cells(best, "_bucket"), [*K, "_floor", "_node"], order, top_n, "_r").drop("_r")
    by_cell = best.withColumns({"_floor": F.lit(0), "_node": F.col("_bucket")}).unionByName(higher)
    inner = covering_cells(slim.where("_in0 <= _in1"), "_in0", "_in1").join(by_cell, [*K, "_floor", "_node"]).select(*cols)
    # The few buckets at the gap's ends: each host event is tested.
    first, last = F.floor(F.col("_lo") / width), F.floor(F.col("gap_end") / width)
    ends = F.when(F.col("_in0") > F.col("_in1"), F.sequence(first, last)).otherwise(F.concat(
        F.when(first < F.col("_in0"), F.sequence(first, F.col("_in0") - 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("_in1") < last, F.sequence(F.col("_in1") + 1, last)).otherwise(F.array().cast("array<bigint>"))))
    edge = slim.withColumn("_bucket", F.explode(ends)).join(starts, [*K, "_bucket"]).where(
        (F.col("host_ts") >= F.col("_lo")) & (F.col("host_ts") <= F.col("gap_end")) & (F.col("host_end") >= F.col("gap_start"))).select(*cols)
    pairs = inner.unionByName(edge)
    if max_offset_us is None:
        # Host events that began before the gap and reach into it are those around its start.
        begun = spans_around(slim, hosts.where("host_dur > 0"), K, "gap_start", "host_ts", "host_end").where("host_ts < gap_start")
        pairs = pairs.unionByName(begun.select(*cols))
    best = top_k(pairs, [*K, *GAP_ID], order, top_n)
    if not keep_empty:
        return gaps.join(best, [*K, *GAP_ID])
    return gaps.join(best, [*K, *GAP_ID], "left")


def attribute_gaps(joined: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """One row per gap: the class of its longest host event and min(host_dur/gap_dur, 1)."""
    one = joined.where("rank = 1 or rank is null")
    found = F.col("host_seq").isNotNull()
    return one.select(
        *K, *GAP_ID, "gap_end", "gap_dur",
        F.when(found, X.attribution_class("host_cat", "host_name")).otherwise("OTHER").alias("attribution"),
        F.when(found, F.least(X.safe_div("host_dur", "gap_dur"), F.lit(1.0))).otherwise(0.0).alias("confidence"))


def attribution_share(attributed: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Share of idle time per class; at most seven rows per trace reach the window."""
    per = attributed.groupBy(*K, "attribution").agg(F.sum("gap_dur").alias("gap_us"))
    total = F.sum("gap_us").over(Window.partitionBy(*K))
    return per.withColumn("ratio", X.safe_div("gap_us", total))


def critical_path(gaps: DataFrame, ev: DataFrame, K: Sequence[str] = K, n: int = 5, **join_args) -> DataFrame:
    """The ``n`` longest gaps of each trace with their host events, longest first."""
    top = top_k(gaps, K, [F.desc("gap_dur"), F.asc("gap_start"), F.asc("device_id"), F.asc("stream_id")], n, "gap_rank")
    joined = gap_host_join(top, ev, K, **join_args)
    host = F.when(F.col("host_seq").isNotNull(), F.struct("rank", "host_name", "host_cat", "host_ts", "host_dur"))
    keys = [*K, "gap_rank", *GAP_ID, "gap_end", "gap_dur", "prev_kernel", "next_kernel"]
    return joined.groupBy(*keys).agg(F.sort_array(F.collect_list(host)).alias("host_events"))


def host_device_corr(gaps: DataFrame, ev: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000, flat: float = 0.0) -> DataFrame:
    """Pearson correlation of host busy share and device idle share over dense windows, negative values as 0.

    Windows are counted from the trace start.  Empty windows add zeros to every sum, so they only enter through the
    window count and no dense series is built.  Shares are kept in whole microseconds and summed as such, so a share that is the
    same in all windows is told exactly; there is no correlation then, and the score is ``flat``.
    """
    start = ev.groupBy(*K).agg(
        F.min("ts").alias("_t0"),
        (F.max(F.greatest(F.col("ts"), F.col("ts") + F.col("dur"))) - F.min("ts")).alias("_len"))
    w = F.lit(int(window_us)).cast("long")
    marks = host_events(ev, busy=True).select(*K, F.col("ts").alias("_t"), F.col("dur").alias("_h"),
                                             F.lit(0).cast("long").alias("_d"))
    marks = marks.unionByName(gaps.select(*K, F.col("gap_start").alias("_t"), F.lit(0).cast("long").alias("_h"),
                                          F.col("gap_dur").alias("_d")))
    start = start.select(*[F.col(k).alias(f"_s_{k}") for k in K], "_t0",
                         F.greatest(F.lit(1).cast("long"), F.floor(F.greatest("_len", F.lit(1)) / w)).alias("n_windows"))
    on = [(k, f"_s_{k}") for k in K]
    m = marks.join(start, same_keys(marks, start, on))
    per = m.groupBy(*K, "n_windows", F.floor((F.col("_t") - F.col("_t0")) / w).alias("_w")).agg(
        F.least(F.sum("_h"), w).cast("decimal(19,0)").alias("_x"), F.least(F.sum("_d"), w).cast("decimal(19,0)").alias("_y"))
    per = per.where("_w >= 0 and _w < n_windows")
    x, y, n, whole = F.col("_x"), F.col("_y"), F.col("n_windows").cast("decimal(19,0)"), "decimal(38,0)"
    sums = per.groupBy(*K, "n_windows").agg(*[
        F.sum(v.cast(whole)).alias(name) for name, v in (("_sx", x), ("_sy", y), ("_sxy", x * y), ("_sxx", x * x), ("_syy", y * y))])

    def moment(ab: str, a: str, b: str):
        """n * sum(ab) - sum(a) * sum(b), exactly."""
        return (n * F.col(ab)).cast(whole) - (F.col(a) * F.col(b)).cast(whole)

    sums = sums.withColumns({"_cov": moment("_sxy", "_sx", "_sy"), "_vx": moment("_sxx", "_sx", "_sx"), "_vy": moment("_syy", "_sy", "_sy")})
    spread = F.sqrt(F.col("_vx").cast("double")) * F.sqrt(F.col("_vy").cast("double"))
    score = F.when((F.col("_vx") == 0) | (F.col("_vy") == 0), F.lit(flat)).otherwise(
        F.greatest(F.col("_cov").cast("double") / spread, F.lit(0.0)))
    found = sums.select(*K, score.alias("_score"))
    base = start.withColumnsRenamed({f"_s_{k}": k for k in K}).drop("_t0")
    return base.join(found, list(K), "left").select(
        *K, "n_windows", F.coalesce("_score", F.lit(flat)).alias("score"))


# Look-back per cause pattern (us) and its base confidence.
LOOKBACK_US = {"CPU_SCHED_CONTENTION": 50_000, "IO_BLOCK": 100_000, "MEMORY_PRESSURE": 200_000}
PATTERN_CONFIDENCE = {"CPU_SCHED_CONTENTION": 0.85, "IO_BLOCK": 0.78, "MEMORY_PRESSURE": 0.72,
                      "KERNEL_LAUNCH_GAP": 0.60}


def gap_lookback(gaps: DataFrame, signals: DataFrame, K: Sequence[str] = K, lookback_us: dict[str, int] = LOOKBACK_US,
                 launch_gap_us: int = 20_000, split_rows: int | None = None) -> DataFrame:
    """Evidence before each gap and the strongest cause pattern.

    ``signals`` holds ``ts`` and the booleans ``queue_high, sched_delay, io_pending, d_state, major_fault``.  Gaps and signals are
    merged by time and the last time of each flag is carried along, so a flag was seen in a look-back if its last time lies in
    it: one row per gap and signal, no pairs.
    """
    flags = ("queue_high", "sched_delay", "io_pending", "d_state", "major_fault")
    gap = F.struct(*[c for c in gaps.columns if c not in K])
    asks = gaps.select(*K, F.col("gap_start").alias("_at"), gap.alias("_gap"), F.lit(0).alias("_side"))
    points = signals.select(*K, F.col("ts").alias("_at"), *flags, F.lit(1).alias("_side")).where(" or ".join(flags))
    both = asks.unionByName(points, allowMissingColumns=True)
    # a signal at the gap's start comes after the gap, so it does not count
    seq = KeyedSequence(both, K, ["_at", "_side", F.xxhash64("_gap", *flags)], split_rows)
    seq.scan({f"_last_{f}": ("max", F.when(F.col(f), F.col("_at"))) for f in flags} | {"_last": ("max", F.when(F.col("_side") == 1, F.col("_at")))})
    rows = seq.result().where("_side = 0").select(*K, "_gap.*", *[f"_last_{f}" for f in flags], "_last")

    def seen(flag: str, pattern: str):
        return F.coalesce(F.col(f"_last_{flag}") >= F.col("gap_start") - lookback_us[pattern], F.lit(False))

    out = rows.select(
        *gaps.columns,
        (seen("queue_high", "CPU_SCHED_CONTENTION") & seen("sched_delay", "CPU_SCHED_CONTENTION")).alias("_a"),
        (seen("io_pending", "IO_BLOCK") & seen("d_state", "IO_BLOCK")).alias("_b"), seen("major_fault", "MEMORY_PRESSURE").alias("_c"),
        F.when(F.col("_last") >= F.col("gap_start") - max(lookback_us.values()), F.col("_last")).alias("closest_ts"))
    pattern = X.first_match(
        (F.col("_a"), "CPU_SCHED_CONTENTION"), (F.col("_b"), "IO_BLOCK"), (F.col("_c"), "MEMORY_PRESSURE"), (F.col("gap_dur") > launch_gap_us, "KERNEL_LAUNCH_GAP"))
    return out.withColumn("pattern", pattern).withColumn(
        "confidence", X.lookup(F.col("pattern"), PATTERN_CONFIDENCE)).drop("_a", "_b", "_c")


def gap_patterns(looked: DataFrame, K: Sequence[str] = K, near_us: int = 10_000, far_us: int = 50_000) -> DataFrame:
    """Adjusted confidence per matched gap: +.05 near evidence, -.10 far evidence, +.10 for a pattern on over 80 % of
    the gaps, at most 1."""
    freq = looked.groupBy(*K).agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(F.col("pattern") == p).alias(f"_n_{p}") for p in PATTERN_CONFIDENCE])
    freq = freq.select(*[F.col(k).alias(f"_f_{k}") for k in K], "_all", *[f"_n_{p}" for p in PATTERN_CONFIDENCE])
    m = looked.where("pattern is not null")
    m = m.join(freq, same_keys(m, freq, [(k, f"_f_{k}") for k in K]))
    hits = X.first_match(*[(F.col("pattern") == p, F.col(f"_n_{p}")) for p in PATTERN_CONFIDENCE])
    wait = F.col("gap_start") - F.col("closest_ts")
    adj = F.when(wait < near_us, 0.05).when(wait > far_us, -0.10).otherwise(0.0)
    common = F.when(hits / F.col("_all") > 0.8, 0.10).otherwise(0.0)
    return m.withColumn("adjusted", F.least(F.col("confidence") + adj + common, F.lit(1.0))).drop(
        "_all", *[f"_n_{p}" for p in PATTERN_CONFIDENCE], *[f"_f_{k}" for k in K])


def primary_pattern(looked: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Most common pattern per trace with counts."""
    counts = looked.where("pattern is not null").groupBy(*K, "pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*K).agg(
        F.max_by("pattern", F.struct("n", "pattern")).alias("primary_pattern"), F.sum("n").alias("correlated_gaps"))
