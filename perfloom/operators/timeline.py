"""Sequence and window operators on the event table: gaps, CPU slices, pairing, timelines, greedy windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfloom.operators.events import DEVICE_TOKENS, K, step_markers
from perfloom.operators.sequence import KeyedSequence, same_keys, top_k
from perfloom.functions import exprs as X
from perfloom.schema import DEVICE_CATEGORIES

ORDER = ("ts", "seq")


def _bucket(ts: str | Column, width: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(int(width)).cast("long")) * F.lit(int(width)).cast("long")


def device_kernels(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("device_id") >= 0) & F.col("cat").isin(*DEVICE_CATEGORIES))


# ---------------------------------------------------------------- gaps

def gap_scan(ev: DataFrame, K: Sequence[str] = K, min_gap_us: int = 100, exact: bool = False,
             stream_keys: Sequence[str] = ("device_id", "stream_id"), split_rows: int | None = None) -> DataFrame:
    """Idle time between neighbouring kernels of a stream.

    The default compares neighbours only; ``exact`` measures from the latest end seen so far, so a long kernel over
    short ones leaves no false gap.
    """
    slim = device_kernels(ev).select(*K, *stream_keys, "ts", "dur", "name", "seq")
    seq = KeyedSequence(slim, [*K, *stream_keys], ORDER, split_rows)
    seq.derive(_end=F.col("ts") + F.col("dur"))
    if exact:
        seq.running("_last", "max", "_end").derive(_end=F.col("_last"))
    seq.shift({"gap_end": "ts", "next_kernel": "name"}, by=1)
    return (
        seq.result()
        .select(*K, *stream_keys, F.col("_end").alias("gap_start"), "gap_end",
                (F.col("gap_end") - F.col("_end")).alias("gap_dur"), F.col("name").alias("prev_kernel"), "next_kernel")
        .where((F.col("gap_dur") > 0) & (F.col("gap_dur") >= min_gap_us))
    )


def gap_stats(ev: DataFrame, gaps: DataFrame, K: Sequence[str] = K, significant_us: int = 1000) -> DataFrame:
    """Totals over all positive gaps and all kernels of each trace."""
    zero = F.lit(0).cast("long")
    both = device_kernels(ev).select(*K, F.col("dur").alias("_k"), zero.alias("_g"), zero.alias("_n"), zero.alias("_s"))
    both = both.unionByName(gaps.select(
        *K, zero.alias("_k"), F.col("gap_dur").alias("_g"), F.lit(1).cast("long").alias("_n"),
        (F.col("gap_dur") >= significant_us).cast("long").alias("_s")))
    out = both.groupBy(*K).agg(
        F.sum("_g").alias("total_gap_us"), F.sum("_k").alias("total_kernel_us"),
        F.sum("_n").alias("gap_count"), F.sum("_s").alias("significant_count"))
    return out.withColumn(
        "utilization", X.safe_div("total_kernel_us", F.col("total_kernel_us") + F.col("total_gap_us")))


def pareto(df: DataFrame, K: Sequence[str], measure: str, threshold: float = 0.8, ties: Sequence[str | Column] = (),
           top_n: int | None = None, split_rows: int | None = None) -> DataFrame:
    """Largest rows per key until they cover ``threshold`` of the total, the crossing row included."""
    seq = KeyedSequence(df, K, [-F.col(measure), *ties], split_rows)
    out = seq.scan({"cum": ("sum", measure), "rank": ("sum", F.lit(1).cast("long"))}, {"_total": ("sum", measure)}).result()
    out = out.where((F.col("_total") > 0) & ((F.col("cum") - F.col(measure)) < F.col("_total") * F.lit(threshold)))
    if top_n:
        out = out.where(F.col("rank") <= top_n)
    return out.drop("_total")


GAP_EDGES = (("<1ms", 0, 1000), ("1-5ms", 1000, 5000), ("5-10ms", 5000, 10000), ("10-50ms", 10000, 50000),
             ("50-100ms", 50000, 100000), (">100ms", 100000, None))


def gap_histogram(gaps: DataFrame, K: Sequence[str] = K, edges=GAP_EDGES) -> DataFrame:
    """Count and total per half-open bucket; empty buckets stay.  One aggregate per bucket, then one small explode."""
    g = F.col("gap_dur")
    aggs, rows = [], []
    for i, (label, lo, hi) in enumerate(edges):
        inside = (g >= lo) if hi is None else (g >= lo) & (g < hi)
        aggs += [F.count_if(inside).alias(f"_n{i}"), F.coalesce(F.sum(F.when(inside, g)), F.lit(0)).alias(f"_t{i}")]
        rows.append(F.struct(F.lit(label).alias("label"), F.col(f"_n{i}").alias("count"),
                             F.col(f"_t{i}").alias("total_gap_us")))
    return gaps.groupBy(*K).agg(*aggs).select(*K, F.inline(F.array(*rows)))


# ---------------------------------------------------------------- scheduler

def switches(ev: DataFrame) -> DataFrame:
    return ev.where((F.col("cat") == "cpu_sched") & F.lower("name").contains("switch"))


def cpu_slices(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    """Time before each switch belongs to the task switched out (pid 0 is idle)."""
    sw = switches(ev).where("cpu >= 0").select(*K, "cpu", "ts", "seq", "prev_pid")
    seq = KeyedSequence(sw, [*K, "cpu"], ORDER, split_rows).shift({"slice_start": "ts"}, by=-1)
    return seq.result().where("slice_start is not null and ts > slice_start").select(
        *K, "cpu", "slice_start", (F.col("ts") - F.col("slice_start")).alias("delta"), "prev_pid")


def cpu_util(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    idle = F.col("prev_pid") == 0
    out = cpu_slices(ev, K, split_rows).groupBy(*K, "cpu").agg(
        F.coalesce(F.sum(F.when(~idle, F.col("delta"))), F.lit(0)).alias("running_us"),
        F.coalesce(F.sum(F.when(idle, F.col("delta"))), F.lit(0)).alias("idle_us"))
    return out.withColumn("util", X.safe_div("running_us", F.col("running_us") + F.col("idle_us")))


def thread_states(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    """Running slices per cpu: from a switch-in to the next switch on that cpu, with the state it left in."""
    sw = switches(ev).where("cpu >= 0").select(*K, "cpu", "ts", "seq", "next_pid", "prev_state")
    seq = KeyedSequence(sw, [*K, "cpu"], ORDER, split_rows).shift({"end_ts": "ts", "end_state": "prev_state"}, by=1)
    return seq.result().where("end_ts is not null").select(
        *K, "cpu", F.col("next_pid").alias("pid"), F.col("ts").alias("start_ts"),
        (F.col("end_ts") - F.col("ts")).alias("run_us"), "end_state")


def pair_last_start(marks: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER,
                    split_rows: int | None = None) -> DataFrame:
    """Ends matched with the latest start of their key; a start serves one end.  ``marks`` has a boolean ``is_start``.

    An end takes a start exactly when the row before it in its key is a start, so one neighbour look-up decides.
    """
    seq = KeyedSequence(marks, keys, order, split_rows).shift({"start_ts": "ts", "_was": "is_start"}, by=-1)
    return seq.result().where("NOT is_start AND _was").drop("_was", "is_start").withColumnRenamed("ts", "end_ts")


def sched_latency(ev: DataFrame, K: Sequence[str] = K, pid: int | None = None,
                  split_rows: int | None = None) -> DataFrame:
    """Wakeup to next switch-in of the same pid."""
    name = F.lower("name")
    is_switch = name.contains("switch")
    marks = ev.where((F.col("cat") == "cpu_sched") & (is_switch | name.contains("wakeup"))).select(
        *K, F.when(is_switch, F.col("next_pid")).otherwise(F.col("wake_pid")).alias("pid"), "ts", "seq",
        (~is_switch).alias("is_start")).where("pid >= 0")
    if pid is not None:
        marks = marks.where(F.col("pid") == pid)
    return pair_last_start(marks, [*K, "pid"], split_rows=split_rows).select(
        *K, "pid", F.col("start_ts").alias("wake_ts"), F.col("end_ts").alias("switch_ts"),
        (F.col("end_ts") - F.col("start_ts")).alias("latency_us")).where("latency_us >= 0")


def cpu_migration(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    """Switch-ins of a pid on another cpu than its last one, per trace and per second of trace."""
    sw = switches(ev).select(*K, F.col("next_pid").alias("pid"), "cpu", "ts", "seq")
    seq = KeyedSequence(sw, [*K, "pid"], ORDER, split_rows).shift({"last_cpu": "cpu"}, by=-1)
    return seq.result().groupBy(*K).agg(
        F.count_if(F.col("last_cpu").isNotNull() & (F.col("last_cpu") != F.col("cpu"))).alias("migrations"))


# ---------------------------------------------------------------- tumbling and sliding series

def timeline(ev: DataFrame, metric: str, K: Sequence[str] = K, window_us: int = 1_000_000, cpus: int = 1,
             split_rows: int | None = None) -> DataFrame:
    """(ts, value) per non-empty window for ``ctx_rate``, ``runqueue`` or ``cpu_util``."""
    if metric == "cpu_util":
        busy = cpu_slices(ev, K, split_rows).where("prev_pid <> 0")
        return busy.groupBy(*K, _bucket("slice_start", window_us).alias("ts")).agg(
            F.least(F.sum("delta") / F.lit(float(window_us * max(cpus, 1))), F.lit(1.0)).alias("value"))
    sw = switches(ev)
    if metric == "runqueue":
        return sw.where(F.upper("prev_state").contains("R")).groupBy(*K, _bucket("ts", window_us).alias("ts")).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
    return sw.groupBy(*K, _bucket("ts", window_us).alias("ts")).agg(
        (F.count(F.lit(1)) / F.lit(window_us / 1e6)).alias("value"))


def util_by_window(ev: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000) -> DataFrame:
    return ev.where("dur > 0 and cpu >= 0").groupBy(*K, "cpu", _bucket("ts", window_us).alias("window_start")).agg(
        (F.sum("dur") / F.lit(float(window_us)) * 100).alias("util_pct"))


def sliding_util(ev: DataFrame, K: Sequence[str] = K, window_us: int = 1_000_000,
                 slide_us: int = 500_000) -> DataFrame:
    """Busy share per overlapping window; each row adds to window_us/slide_us windows before the shuffle combines."""
    n = window_us // slide_us
    pre = ev.where("dur > 0 and cpu >= 0").groupBy(*K, "cpu", _bucket("ts", slide_us).alias("_s")).agg(
        F.sum("dur").alias("_d"))
    return (
        pre.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .groupBy(*K, "cpu", (F.col("_s") - F.col("_i") * slide_us).alias("window_start"))
        .agg((F.sum("_d") / F.lit(float(window_us)) * 100).alias("util_pct"))
    )


def step_timeline(ev: DataFrame, K: Sequence[str] = K, split_rows: int | None = None) -> DataFrame:
    """Ordered step markers with the change of duration against the step before."""
    seq = KeyedSequence(step_markers(ev).select(*K, "ts", "seq", "dur", "name", "cat"), K, ORDER, split_rows)
    seq.rank("step_no").shift({"_prev": "dur"}, by=-1)
    return seq.result().select(*K, "step_no", F.col("ts").alias("step_ts"), F.col("dur").alias("step_dur"), "name", "cat",
                               (F.col("dur") - F.col("_prev")).alias("dur_change"))


def hot_functions(ev: DataFrame, K: Sequence[str] = K, top_n: int = 20, categories: Sequence[str] | None = None) -> DataFrame:
    if categories:
        ev = ev.where(F.col("cat").isin(*categories))
    agg = ev.where("dur > 0").groupBy(*K, "name").agg(
        F.sum("dur").alias("total_dur"), F.count(F.lit(1)).alias("count"),
        F.avg("dur").alias("avg_dur"), F.max("dur").alias("max_dur"))
    return top_k(agg, K, [F.desc("total_dur"), F.asc("name")], top_n)


def downsample(df: DataFrame, K: Sequence[str], order: Sequence[str], keep: int = 500,
               split_rows: int | None = None) -> DataFrame:
    """At most ``keep`` rows per key at an even step over its whole range, as a report series."""
    out = KeyedSequence(df, K, order, split_rows).scan({"_r": ("sum", F.lit(1).cast("long"))}, {"_n": ("count", F.lit(1))}).result()
    step = F.ceil(F.col("_n") / keep)
    return out.where((F.col("_r") - 1) % step == 0).drop("_r", "_n")


def spikes(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether any value of a (ts, value) series is above mean + 2 population deviations and positive; needs 2 values."""
    stats = series.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("_sd"),
        F.max("value").alias("peak"))
    hit = (F.col("n") >= 2) & (F.col("peak") > F.col("mean") + 2 * F.col("_sd")) & (F.col("peak") > 0)
    return stats.select(*keys, "n", "mean", "peak", hit.alias("spike"))


def ffill(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
          split_rows: int | None = None) -> DataFrame:
    """Carry the last non-null value of each column down."""
    seq = KeyedSequence(df, keys, order, split_rows).scan({f"{c}_filled": ("last", c) for c in cols})
    return seq.result().drop(*cols).withColumnsRenamed({f"{c}_filled": c for c in cols})


# ---------------------------------------------------------------- window summaries

def _summary_aggs() -> list[Column]:
    name = F.col("name")
    device = X.any_contains(name, DEVICE_TOKENS)
    return [
        F.count_if(name == "sched_switch").alias("sched_switch_count"),
        F.count_if((name == "sched_switch") & F.col("prev_state").startswith("R")).alias("runnable_count"),
        F.count_if(name.isin("sched_wakeup", "sched_waking")).alias("wakeup_count"),
        F.count_if(name == "numa_local").alias("numa_local"),
        F.count_if(name == "numa_remote").alias("numa_remote"),
        F.count_if(name == "block_rq_issue").alias("io_issue_count"),
        F.count_if(name == "block_rq_complete").alias("io_complete_count"),
        F.count_if(device).alias("npu_op_count"),
        F.coalesce(F.sum(F.when(device, F.col("dur"))), F.lit(0)).alias("npu_busy_time"),
    ]


def window_summary(ev: DataFrame, K: Sequence[str] = K, window_us: int = 100_000, mode: str = "tumbling",
                   split_rows: int | None = None) -> DataFrame:
    """Counts per time window.  ``anchored`` opens a window at the first event after the last one closed."""
    if mode == "tumbling":
        return ev.groupBy(*K, _bucket("ts", window_us).alias("window_start")).agg(*_summary_aggs())
    ids = anchored_windows(ev, K, window_us, split_rows)
    marked = ev.join(ids.drop("ts"), [*K, "seq"])
    return marked.groupBy(*K, "window_start").agg(*_summary_aggs())


def cpu_distribution(ev: DataFrame, K: Sequence[str] = K, window_us: int = 100_000) -> DataFrame:
    return switches(ev).groupBy(*K, _bucket("ts", window_us).alias("window_start"), "cpu").agg(
        F.count(F.lit(1)).alias("switches"))


def _greedy(ts: np.ndarray, width: int, open_start: int | None) -> np.ndarray:
    """Window start of each event.  A window closes with the event that is ``width`` or more after its start."""
    starts = np.empty(len(ts), dtype=np.int64)
    i, cur = 0, open_start
    while i < len(ts):
        if cur is None:
            cur = int(ts[i])
        j = int(np.searchsorted(ts, cur + width, side="left")) if ts[i] < cur + width else i
        stop = min(j + 1, len(ts))
        starts[i:stop] = cur
        i, cur = stop, (cur if j >= len(ts) else None)
    return starts


def anchored_windows(ev: DataFrame, K: Sequence[str] = K, window_us: int = 100_000,
                     split_rows: int | None = None) -> DataFrame:
    """(seq, ts, window_start) of greedy windows.

    Where a window opens depends on where the one before closed, so a trace is cut into ordered chunks.  Each chunk first
    reports how it would leave for every state it may be entered in (the window open at its start), compressed to the
    distinct outcomes; the small reports are composed along the trace; then every chunk is labelled on its own.
    """
    slim = ev.select(*K, "ts", "seq")
    seq = KeyedSequence(slim, K, ORDER, split_rows)
    if not seq.split:
        seq.df = seq.df.withColumn("_chunk", F.lit(0))
    chunks = seq.df.select(*K, "_chunk", "ts", "seq")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*K).schema.fields)
    K = list(K)
    label_schema = f"{key_ddl}, seq bigint, ts bigint, window_start bigint"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        opened = None
        if "_open" in pdf and not pd.isna(pdf["_open"].iloc[0]):
            opened = int(pdf["_open"].iloc[0])
        pdf = pdf.assign(window_start=_greedy(pdf["ts"].to_numpy(), window_us, opened))
        return pdf[[*K, "seq", "ts", "window_start"]]

    if not seq.split:
        return chunks.groupBy(*K).applyInPandas(label, label_schema)

    def outcomes(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows (upto, leave): entered with an open start s, lowest ``upto`` >= s + width says how the chunk is left."""
        ts = np.sort(pdf["ts"].to_numpy())
        n = len(ts)
        # A window that opens at event i is followed by one at ``after[i]``; pointers double until they stand at the chunk's last
        # window, which is still open (an event), or at n, where none is.
        nxt = np.searchsorted(ts, ts + window_us, side="left") + 1
        after = np.append(np.where(nxt > n, np.arange(n), nxt), n)
        while not np.array_equal(further := after[after], after):
            after = further
        open_at = np.append(ts, -1)[after]      # open start at the end when a window opens at event i
        is_open = after < n
        # Entered open, the window closes at an event j that is the first of its time, and the next opens at j + 1.
        j = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
        j = j[: np.searchsorted(ts[j], ts[0] + window_us, side="left") + 1]
        leave, known = open_at[j + 1], is_open[j + 1]
        last_of = np.append((leave[1:] != leave[:-1]) | (known[1:] != known[:-1]), True)
        out = pd.DataFrame({"upto": pd.array(ts[j[last_of]], dtype="Int64"), "leave": pd.array(leave[last_of], dtype="Int64")})
        out.loc[~known[last_of], "leave"] = pd.NA
        out["fresh"] = pd.array([int(open_at[0]) if is_open[0] else pd.NA] * len(out), dtype="Int64")
        out["last"] = int(ts[-1])
        for k in K:
            out[k] = pdf[k].iloc[0]
        out["_chunk"] = pdf["_chunk"].iloc[0]
        return out[[*K, "_chunk", "upto", "leave", "fresh", "last"]]

    report_schema = f"{key_ddl}, _chunk int, upto bigint, leave bigint, fresh bigint, last bigint"
    reports = chunks.groupBy(*K, "_chunk").applyInPandas(outcomes, report_schema)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, state = [], None
        for chunk, part in pdf.sort_values(["_chunk", "upto"]).groupby("_chunk", sort=True):
            rows.append((chunk, state))
            if state is None:
                nxt = part["fresh"].iloc[0]
            else:
                hit = part[part["upto"] >= state + window_us]
                nxt = state if int(part["last"].iloc[0]) < state + window_us else hit["leave"].iloc[0]
            state = None if pd.isna(nxt) else int(nxt)
        out = pd.DataFrame(rows, columns=["_e_chunk", "_open"]).astype({"_open": "Int64"})
        for k in K:
            out[f"_e_{k}"] = pdf[k].iloc[0]
        return out[[*[f"_e_{k}" for k in K], "_e_chunk", "_open"]]

    entry_ddl = ", ".join(f"`_e_{f.name}` {f.dataType.simpleString()}" for f in slim.select(*K).schema.fields)
    entries = reports.groupBy(*K).applyInPandas(compose, f"{entry_ddl}, _e_chunk int, _open bigint")
    on = [(k, f"_e_{k}") for k in K] + [("_chunk", "_e_chunk")]
    opened = chunks.join(entries, same_keys(chunks, entries, on), "left").drop(*[b for _, b in on])
    return opened.groupBy(*K, "_chunk").applyInPandas(label, label_schema)
