"""Event-level operators: defaults, filters, begin/end pairing, merging, reduction and trace metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.sequence import KeyedSequence
from perfloom.schema import ARGS_FIELDS, EVENT_SCHEMA, PHASES

K = ("trace_id",)

# Event types kept by the early filter, and device-runtime name tokens.
KEEP_TYPES = (
    "sched_switch", "sched_wakeup", "sched_waking", "sched_wakeup_new", "sched_process_exit", "sched_process_fork",
    "cpu_frequency", "cpu_idle", "numa_hit", "numa_miss", "numa_local", "numa_remote", "numa_hint_faults",
    "numa_hint_faults_local", "block_rq_issue", "block_rq_complete", "irq_handler_entry", "irq_handler_exit",
    "softirq_entry", "softirq_exit",
)
DEVICE_TOKENS = (
    "acl:OpExecute", "acl:streamSync", "acl:memcpyH2D", "acl:memcpyD2H", "ge:LaunchOp", "ge:CompileOp",
    "aclmdlExecute", "aclmdlExecuteAsync", "aclrtSynchronizeStream", "aclrtMemcpy", "aclrtMemAlloc",
)
STEP_WORDS = ("step", "iteration", "iter", "epoch")


def normalize(df: DataFrame) -> DataFrame:
    """Typed event columns with the model's defaults; values that cannot be cast fall back to the default."""
    defaults = {"ts": 0, "dur": 0, "pid": -1, "tid": -1, "cpu": -1, "device_id": -1, "stream_id": -1,
                "name": "", "cat": "unknown", "ph": "X", "args": "{}"}
    out = {}
    for field in EVENT_SCHEMA.fields:
        have = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in ("trace_id", "seq"):
            out[field.name] = have.cast(field.dataType)
        elif field.dataType.simpleString() == "bigint":
            number = have.try_cast("bigint") if field.name not in ("ts", "dur") else F.coalesce(
                have.try_cast("bigint"), have.try_cast("double").cast("bigint"))
            out[field.name] = F.coalesce(number, F.lit(defaults[field.name]).cast("bigint"))
        else:
            out[field.name] = F.coalesce(have.cast("string"), F.lit(defaults[field.name]))
    out["ph"] = F.when(out["ph"].isin(*PHASES), out["ph"]).otherwise("X")
    return df.select(*[c.alias(n) for n, c in out.items()])


def locate_from_args(ev: DataFrame) -> DataFrame:
    """Fill device, stream and cpu from ``args``."""
    cpu = F.get_json_object("args", "$.cpu").try_cast("double").cast("long")
    return ev.withColumns({
        "device_id": X.json_id("args", "device", "device_id"),
        "stream_id": X.json_id("args", "stream", "stream_id"),
        "cpu": F.coalesce(cpu, F.col("cpu")),
    })


def typed_args(ev: DataFrame) -> DataFrame:
    """Known fields of ``args`` as columns, parsed once; columns already present, and events without ``args``, stay."""
    wanted = {"prev_pid": "prev_pid", "next_pid": "next_pid", "prev_state": "prev_state", "wake_pid": "pid",
              "bytes": None, "direction": None, "op": "op", "fault_type": "fault_type", "dev": "dev", "rwbs": "rwbs",
              "sector": "sector", "sectors": "sectors"}
    if "args" not in ev.columns or all(c in ev.columns for c in wanted):
        return ev
    a = ev.withColumn("_a", F.from_json("args", ARGS_FIELDS))
    fields = {n: F.col(f"_a.{f}") for n, f in wanted.items() if f}
    fields["bytes"] = F.coalesce("_a.bytes", "_a.size_bytes")
    fields["direction"] = F.coalesce("_a.direction", "_a.kind")
    return a.withColumns({n: c for n, c in fields.items() if n not in ev.columns}).drop("_a")


def event_filter(ev: DataFrame, ts_start: int | None = None, ts_end: int | None = None, cat: str | None = None,
                 device_id: int | None = None, name: str | None = None) -> DataFrame:
    """Inclusive time bounds and equality on the rest; every predicate reaches the scan."""
    tests = {"ts >= {}": ts_start, "ts <= {}": ts_end}
    for text, v in tests.items():
        if v is not None:
            ev = ev.where(text.format(int(v)))
    for col, v in {"cat": cat, "device_id": device_id, "name": name}.items():
        if v is not None:
            ev = ev.where(F.col(col) == v)
    return ev


def is_host() -> Column:
    return (F.col("device_id") < 0) & (F.col("cat") != "metadata")


def host_events(ev: DataFrame, busy: bool = False) -> DataFrame:
    ev = ev.where(is_host())
    return ev.where("dur > 0") if busy else ev


def step_markers(ev: DataFrame) -> DataFrame:
    return ev.where(X.any_contains(F.lower("name"), STEP_WORDS) & (F.col("cat") != "metadata"))


def merge_sources(**sources: DataFrame) -> DataFrame:
    """Union of event sources tagged with ``source``; order is a property of the consumer, not of the union."""
    out = None
    for tag, df in sources.items():
        df = df.withColumn("source", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def pair_begin_end(ev: DataFrame, K: Sequence[str] = K, by: Sequence[str] = ("pid", "tid", "name"),
                   order: Sequence[str] = ("seq",), flush: bool = False, split_rows: int | None = None) -> DataFrame:
    """Nested B/E events to complete X events.

    The nesting level comes from a running sum of +1/-1 lifted above its running minimum, so an E without an open B is
    seen as such; the event before an E on its level is its B.  Unmatched E rows stay, B rows go (or, with ``flush``,
    unmatched ones become zero-length X events), M rows go, everything else passes.
    """
    cols = ev.columns
    rest = ev.where(~F.col("ph").isin("B", "E", "M"))
    seq = KeyedSequence(ev.where(F.col("ph").isin("B", "E")), [*K, *by], order, split_rows)
    step = F.when(F.col("ph") == "B", 1).otherwise(-1).cast("long")
    seq.scan({"_raw": ("sum", step), "_low": ("low", step)})
    depth = F.col("_raw") - F.least(F.lit(0).cast("long"), "_low")
    seq.derive(_level=F.when(F.col("ph") == "B", depth).otherwise(depth + 1))
    seq.shift({"_p_ph": "ph", "_p_ts": "ts"}, by=-1, within=["_level"])
    if flush:
        seq.shift({"_n_ph": "ph"}, by=1, within=["_level"])
    paired = (F.col("ph") == "E") & F.coalesce(F.col("_p_ph") == "B", F.lit(False))
    df = seq.result()
    ends = df.where("ph = 'E'").withColumns({
        "ts": F.when(paired, F.col("_p_ts")).otherwise(F.col("ts")),
        "dur": F.when(paired, F.greatest(F.lit(0).cast("long"), F.col("ts") - F.col("_p_ts"))).otherwise(F.col("dur")),
        "ph": F.when(paired, "X").otherwise("E"),
    }).select(*cols)
    out = rest.unionByName(ends)
    if flush:
        left = df.where((F.col("ph") == "B") & (F.coalesce("_n_ph", F.lit("B")) != "E"))
        out = out.unionByName(left.withColumns(
            {"ph": F.lit("X"), "dur": F.lit(0).cast("long"), "cat": F.lit("unknown")}).select(*cols))
    return out


def keep_types(ev: DataFrame, types: Sequence[str] = KEEP_TYPES, tokens: Sequence[str] = DEVICE_TOKENS,
               type_col: str = "name") -> Column:
    c = F.col(type_col)
    return c.isin(*types) | X.any_contains(c, tokens)


def key_event(latency_ms: float = 10, runnable: int = 50, idle_gap_ms: float = 20) -> Column:
    """Reduction rule: late wakeups, crowded run queues, long device gaps.  Absent values never match."""
    no = F.lit(False)
    return (
        F.coalesce(F.col("latency_ms") > latency_ms, no)
        | F.coalesce(F.col("runnable") > runnable, no)
        | F.coalesce((F.col("type") == "npu_idle_gap") & (F.col("duration_ms") > idle_gap_ms), no)
    )


def window_key_event(latency_ms: float = 10) -> Column:
    no = F.lit(False)
    return F.coalesce(F.col("latency_ms") > latency_ms, no) | F.coalesce(F.col("prev_state").startswith("D"), no)


def reduce_events(ev: DataFrame, keep: Column, sample_every: int | None = None, K: Sequence[str] = K,
                  order: Sequence[str] = ("seq",), split_rows: int | None = None) -> DataFrame:
    """Kept rows plus every ``sample_every``-th of the others, counted in order per trace."""
    ev = ev.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    kept = ev.where("_keep").drop("_keep")
    if not sample_every:
        return kept
    others = KeyedSequence(ev.where("NOT _keep").drop("_keep"), K, order, split_rows).rank("_n").result()
    return kept.unionByName(others.where(F.col("_n") % sample_every == 0).drop("_n"))


def trace_metadata(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """One row per trace from one pass of partial aggregates."""
    devices = F.when(F.col("device_id") >= 0, F.col("device_id"))
    base = ev.groupBy(*K).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("ts_min"),
        F.max(F.greatest(F.col("ts"), F.col("ts") + F.col("dur"))).alias("ts_max"),
        (F.max("cpu") + 1).alias("cpu_cores"),
        F.array_join(F.transform(F.array_sort(F.collect_set(devices)), lambda d: d.cast("string")), ",").alias("devices"),
    )
    return base.withColumn("duration_us", F.col("ts_max") - F.col("ts_min"))


def trace_names(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Process and thread names as tidy rows (kind, id, name): metadata events first, else scheduler names."""
    meta = ev.where((F.col("ph") == "M") & F.col("name").isin("process_name", "thread_name")).select(
        *K,
        F.when(F.col("name") == "process_name", "process").otherwise("thread").alias("kind"),
        F.when(F.col("name") == "process_name", F.col("pid")).otherwise(F.col("tid")).alias("id"),
        F.get_json_object("args", "$.name").alias("label"), F.lit(1).alias("_p"), "seq",
    )
    sched = ev.where(F.col("cat") == "cpu_sched").select(*K, "seq", F.explode(F.array(
        F.struct(F.get_json_object("args", "$.prev_pid").alias("id"), F.get_json_object("args", "$.prev_comm").alias("l")),
        F.struct(F.get_json_object("args", "$.next_pid").alias("id"), F.get_json_object("args", "$.next_comm").alias("l")),
        F.struct(F.get_json_object("args", "$.pid").alias("id"), F.get_json_object("args", "$.comm").alias("l")),
    )).alias("x")).where("x.id is not null and x.l is not null").select(
        *K, F.explode(F.array(F.lit("process"), F.lit("thread"))).alias("kind"),
        F.col("x.id").cast("long").alias("id"), F.col("x.l").alias("label"), F.lit(0).alias("_p"), "seq",
    )
    return meta.unionByName(sched).groupBy(*K, "kind", "id").agg(
        F.max_by("label", F.struct("_p", "seq")).alias("name"))


def triage_stats(ev: DataFrame, K: Sequence[str] = K, head: int | None = None) -> DataFrame:
    """First look at each trace: histogram of its event types, or of those of its first ``head`` lines only."""
    if head:
        ev = KeyedSequence(ev, K, ["seq"]).rank("_n").result().where(F.col("_n") <= head)
    return ev.groupBy(*K, "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def distinct_names(ev: DataFrame, K: Sequence[str] = K) -> DataFrame:
    return ev.select(*K, "name").distinct()


def write_events(ev: DataFrame, path: str, partition_by: Sequence[str] = ("trace_id",), mode: str = "append") -> None:
    """Parquet, zstd, sorted inside files so that min/max statistics prune time ranges."""
    (ev.repartitionByRange(*partition_by, "ts").sortWithinPartitions(*partition_by, "ts", "seq")
       .write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(path))


def save_event_table(ev: DataFrame, table: str, path: str, keys: Sequence[str] = ("trace_id", "cpu"), buckets: int = 64, slot_us: int = 3_600_000_000,
                     mode: str = "overwrite") -> None:
    """Events as a catalog table at ``path`` that ordered operators over ``keys`` read without a shuffle.

    Rows are hashed to ``buckets`` on ``keys`` and sorted by time inside; a folder per ``slot`` of time lets a time range leave files
    out before any is opened. Choose buckets so that one fits a task. A key with most of the rows fills one bucket: leave such
    traces to ``write_events``, whose readers cut hot keys.
    """
    slot = F.floor(F.col("ts") / F.lit(int(slot_us)).cast("long"))
    spread = ev.withColumn("slot", slot).repartition(buckets, *keys)
    (spread.sortWithinPartitions("slot", *keys, "ts", "seq").write.mode(mode).option("path", path).option("compression", "zstd")
     .partitionBy("slot").bucketBy(buckets, *keys).sortBy(*keys, "ts", "seq").saveAsTable(table))
    ev.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('slot_us' = '{int(slot_us)}')")


def event_table(spark: SparkSession, table: str, ts_start: int | None = None, ts_end: int | None = None) -> DataFrame:
    """The events of a table of ``save_event_table``, of an inclusive range of time: only files of its slots are read."""
    width = int({r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}["slot_us"])
    rows = event_filter(spark.table(table), ts_start, ts_end)
    for test, bound in ((">=", ts_start), ("<=", ts_end)):
        if bound is not None:
            rows = rows.where(f"slot {test} {bound // width}")
    return rows.drop("slot")
