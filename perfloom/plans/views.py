"""Views that lay the engine's schemas over the benchmark tables.

Each view is one list of SQL expressions, valid in Spark and in the oracle database; ``{us}`` is the only difference.
Measures are whole numbers, so sums and means do not depend on addition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_US = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "oracle": "epoch_us(ts)"}
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_DEV = "event_type IN ('view', 'purchase')"

_EVENT_BASE = [
    "'T' || CAST(user_id % 3 AS STRING) AS trace_id", "event_id AS seq", "{us} AS ts",
    "CAST(round(value * 100) AS BIGINT) * 10000 AS dur", "user_id AS pid", "user_id % 8 AS tid",
]
_SWITCH = [
    f"CASE WHEN event_type = 'click' THEN {_K} END AS prev_pid",
    "CASE WHEN event_type = 'click' THEN user_id END AS next_pid",
    f"CASE WHEN event_type = 'click' THEN CASE {_K} % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'S' ELSE 'D' END END AS prev_state",
    "CASE WHEN event_type = 'signup' THEN user_id END AS wake_pid",
]

# name -> (table, where, expressions)
VIEWS: dict[str, tuple[str, str, list[str]]] = {
    # execution trace with device and host rows
    "tv": ("events", "true", _EVENT_BASE + [
        f"CASE WHEN {_DEV} THEN -1 ELSE user_id % 4 END AS cpu",
        f"CASE WHEN {_DEV} THEN user_id % 2 ELSE -1 END AS device_id",
        f"CASE WHEN {_DEV} THEN {_K} % 2 ELSE -1 END AS stream_id",
        f"""CASE event_type WHEN 'view' THEN 'kernel_' || CAST({_K} % 10 AS STRING)
            WHEN 'purchase' THEN CASE WHEN {_K} % 2 = 0 THEN 'copy_h2d' ELSE 'copy_d2h' END
            WHEN 'click' THEN 'sched_switch' WHEN 'signup' THEN 'sched_wakeup'
            ELSE CASE {_K} % 5 WHEN 0 THEN 'DataLoader.next' WHEN 1 THEN 'stream_sync' WHEN 2 THEN 'read_block'
                 WHEN 3 THEN 'launch_kernel' ELSE 'func_' || CAST({_K} AS STRING) END END AS name""",
        f"""CASE event_type WHEN 'view' THEN 'npu_kernel' WHEN 'purchase' THEN 'npu_memcpy' WHEN 'click' THEN 'cpu_sched'
            WHEN 'signup' THEN 'cpu_sched' ELSE CASE {_K} % 5 WHEN 0 THEN 'data_loader' WHEN 1 THEN 'runtime'
                 WHEN 2 THEN 'io' WHEN 3 THEN 'cuda_npu_api' ELSE 'cpu_function' END END AS cat""",
        "'X' AS ph",
        f"CASE WHEN event_type = 'purchase' THEN {_K} * 1000000 END AS bytes",
        f"CASE WHEN event_type = 'purchase' THEN CASE {_K} % 4 WHEN 0 THEN 'H2D' WHEN 1 THEN 'dtoh' WHEN 2 THEN '1' END END AS direction",
        f"CASE WHEN event_type = 'purchase' AND {_K} % 4 = 3 THEN 'memcpy_D2H' END AS op",
    ] + _SWITCH),
    # kernel line trace
    "lt": ("events", "true", _EVENT_BASE + [
        "user_id % 4 AS cpu",
        f"""CASE event_type WHEN 'click' THEN 'sched_switch'
            WHEN 'signup' THEN CASE WHEN {_K} % 2 = 0 THEN 'sched_wakeup' ELSE 'sched_waking' END
            WHEN 'view' THEN CASE {_K} % 4 WHEN 0 THEN 'numa_local' WHEN 1 THEN 'numa_remote' WHEN 2 THEN 'acl:OpExecute' ELSE 'cpu_idle' END
            WHEN 'purchase' THEN CASE WHEN {_K} % 2 = 0 THEN 'block_rq_issue' ELSE 'block_rq_complete' END
            ELSE CASE {_K} % 5 WHEN 1 THEN 'dataloader_start' WHEN 2 THEN 'dataloader_end' WHEN 4 THEN 'step_' || CAST({_K} AS STRING)
                 ELSE 'mm_page_fault' END END AS name""",
        f"CASE WHEN event_type = 'click' THEN 'cpu_sched' ELSE 'unknown' END AS cat",
        f"CASE WHEN event_type = 'error' THEN CASE {_K} % 5 WHEN 0 THEN 'major' WHEN 3 THEN 'minor' END END AS fault_type",
        f"CASE WHEN event_type = 'view' AND {_K} % 4 = 3 THEN CAST(floor({_K} / 4) AS BIGINT) % 3 END AS state",
        "user_id % 3 AS dev", "user_id % 5 AS sector", f"{_K} + 1 AS sectors",
        f"CASE WHEN {_K} % 3 = 0 THEN 'W' ELSE 'R' END AS rwbs",
    ] + _SWITCH),
    # begin/end marks
    "be": ("events", "true", _EVENT_BASE + [
        "'span' AS name", "CASE WHEN event_type IN ('click', 'signup') THEN 'B' ELSE 'E' END AS ph", "'python' AS cat"]),
    # cluster step timings
    "st": ("lineitem", "true", [
        "CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'R' END AS cluster_id", "l_suppkey % 16 AS rank", "CAST(year(l_shipdate) AS BIGINT) AS step",
        "l_quantity * 1000 AS computing", "round(l_extendedprice) AS communication", "round(l_discount * 100000) AS free",
        "round(l_tax * 10000) AS overlapped",
        "l_quantity * 1000 + round(l_extendedprice) + round(l_discount * 100000) AS stage",
        "l_orderkey AS row_id"]),
    # communication records
    "cm": ("lineitem", "true", [
        "CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'R' END AS cluster_id", "l_suppkey % 8 AS src", "l_partkey % 8 AS dst",
        "CASE WHEN l_suppkey % 8 = l_partkey % 8 THEN 'LOCAL' WHEN l_linestatus = 'F' THEN 'HCCS' ELSE 'RDMA' END AS transport",
        "'hcom_op_' || CAST(l_linenumber AS STRING) AS op_name", "l_quantity AS bandwidth",
        "round(l_extendedprice) AS size", "round(l_extendedprice) AS elapsed", "l_quantity * 10 AS transit",
        "round(l_discount * 100) AS wait", "round(l_tax * 100) AS sync", "round(l_discount * 100) * 10 + l_quantity AS time"]),
    # metric records, one per user
    "ev_k": ("events", "true", ["user_id", "event_id", f"{_K} AS k", "event_type",
                                "CAST(round(value * 100) AS BIGINT) AS v"]),
    # service log lines
    "lg": ("events", "true", [
        "'log' || CAST(user_id % 7 AS STRING) AS log_id", "event_id AS seq",
        f"""CASE event_type WHEN 'view' THEN 'INFO GPU KV cache usage: ' || CAST({_K} AS STRING) || '.5%, Prefix cache hit rate: 3.0%'
            WHEN 'purchase' THEN 'INFO Loading model weights took ' || CAST({_K} % 6 AS STRING) || '.25 GB and 3 s'
            WHEN 'click' THEN 'INFO Accepted: ' || CAST({_K} AS STRING) || ' tokens'
            WHEN 'signup' THEN 'INFO Available KV cache memory: ' || CAST({_K} AS STRING) || '.75 GiB'
            ELSE CASE WHEN user_id % 7 < 3 THEN 'INFO 2 Engines Aggregated: Avg prompt throughput: 10.5 tokens/s, Avg generation throughput: '
                 || CAST({_K} AS STRING) || '.1 tokens/s, Running: 1 reqs, Waiting: 0 reqs, GPU KV cache usage: '
                 || CAST({_K} % 50 AS STRING) || '.0%, Prefix cache hit rate: 7.5%'
                 ELSE 'DEBUG nothing to see ' || CAST(event_id AS STRING) END END AS value"""]),
    # configuration entries of three dumps
    "dp": ("customer", "true", [
        "'n' || CAST(c_nationkey % 3 AS STRING) AS dump_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'system' WHEN 'AUTOMOBILE' THEN 'env' WHEN 'MACHINERY' THEN 'user config' "
        "WHEN 'HOUSEHOLD' THEN 'ping' ELSE '_meta' END || '.k' || CAST(c_custkey % 11 AS STRING) AS path",
        "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 3 AS STRING) END AS value"]),
}


# One metric record per user, whole numbers taken from counts and sums of the events.
_PER_USER = ["count(*) AS n", "CAST(sum(k) AS BIGINT) AS sk", "max(k) AS mx", "min(k) AS mn", "CAST(sum(v) AS BIGINT) AS sv"]


def _num(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


_METRICS = ["'u' || CAST(user_id AS STRING) AS trace_id"] + [_num(e, n) for e, n in (
    ("sk % 101", "cpu_util_avg"), ("sv % 120", "cpu_util_max"), ("100 - sk % 101", "cpu_idle_avg"),
    ("CASE WHEN sk % 5 <> 0 THEN sk % 27 END", "runqueue_avg"), ("sv % 40", "runqueue_max"), ("sv % 9000", "sched_latency_avg_us"),
    ("sv % 17000", "sched_latency_p99_us"), ("sv % 70000", "sched_latency_max_us"), ("(sv * 7) % 90000", "ctx_switch_rate"),
    ("(sk % 11) / 10.0", "cpu_balance_score"), ("sv % 1000", "h2d_bandwidth_mbs"), ("sv % 1100", "d2h_bandwidth_mbs"),
    ("(sv * 13) % 2000000", "memcpy_total_us"), ("sv % 1500", "launch_avg_gap_us"), ("(sv * 3) % 200000", "launch_count"),
    ("4 + sk % 9", "cpu_cores"), ("(sk % 100) / 100.0", "correlation_score"), ("(sk % 60) / 100.0", "attr_CPU_SCHED"),
    ("(sv % 50) / 100.0", "attr_DATA_LOADER"), ("CASE WHEN sk % 3 <> 0 THEN (sv % 45) / 100.0 END", "attr_MEMCPY"),
    ("(sk % 35) / 100.0", "attr_LAUNCH_GAP"), ("(sv % 31) / 100.0", "attr_IO_WAIT"), ("(sk % 29) / 100.0", "attr_RUNTIME_BLOCK"),
    ("(mx % 10) / 100.0", "attr_OTHER"))] + [
    "sk % 2 = 0 AS spike_runqueue", "sv % 2 = 0 AS spike_cpu_util", "sv % 3 = 0 AS spike_launch_gap", "sk % 3 = 0 AS spike_ctx_switch"]
_RECORD = ["'u' || CAST(user_id AS STRING) AS trace_id"] + [_num(e, n) for e, n in (
    ("sk % 101", "cpu_util_avg"), ("sv % 101", "cpu_util_max"), ("(sk % 11) / 10.0", "cpu_balance"), ("sk % 30", "runqueue_avg"),
    ("sk % 60", "runqueue_max"), ("4 + sk % 9", "cpu_count"), ("(sv * 7) % 90000", "context_switch_rate"),
    ("CASE WHEN sk % 7 <> 0 THEN sv % 30 END", "npu_idle_ratio"), ("sv % 90", "npu_idle_max_gap_ms"), ("sv % 45", "npu_idle_avg_gap_ms"),
    ("sv % 12", "npu_idle_gap_count"), ("(sk % 25) / 10.0", "runqueue_pressure"), ("CASE WHEN sk % 4 <> 0 THEN sv % 30 END", "sched_latency_p99_ms"),
    ("sv % 15", "sched_latency_avg_ms"), ("sv % 80", "sched_latency_p99_9_ms"), ("sv % 100", "sched_latency_max_ms"),
    ("(sv * 3) % 2000", "cpu_migration_rate"), ("sk % 55", "remote_ratio"), ("100 - sk % 55", "hit_ratio"), ("sv % 3", "major_page_faults"),
    ("(sv * 11) % 20000", "minor_page_fault_rate"), ("sk % 21", "io_wait_pct"), ("sk % 210", "io_issue_count"), ("(sv * 5) % 15000", "io_issue_rate"),
    ("sv % 20", "thread_block_count"), ("sk % 50", "dataloader_time_pct"), ("(sk % 30) / 10.0", "kernel_launch_gap_avg_ms"),
    ("sv % 14", "kernel_launch_gap_p99_ms"), ("sv % 40", "sync_wait_time"))]
_PER_USER_VIEWS = {"mv": _METRICS, "rec": _RECORD}


def _user_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    per = view(spark, sf_dir, "ev_k").groupBy("user_id").agg(*[F.expr(e) for e in _PER_USER])
    return per.selectExpr(*_PER_USER_VIEWS[name])


def _profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(*_PROFILE)


# Kernel calls of two sides.
_PROFILE = [
    "CASE l_returnflag WHEN 'A' THEN 'A' ELSE 'R' END AS side", "CASE WHEN p_size % 10 = 0 THEN 'hcom_' || p_brand ELSE p_brand END AS kernel",
    "CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size % 5 AS STRING) || ',' || CAST(p_size % 3 AS STRING) || ';' || CAST(p_size % 4 AS STRING) || ',x' END AS shape",
    "round(l_extendedprice) AS duration", "p_type AS kernel_type", "'core' || CAST(l_linenumber % 2 AS STRING) AS core_type",
    "'L' || CAST(l_linenumber % 3 AS STRING) AS level", "l_orderkey AS row_id", "CAST(l_linenumber AS BIGINT) AS line_no"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _PER_USER_VIEWS:
        return _user_view(spark, sf_dir, name)
    if name == "pr":
        return _profile_rows(spark, sf_dir)
    table, where, exprs = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.where(where).selectExpr(*[e.format(us=_US["spark"]) if "{us}" in e else e for e in exprs])


def oracle(names: str, body: str, recursive: bool = False) -> str:
    """Oracle text: the named views as CTEs, then ``body`` (which may start with more CTEs)."""
    ctes = []
    for n in names.split():
        if n in _PER_USER_VIEWS:
            inner = ", ".join(VIEWS["ev_k"][2])
            per = f"SELECT user_id, {', '.join(_PER_USER)} FROM (SELECT {inner} FROM events) GROUP BY user_id"
            ctes.append(f"{n} AS (SELECT {', '.join(_PER_USER_VIEWS[n])} FROM ({per}))")
            continue
        if n == "pr":
            ctes.append(f"pr AS (SELECT {', '.join(_PROFILE)} FROM lineitem JOIN part ON l_partkey = p_partkey)")
            continue
        table, where, exprs = VIEWS[n]
        cols = ", ".join(e.format(us=_US["oracle"]) if "{us}" in e else e for e in exprs)
        ctes.append(f"{n} AS (SELECT {cols} FROM {table} WHERE {where})")
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.strip()
    return head + ", ".join(ctes) + (body if body.startswith(",") else " " + body)
