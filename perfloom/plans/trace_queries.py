"""Trace family: sources' scalar work, sequences, windows, gaps and correlation over the event view."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators import correlate as CO
from perfloom.operators import events as EV
from perfloom.operators import metrics as ME
from perfloom.operators import timeline as TL
from perfloom.operators.sequence import top_k
from perfloom.plans.registry import query, tidy
from perfloom.plans.views import view
from perfloom.shared import shared_dir

HOUR = 3_600_000_000
MIN_GAP, SIGNIFICANT, OFFSET = 60_000_000, 600_000_000, 600_000_000


def tv(s, d):
    return view(s, d, "tv")


def lt(s, d):
    return view(s, d, "lt")


# ------------------------------------------------------------------ projections and filters

@query("event_normalize", "tv", """
SELECT trace_id, seq, coalesce(CASE WHEN seq % 7 <> 0 THEN ts END, 0) AS ts, CASE WHEN seq % 5 = 0 THEN 0 ELSE dur END AS dur,
  CASE WHEN seq % 3 = 0 THEN -1 ELSE pid END AS pid, CASE WHEN seq % 4 = 0 THEN 'unknown' ELSE cat END AS cat,
  CASE WHEN seq % 2 = 0 THEN 'X' ELSE 'B' END AS ph, CAST(-1 AS BIGINT) AS cpu, '{}' AS args FROM tv""")
def event_normalize(s, d):
    raw = tv(s, d).select(
        "trace_id", "seq", F.when(F.col("seq") % 7 != 0, F.col("ts").cast("string")).alias("ts"),
        F.when(F.col("seq") % 5 == 0, F.lit("n/a")).otherwise(F.col("dur").cast("string")).alias("dur"),
        F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("pid")).alias("pid"),
        F.when(F.col("seq") % 4 != 0, F.col("cat")).alias("cat"),
        F.when(F.col("seq") % 2 == 0, F.lit("?")).otherwise("B").alias("ph"))
    return EV.normalize(raw).select("trace_id", "seq", "ts", "dur", "pid", "cat", "ph", "cpu", "args")


@query("args_extract", "ev_k", """
SELECT event_id, CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k + 1 WHEN 2 THEN -1 ELSE -1 END AS device_id,
  CASE k % 3 WHEN 0 THEN k ELSE -1 END AS stream_id FROM ev_k""")
def args_extract(s, d):
    k = F.col("k").cast("string")
    dev = F.when(F.col("k") % 4 == 0, F.concat(F.lit('"device": '), k)).when(
        F.col("k") % 4 == 1, F.concat(F.lit('"device_id": '), (F.col("k") + 1).cast("string"))).when(
        F.col("k") % 4 == 2, F.concat(F.lit('"device": "bad", "device_id": '), k)).otherwise(F.lit('"x": 1'))
    stream = F.when(F.col("k") % 3 == 0, F.concat(F.lit(', "stream_id": '), k)).otherwise(F.lit(""))
    ev = view(s, d, "ev_k").select("event_id", F.lit(-1).cast("long").alias("cpu"),
                                   F.concat(F.lit("{"), dev, stream, F.lit("}")).alias("args"))
    return EV.locate_from_args(ev).select("event_id", "device_id", "stream_id")


@query("device_category", "tv", """
SELECT seq, CASE WHEN name LIKE '%copy%' OR cat LIKE '%memcpy%' THEN 'npu_memcpy' WHEN name LIKE '%sync%' THEN 'stream_sync'
  ELSE 'npu_kernel' END AS device_cat FROM tv""")
def device_category(s, d):
    return tv(s, d).select("seq", X.device_category("cat", "name").alias("device_cat"))


@query("task_pid_split", "", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN event_type || '-w' ELSE event_type || '-w' END AS task,
  CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS pid
FROM (SELECT event_id, event_type, user_id FROM events)""")
def task_pid_split(s, d):
    t = F.when(F.col("user_id") % 3 == 0, F.concat("event_type", F.lit("-w"))).otherwise(
        F.concat("event_type", F.lit("-w-"), F.col("user_id").cast("string")))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", X.task_name(t).alias("task"), X.task_pid(t).alias("pid"))


@query("memcpy_direction", "tv", """
SELECT seq, CASE WHEN direction IN ('H2D', '1') THEN 'H2D' WHEN direction = 'dtoh' OR op = 'memcpy_D2H' THEN 'D2H' ELSE '' END AS dir FROM tv""")
def memcpy_direction(s, d):
    return tv(s, d).select("seq", X.memcpy_direction("direction", "op").alias("dir"))


@query("attribution_class", "tv", """
SELECT seq, CASE WHEN cat = 'cpu_sched' OR contains(lower(name), 'sched') THEN 'CPU_SCHED'
  WHEN cat = 'data_loader' OR contains(lower(name), 'dataloader') THEN 'DATA_LOADER'
  WHEN cat = 'npu_memcpy' OR contains(lower(name), 'copy') THEN 'MEMCPY'
  WHEN cat = 'cuda_npu_api' OR contains(lower(name), 'launch') THEN 'LAUNCH_GAP'
  WHEN cat = 'io' OR regexp_matches(lower(name), 'io|read|write') THEN 'IO_WAIT'
  WHEN cat = 'runtime' OR regexp_matches(lower(name), 'sync|lock|mutex') THEN 'RUNTIME_BLOCK' ELSE 'OTHER' END AS attribution FROM tv""")
def attribution_class(s, d):
    return tv(s, d).select("seq", X.attribution_class("cat", "name").alias("attribution"))


@query("event_filter", "tv", """
SELECT trace_id, seq, ts, dur, name FROM tv WHERE ts >= 1704240000000000 AND ts <= 1705449600000000 AND cat = 'npu_kernel' AND device_id = 1""")
def event_filter(s, d):
    return EV.event_filter(tv(s, d), 1704240000000000, 1705449600000000, "npu_kernel", 1).select("trace_id", "seq", "ts", "dur", "name")


@query("range_filter", "tv", "SELECT trace_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM tv WHERE ts BETWEEN 1704240000000000 AND 1705449600000000 GROUP BY 1")
def range_filter(s, d):
    return EV.event_filter(tv(s, d), 1704240000000000, 1705449600000000).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("keep_types", "lt", """
SELECT trace_id, name, count(*) AS n FROM lt WHERE name IN ('sched_switch','sched_wakeup','sched_waking','numa_local','numa_remote','cpu_idle','block_rq_issue','block_rq_complete')
  OR contains(name, 'acl:OpExecute') GROUP BY ALL""")
def keep_types(s, d):
    ev = lt(s, d)
    return ev.where(EV.keep_types(ev)).groupBy("trace_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query("key_events", "ev_k", """
SELECT event_id, (k > 10 AND event_type = 'click') OR (v > 5000 AND event_type = 'signup') OR (k > 20 AND event_type = 'view') AS reduce_key,
  (k > 10 AND event_type = 'click') OR k % 3 = 2 AS window_key FROM ev_k""")
def key_events(s, d):
    k, t = F.col("k"), F.col("event_type")
    ev = view(s, d, "ev_k").select(
        "event_id", F.when(t == "click", k).alias("latency_ms"), F.when(t == "signup", F.expr("IF(v > 5000, 51, 3)")).alias("runnable"),
        F.when(t == "view", "npu_idle_gap").otherwise("x").alias("type"), k.alias("duration_ms"),
        F.expr("CASE k % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'S' ELSE 'D+' END").alias("prev_state"))
    return ev.select("event_id", EV.key_event().alias("reduce_key"), EV.window_key_event().alias("window_key"))


@query("systematic_sample", "lt", """
, o AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS rn FROM lt WHERE NOT (name LIKE 'sched%'))
SELECT trace_id, seq, name FROM lt WHERE name LIKE 'sched%' UNION ALL SELECT trace_id, seq, name FROM o WHERE rn % 10 = 0""")
def systematic_sample(s, d):
    return EV.reduce_events(lt(s, d), F.col("name").startswith("sched"), sample_every=10).select("trace_id", "seq", "name")


@query("host_events", "tv", "SELECT trace_id, cat, count(*) AS n, CAST(sum(dur) AS BIGINT) AS busy_us FROM tv WHERE device_id < 0 AND cat <> 'metadata' AND dur > 0 GROUP BY ALL")
def host_events(s, d):
    return EV.host_events(tv(s, d), busy=True).groupBy("trace_id", "cat").agg(F.count(F.lit(1)).alias("n"), F.sum("dur").alias("busy_us"))


@query("multi_source_merge", "tv", """
SELECT trace_id, seq, ts, 'kernels' AS source, stream_id AS extra FROM tv WHERE cat = 'npu_kernel'
UNION ALL SELECT trace_id, seq, ts, 'copies' AS source, bytes AS extra FROM tv WHERE device_id >= 0 AND cat <> 'npu_kernel'
UNION ALL SELECT trace_id, seq, ts, 'host' AS source, NULL AS extra FROM tv WHERE device_id < 0""")
def multi_source_merge(s, d):
    ev = tv(s, d)
    return EV.merge_sources(
        kernels=ev.where("cat = 'npu_kernel'").select("trace_id", "seq", "ts", F.col("stream_id").alias("extra")),
        copies=ev.where("device_id >= 0 AND cat <> 'npu_kernel'").select("trace_id", "seq", "ts", F.col("bytes").alias("extra")),
        host=ev.where("device_id < 0").select("trace_id", "seq", "ts"))


@query("be_pairing", "be", """
, r AS (SELECT *, sum(CASE ph WHEN 'B' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, pid, tid, name ORDER BY seq) AS raw FROM be),
m AS (SELECT b.trace_id, b.pid, b.seq AS b_seq, min(e.seq) AS e_seq FROM r b JOIN r e ON e.trace_id = b.trace_id AND e.pid = b.pid AND e.tid = b.tid
      AND e.seq > b.seq AND e.raw < b.raw WHERE b.ph = 'B' GROUP BY 1, 2, 3)
SELECT e.trace_id, e.pid, e.seq, CASE WHEN m.b_seq IS NULL THEN e.ts ELSE b.ts END AS ts,
  CASE WHEN m.b_seq IS NULL THEN e.dur ELSE e.ts - b.ts END AS dur, CASE WHEN m.b_seq IS NULL THEN 'E' ELSE 'X' END AS ph
FROM r e LEFT JOIN m ON m.trace_id = e.trace_id AND m.pid = e.pid AND m.e_seq = e.seq LEFT JOIN r b ON b.seq = m.b_seq WHERE e.ph = 'E'""")
def be_pairing(s, d):
    return EV.pair_begin_end(view(s, d, "be")).select("trace_id", "pid", "seq", "ts", "dur", "ph")


@query("trace_metadata", "tv", """
SELECT trace_id, count(*) AS event_count, min(ts) AS ts_min, max(ts + dur) AS ts_max, max(cpu) + 1 AS cpu_cores,
  string_agg(DISTINCT CAST(device_id AS STRING), ',' ORDER BY CAST(device_id AS STRING)) FILTER (device_id >= 0) AS devices,
  max(ts + dur) - min(ts) AS duration_us FROM tv GROUP BY 1""")
def trace_metadata(s, d):
    return EV.trace_metadata(tv(s, d))


@query("triage_stats", "tv", "SELECT trace_id, name, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM tv GROUP BY ALL")
def triage_stats(s, d):
    return EV.triage_stats(tv(s, d))


@query("distinct_names", "tv", "SELECT DISTINCT trace_id, name FROM tv")
def distinct_names(s, d):
    return EV.distinct_names(tv(s, d))


# ------------------------------------------------------------------ gaps

_DEVICE = "SELECT * FROM tv WHERE device_id >= 0 AND cat IN ('npu_kernel', 'npu_memcpy')"
_GAPS = f"""
, dv AS ({_DEVICE}), nx AS (SELECT trace_id, device_id, stream_id, ts + dur AS gap_start, name AS prev_kernel,
  lead(ts) OVER w AS gap_end, lead(name) OVER w AS next_kernel FROM dv WINDOW w AS (PARTITION BY trace_id, device_id, stream_id ORDER BY ts, seq)),
g AS (SELECT trace_id, device_id, stream_id, gap_start, gap_end, gap_end - gap_start AS gap_dur, prev_kernel, next_kernel FROM nx
  WHERE gap_end - gap_start > 0)"""
_SIG = _GAPS + f", sg AS (SELECT * FROM g WHERE gap_dur >= {SIGNIFICANT})"


@query("gap_scan", "tv", _GAPS + f" SELECT * FROM g WHERE gap_dur >= {MIN_GAP}")
def gap_scan(s, d):
    return TL.gap_scan(tv(s, d), min_gap_us=MIN_GAP)


@query("gap_scan_exact", "tv", f"""
, dv AS ({_DEVICE}), nx AS (SELECT trace_id, device_id, stream_id, max(ts + dur) OVER (w ROWS UNBOUNDED PRECEDING) AS gap_start,
  lead(ts) OVER w AS gap_end FROM dv WINDOW w AS (PARTITION BY trace_id, device_id, stream_id ORDER BY ts, seq))
SELECT trace_id, device_id, stream_id, gap_start, gap_end, gap_end - gap_start AS gap_dur FROM nx WHERE gap_end > gap_start""")
def gap_scan_exact(s, d):
    return TL.gap_scan(tv(s, d), min_gap_us=1, exact=True).drop("prev_kernel", "next_kernel")


@query("gap_stats", "tv", _GAPS + f"""
, a AS (SELECT trace_id, sum(gap_dur) AS gu, count(*) AS n, count(*) FILTER (gap_dur >= {SIGNIFICANT}) AS sn FROM g GROUP BY 1),
k AS (SELECT trace_id, sum(dur) AS ku FROM dv GROUP BY 1)
SELECT trace_id, CAST(gu AS BIGINT) AS total_gap_us, CAST(ku AS BIGINT) AS total_kernel_us, n AS gap_count, sn AS significant_count,
  round(CAST(ku AS DOUBLE) / CAST(ku + gu AS DOUBLE), 6) AS utilization FROM a JOIN k USING (trace_id)""")
def gap_stats(s, d):
    ev = tv(s, d)
    return tidy(TL.gap_stats(ev, TL.gap_scan(ev, min_gap_us=1), significant_us=SIGNIFICANT))


@query("gap_pareto", "tv", _GAPS + """
, c AS (SELECT *, sum(gap_dur) OVER (PARTITION BY trace_id ORDER BY gap_dur DESC, gap_start, device_id, stream_id ROWS UNBOUNDED PRECEDING) AS cum,
  sum(gap_dur) OVER (PARTITION BY trace_id) AS total, row_number() OVER (PARTITION BY trace_id ORDER BY gap_dur DESC, gap_start, device_id, stream_id) AS rank FROM g)
SELECT trace_id, device_id, stream_id, gap_start, gap_dur, CAST(cum AS BIGINT) AS cum, rank FROM c WHERE cum - gap_dur < 0.8 * total""")
def gap_pareto(s, d):
    gaps = TL.gap_scan(tv(s, d), min_gap_us=1)
    return TL.pareto(gaps, ["trace_id"], "gap_dur", ties=["gap_start", "device_id", "stream_id"]).select(
        "trace_id", "device_id", "stream_id", "gap_start", "gap_dur", "cum", "rank")


_EDGES = (("<1m", 0, 60_000_000), ("1-10m", 60_000_000, 600_000_000), ("10-60m", 600_000_000, HOUR), (">1h", HOUR, None))


@query("gap_histogram", "tv", _GAPS + f"""
, e AS (SELECT * FROM (VALUES ('<1m', 0, 60000000), ('1-10m', 60000000, 600000000), ('10-60m', 600000000, {HOUR}), ('>1h', {HOUR}, 9000000000000000000)) t(label, lo, hi)),
t AS (SELECT DISTINCT trace_id FROM g)
SELECT t.trace_id, e.label, count(g.gap_dur) AS count, CAST(coalesce(sum(g.gap_dur), 0) AS BIGINT) AS total_gap_us
FROM t CROSS JOIN e LEFT JOIN g ON g.trace_id = t.trace_id AND g.gap_dur >= e.lo AND g.gap_dur < e.hi GROUP BY ALL""")
def gap_histogram(s, d):
    return TL.gap_histogram(TL.gap_scan(tv(s, d), min_gap_us=1), edges=_EDGES)


@query("npu_idle", "tv", f"""
, dv AS ({_DEVICE}), x AS (SELECT trace_id, ts, dur, ts - lag(ts + dur) OVER w AS gap, ts - lag(ts) OVER w AS step FROM dv WINDOW w AS (PARTITION BY trace_id ORDER BY ts, seq)),
sp AS (SELECT trace_id, max(ts) - min(ts) AS span FROM tv GROUP BY 1),
o AS (SELECT trace_id, list_sort(list(step) FILTER (step IS NOT NULL)) AS l FROM x GROUP BY 1)
SELECT trace_id, round((1 - sum(dur) / greatest(any_value(span), 1)) * 100, 6) AS npu_idle_ratio, count(*) AS npu_op_count,
  count(*) FILTER (gap > {MIN_GAP}) AS npu_idle_gap_count, round(coalesce(max(gap) FILTER (gap > {MIN_GAP}), 0) / 1000, 6) AS npu_idle_max_gap_ms,
  round(avg(gap) FILTER (gap > {MIN_GAP}) / 1000, 6) AS npu_idle_avg_gap_ms, round(avg(step) / 1000, 6) AS kernel_launch_gap_avg_ms,
  round(CASE WHEN len(any_value(l)) > 100 THEN any_value(l)[CAST(floor(len(any_value(l)) * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] ELSE max(step) END / 1000, 6) AS kernel_launch_gap_p99_ms
FROM x JOIN sp USING (trace_id) JOIN o USING (trace_id) GROUP BY 1""")
def npu_idle(s, d):
    return tidy(ME.npu_idle(tv(s, d), threshold_us=MIN_GAP))


# ------------------------------------------------------------------ scheduler

_SW = ", sw AS (SELECT * FROM tv WHERE cat = 'cpu_sched' AND name LIKE '%switch%')"
_SLICES = _SW + """, sl AS (SELECT trace_id, cpu, prev_pid, ts, lag(ts) OVER (PARTITION BY trace_id, cpu ORDER BY ts, seq) AS s0 FROM sw WHERE cpu >= 0),
sc AS (SELECT trace_id, cpu, prev_pid, s0, ts - s0 AS delta FROM sl WHERE s0 IS NOT NULL AND ts > s0)"""
_UTIL = _SLICES + """, u AS (SELECT trace_id, cpu, CAST(coalesce(sum(delta) FILTER (prev_pid <> 0), 0) AS BIGINT) AS running_us,
  CAST(coalesce(sum(delta) FILTER (prev_pid = 0), 0) AS BIGINT) AS idle_us FROM sc GROUP BY 1, 2)"""
_LAT = """
, m AS (SELECT trace_id, coalesce(wake_pid, next_pid) AS p, ts, seq, name FROM tv WHERE cat = 'cpu_sched'),
l0 AS (SELECT *, max(CASE WHEN name = 'sched_wakeup' THEN ts END) OVER w AS lw, max(CASE WHEN name = 'sched_switch' THEN ts END) OVER w AS ls FROM m
  WINDOW w AS (PARTITION BY trace_id, p ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
la AS (SELECT trace_id, p AS pid, lw AS wake_ts, ts AS switch_ts, ts - lw AS latency_us FROM l0 WHERE name = 'sched_switch' AND lw IS NOT NULL AND (ls IS NULL OR lw > ls))"""


@query("event_table_slices", "tv", _SLICES + """
SELECT trace_id, cpu, s0 AS slice_start, delta, prev_pid FROM sc""")
def event_table_slices(s, d):
    """Scheduler slices read from a bucketed table of the events, without a shuffle after it is written."""
    name = f"events_{uuid.uuid4().hex}"
    EV.save_event_table(tv(s, d), name, shared_dir(s), buckets=8, slot_us=24 * 30 * HOUR)
    return TL.cpu_slices(EV.event_table(s, name))


@query("cpu_util", "tv", _UTIL + " SELECT trace_id, cpu, running_us, idle_us, round(CAST(running_us AS DOUBLE) / CAST(running_us + idle_us AS DOUBLE), 6) AS util FROM u")
def cpu_util(s, d):
    return tidy(TL.cpu_util(tv(s, d)))


@query("sched_latency", "tv", _LAT + " SELECT * FROM la")
def sched_latency(s, d):
    return TL.sched_latency(tv(s, d))


@query("thread_latency", "tv", _LAT + " SELECT * FROM la WHERE pid = 7")
def thread_latency(s, d):
    return TL.sched_latency(tv(s, d), pid=7)


@query("sched_latency_stats", "tv", _LAT + """ SELECT trace_id, count(*) AS n, round(avg(latency_us), 4) AS mean, max(latency_us) AS max, round(quantile_cont(latency_us, 0.5), 4) AS p50,
 round(quantile_cont(latency_us, 0.99), 4) AS p99, round(quantile_cont(latency_us, 0.999), 4) AS p99_9 FROM la GROUP BY 1""")
def sched_latency_stats(s, d):
    return tidy(ME.latency_stats(TL.sched_latency(tv(s, d)), ["trace_id"]), 4)


@query("nearest_rank_pct", "tv", _LAT + """, o AS (SELECT trace_id, list_sort(list(latency_us)) AS l FROM la GROUP BY 1)
SELECT trace_id, l[len(l) // 2 + 1] AS p50, CASE WHEN len(l) > 100 THEN l[CAST(floor(len(l) * CAST(0.99 AS DOUBLE)) AS BIGINT) + 1] ELSE l[len(l)] END AS p99,
 CASE WHEN len(l) > 1000 THEN l[CAST(floor(len(l) * CAST(0.999 AS DOUBLE)) AS BIGINT) + 1] ELSE l[len(l)] END AS p99_9 FROM o""")
def nearest_rank_pct(s, d):
    return ME.nearest_rank(TL.sched_latency(tv(s, d)), ["trace_id"], "latency_us")


@query("thread_states", "tv", _SW + """, x AS (SELECT trace_id, cpu, next_pid AS pid, ts AS start_ts, lead(ts) OVER w - ts AS run_us, lead(prev_state) OVER w AS end_state FROM sw WHERE cpu >= 0
 WINDOW w AS (PARTITION BY trace_id, cpu ORDER BY ts, seq)) SELECT * FROM x WHERE run_us IS NOT NULL""")
def thread_states(s, d):
    return TL.thread_states(tv(s, d))


@query("ctx_switch_rate", "tv", """SELECT trace_id, count(*) FILTER (name = 'sched_switch') AS switches, max(ts + dur) - min(ts) AS duration_us,
 round(count(*) FILTER (name = 'sched_switch') * 1e6 / (max(ts + dur) - min(ts)), 9) AS ctx_switch_rate FROM tv GROUP BY 1""")
def ctx_switch_rate(s, d):
    return tidy(ME.ctx_switch_rate(tv(s, d)), 9)


@query("balance_score", "tv", _UTIL + """, v AS (SELECT trace_id, running_us / CAST(running_us + idle_us AS DOUBLE) AS util FROM u)
SELECT trace_id, round(greatest(0, least(1, 1 - stddev_samp(util) / avg(util))), 6) AS balance_score, round(stddev_samp(util) / avg(util), 6) AS cv FROM v GROUP BY 1""")
def balance_score(s, d):
    return tidy(ME.balance_score(TL.cpu_util(tv(s, d)), ["trace_id"], "util"))


@query("copy_bandwidth", "tv", """
, c AS (SELECT trace_id, dur, bytes, CASE WHEN direction IN ('H2D', '1') THEN 'H2D' WHEN direction = 'dtoh' OR op = 'memcpy_D2H' THEN 'D2H' END AS dir FROM tv WHERE cat = 'npu_memcpy')
SELECT trace_id, round(sum(bytes) FILTER (dir = 'H2D') / CAST(sum(dur) FILTER (dir = 'H2D') AS DOUBLE), 6) AS h2d_bandwidth_mbs,
 round(sum(bytes) FILTER (dir = 'D2H') / CAST(sum(dur) FILTER (dir = 'D2H') AS DOUBLE), 6) AS d2h_bandwidth_mbs, CAST(sum(dur) AS BIGINT) AS memcpy_total_us FROM c GROUP BY 1""")
def copy_bandwidth(s, d):
    return tidy(ME.copy_bandwidth(tv(s, d)))


@query("launch_stats", "tv", """
, l AS (SELECT trace_id, ts - lag(ts) OVER (PARTITION BY trace_id ORDER BY ts) AS gap FROM tv WHERE cat = 'cuda_npu_api')
SELECT trace_id, count(*) AS launch_count, round(coalesce(avg(gap), 0), 3) AS launch_avg_gap_us FROM l GROUP BY 1""")
def launch_stats(s, d):
    return tidy(ME.launch_stats(tv(s, d)), 3)


@query("host_scalars", "tv", _UTIL + _LAT + f"""
, v AS (SELECT trace_id, running_us / CAST(running_us + idle_us AS DOUBLE) AS util FROM u), cu AS (SELECT trace_id, avg(util) AS a, max(util) AS m, greatest(0, least(1, 1 - stddev_samp(util) / avg(util))) AS b FROM v GROUP BY 1),
rq AS (SELECT trace_id, avg(n) AS a, max(n) AS m FROM (SELECT trace_id, ts // {HOUR} AS w, count(*) AS n FROM sw WHERE prev_state = 'R' GROUP BY 1, 2) GROUP BY 1),
ls AS (SELECT trace_id, avg(latency_us) AS a, quantile_cont(latency_us, 0.99) AS p, max(latency_us) AS m FROM la GROUP BY 1),
c AS (SELECT trace_id, dur, bytes, CASE WHEN direction IN ('H2D', '1') THEN 'H2D' WHEN direction = 'dtoh' OR op = 'memcpy_D2H' THEN 'D2H' END AS dir FROM tv WHERE cat = 'npu_memcpy'),
cb AS (SELECT trace_id, sum(bytes) FILTER (dir = 'H2D') / CAST(sum(dur) FILTER (dir = 'H2D') AS DOUBLE) AS h, sum(bytes) FILTER (dir = 'D2H') / CAST(sum(dur) FILTER (dir = 'D2H') AS DOUBLE) AS d, CAST(sum(dur) AS BIGINT) AS t FROM c GROUP BY 1),
lc AS (SELECT trace_id, count(*) AS n, avg(g) AS g FROM (SELECT trace_id, ts - lag(ts) OVER (PARTITION BY trace_id ORDER BY ts) AS g FROM tv WHERE cat = 'cuda_npu_api') GROUP BY 1),
md AS (SELECT trace_id, max(ts + dur) - min(ts) AS duration_us, max(cpu) + 1 AS cpu_cores, count(*) FILTER (name = 'sched_switch') AS s FROM tv GROUP BY 1)
SELECT trace_id, duration_us, cpu_cores, round(s * 1e6 / duration_us, 4) AS ctx_switch_rate, lc.n AS launch_count, round(lc.g, 4) AS launch_avg_gap_us, round(h, 4) AS h2d_bandwidth_mbs, round(d, 4) AS d2h_bandwidth_mbs, t AS memcpy_total_us,
 round(cu.a * 100, 4) AS cpu_util_avg, round(cu.m * 100, 4) AS cpu_util_max, round((1 - cu.a) * 100, 4) AS cpu_idle_avg, round(cu.b, 4) AS cpu_balance_score, round(rq.a, 4) AS runqueue_avg, CAST(rq.m AS DOUBLE) AS runqueue_max,
 round(ls.a, 4) AS sched_latency_avg_us, round(ls.p, 4) AS sched_latency_p99_us, CAST(ls.m AS DOUBLE) AS sched_latency_max_us
FROM md JOIN cu USING (trace_id) JOIN rq USING (trace_id) JOIN ls USING (trace_id) JOIN cb USING (trace_id) JOIN lc USING (trace_id)""")
def host_scalars(s, d):
    return tidy(ME.host_scalars(tv(s, d), window_us=HOUR, percent=True), 4)


@query("cpu_migration", "tv", _SW + """, x AS (SELECT trace_id, pid, cpu, lag(cpu) OVER (PARTITION BY trace_id, next_pid ORDER BY ts, seq) AS lc FROM (SELECT * REPLACE ((cpu + seq) % 4 AS cpu) FROM sw))
SELECT trace_id, count(*) FILTER (lc IS NOT NULL AND lc <> cpu) AS migrations FROM x GROUP BY 1""")
def cpu_migration(s, d):
    return TL.cpu_migration(tv(s, d).withColumn("cpu", (F.col("cpu") + F.col("seq")) % 4))


@query("ctx_rate_timeline", "tv", _SW + f" SELECT trace_id, ts // {HOUR} * {HOUR} AS ts, round(count(*) / 3600.0, 9) AS value FROM sw GROUP BY 1, 2")
def ctx_rate_timeline(s, d):
    return tidy(TL.timeline(tv(s, d), "ctx_rate", window_us=HOUR), 9)


@query("rq_timeline", "tv", _SW + f" SELECT trace_id, ts // {HOUR} * {HOUR} AS ts, CAST(count(*) AS DOUBLE) AS value FROM sw WHERE contains(upper(prev_state), 'R') GROUP BY 1, 2")
def rq_timeline(s, d):
    return TL.timeline(tv(s, d), "runqueue", window_us=HOUR)


@query("util_timeline", "tv", _SLICES + f" SELECT trace_id, s0 // {HOUR} * {HOUR} AS ts, round(least(sum(delta) / {HOUR * 4}.0, 1.0), 6) AS value FROM sc WHERE prev_pid <> 0 GROUP BY 1, 2")
def util_timeline(s, d):
    return tidy(TL.timeline(tv(s, d), "cpu_util", window_us=HOUR, cpus=4))


@query("util_by_window", "tv", f"SELECT trace_id, cpu, ts // {HOUR} * {HOUR} AS window_start, round(sum(dur) / {HOUR}.0 * 100, 6) AS util_pct FROM tv WHERE dur > 0 AND cpu >= 0 GROUP BY 1, 2, 3")
def util_by_window(s, d):
    return tidy(TL.util_by_window(tv(s, d), window_us=HOUR))


@query("sliding_util", "tv", f"""
, w AS (SELECT trace_id, cpu, dur, unnest([ts // {HOUR // 2} * {HOUR // 2}, ts // {HOUR // 2} * {HOUR // 2} - {HOUR // 2}]) AS window_start FROM tv WHERE dur > 0 AND cpu >= 0)
SELECT trace_id, cpu, window_start, round(sum(dur) / {HOUR}.0 * 100, 6) AS util_pct FROM w GROUP BY 1, 2, 3""")
def sliding_util(s, d):
    return tidy(TL.sliding_util(tv(s, d), window_us=HOUR, slide_us=HOUR // 2))


@query("hot_functions", "tv", """
, a AS (SELECT trace_id, name, CAST(sum(dur) AS BIGINT) AS total_dur, count(*) AS count, round(avg(dur), 3) AS avg_dur, max(dur) AS max_dur FROM tv WHERE dur > 0 AND cat = 'cpu_function' GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total_dur DESC, name) AS rank FROM a QUALIFY rank <= 20""")
def hot_functions(s, d):
    return tidy(TL.hot_functions(tv(s, d), categories=["cpu_function"]), 3)


@query("step_timeline", "lt", """
SELECT trace_id, row_number() OVER w AS step_no, ts AS step_ts, dur AS step_dur, name, cat, dur - lag(dur) OVER w AS dur_change
FROM lt WHERE contains(name, 'step') WINDOW w AS (PARTITION BY trace_id ORDER BY ts, seq)""")
def step_timeline(s, d):
    return TL.step_timeline(lt(s, d))


@query("spike_detect", "tv", _SW + f"""
, t AS (SELECT trace_id, ts // {HOUR} AS b, count(*) AS value FROM sw GROUP BY 1, 2)
SELECT trace_id, count(*) AS n, round(avg(value), 6) AS mean, CAST(max(value) AS DOUBLE) AS peak, count(*) >= 2 AND max(value) > avg(value) + 2 * stddev_pop(value) AS spike FROM t GROUP BY 1""")
def spike_detect(s, d):
    t = TL.timeline(tv(s, d), "ctx_rate", window_us=HOUR).withColumn("value", F.round(F.col("value") * 3600))
    return tidy(TL.spikes(t, ["trace_id"]))


@query("downsample", "tv", """
, x AS (SELECT trace_id, seq, ts, row_number() OVER (PARTITION BY trace_id ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY trace_id) AS n FROM tv)
SELECT trace_id, seq, ts FROM x WHERE i % CAST(ceil(n / 50.0) AS BIGINT) = 0""")
def downsample(s, d):
    return TL.downsample(tv(s, d).select("trace_id", "seq", "ts"), ["trace_id"], ["ts", "seq"], keep=50)


@query("topk_kernels", "tv", f"""
SELECT trace_id, name, ts, dur, row_number() OVER (PARTITION BY trace_id ORDER BY dur DESC, ts, seq) AS rank FROM ({_DEVICE}) QUALIFY rank <= 20""")
def topk_kernels(s, d):
    k = TL.device_kernels(tv(s, d)).select("trace_id", "name", "ts", "dur", "seq")
    return tidy(top_k(k, ["trace_id"], [F.desc("dur"), F.asc("ts"), F.asc("seq")], 20).drop("seq"))


# ------------------------------------------------------------------ windows over line traces

_SUMMARY = """count(*) FILTER (name = 'sched_switch') AS sched_switch_count,
 count(*) FILTER (name = 'sched_switch' AND prev_state LIKE 'R%') AS runnable_count, count(*) FILTER (name IN ('sched_wakeup', 'sched_waking')) AS wakeup_count,
 count(*) FILTER (name = 'numa_local') AS numa_local, count(*) FILTER (name = 'numa_remote') AS numa_remote,
 count(*) FILTER (name = 'block_rq_issue') AS io_issue_count, count(*) FILTER (name = 'block_rq_complete') AS io_complete_count,
 count(*) FILTER (name = 'acl:OpExecute') AS npu_op_count, CAST(coalesce(sum(dur) FILTER (name = 'acl:OpExecute'), 0) AS BIGINT) AS npu_busy_time"""
_ANCHOR = f"""
, e AS (SELECT trace_id, ts, lead(ts) OVER (PARTITION BY trace_id ORDER BY ts) AS after FROM lt),
c AS (SELECT a.trace_id, a.ts, b.ts AS closes FROM e a ASOF JOIN e b ON a.trace_id = b.trace_id AND a.ts + {HOUR} <= b.ts),
j AS MATERIALIZED (SELECT c.trace_id, c.ts, e.after AS nxt FROM c JOIN e ON c.trace_id = e.trace_id AND c.closes = e.ts),
w AS (SELECT trace_id, min(ts) AS ws FROM lt GROUP BY 1 UNION ALL SELECT w.trace_id, j.nxt FROM w JOIN j ON j.trace_id = w.trace_id AND j.ts = w.ws WHERE j.nxt IS NOT NULL),
wn AS (SELECT trace_id, ws, lead(ws) OVER (PARTITION BY trace_id ORDER BY ws) AS we FROM w),
la AS (SELECT lt.*, wn.ws AS window_start FROM lt JOIN wn ON lt.trace_id = wn.trace_id AND lt.ts >= wn.ws AND (wn.we IS NULL OR lt.ts < wn.we))"""


@query("window_summary", "lt", f"SELECT trace_id, ts // {HOUR} * {HOUR} AS window_start, {_SUMMARY} FROM lt GROUP BY 1, 2")
def window_summary(s, d):
    return TL.window_summary(lt(s, d), window_us=HOUR)


@query("anchored_windows", "lt", _ANCHOR + f" SELECT trace_id, window_start, {_SUMMARY} FROM la GROUP BY 1, 2", recursive=True)
def anchored_windows(s, d):
    return TL.window_summary(lt(s, d), window_us=HOUR, mode="anchored")


@query("window_rollup", "lt", f"""
, w AS (SELECT trace_id, ts // {HOUR} AS b, {_SUMMARY} FROM lt GROUP BY 1, 2)
SELECT trace_id, round(avg(sched_switch_count / 3600.0), 9) AS context_switch_rate, round(least(avg(sched_switch_count / 3600.0) / 4000.0 * 100, 100), 9) AS cpu_util_avg,
 round(avg(runnable_count), 9) AS runqueue_avg, max(runnable_count) AS runqueue_max, round(avg(runnable_count) / 4.0, 9) AS runqueue_pressure FROM w GROUP BY 1""")
def window_rollup(s, d):
    return tidy(ME.window_rollup(TL.window_summary(lt(s, d), window_us=HOUR), window_us=HOUR, cpu_count=4), 9)


@query("core_share", "lt", f"""
, c AS (SELECT trace_id, ts // {HOUR} AS b, cpu, count(*) AS n FROM lt WHERE name = 'sched_switch' GROUP BY 1, 2, 3),
t AS (SELECT trace_id, b, sum(n) AS t FROM c GROUP BY 1, 2)
SELECT trace_id, cpu, round(avg(n / t) * 400, 6) AS core_util FROM c JOIN t USING (trace_id, b) GROUP BY 1, 2""")
def core_share(s, d):
    return tidy(ME.core_share(TL.cpu_distribution(lt(s, d), window_us=HOUR), cpu_count=4))


@query("cpu_distribution", "lt", f"SELECT trace_id, ts // {HOUR} * {HOUR} AS window_start, cpu, count(*) AS switches FROM lt WHERE name = 'sched_switch' GROUP BY 1, 2, 3")
def cpu_distribution(s, d):
    return TL.cpu_distribution(lt(s, d), window_us=HOUR)


@query("numa_ratio", "lt", """
SELECT trace_id, count(*) FILTER (name = 'numa_local') AS local_count, count(*) FILTER (name = 'numa_remote') AS remote_count,
 round(count(*) FILTER (name = 'numa_remote') * 100.0 / count(*) FILTER (name LIKE 'numa%'), 6) AS remote_ratio,
 round(count(*) FILTER (name = 'numa_local') * 100.0 / count(*) FILTER (name LIKE 'numa%'), 6) AS hit_ratio FROM lt GROUP BY 1""")
def numa_ratio(s, d):
    return tidy(ME.numa_ratio(lt(s, d)))


@query("io_pending", "lt", """
, c AS (SELECT trace_id, count(*) FILTER (name = 'block_rq_issue') AS i, count(*) FILTER (name = 'block_rq_complete') AS c, (max(ts) - min(ts)) / 1e6 AS s FROM lt GROUP BY 1)
SELECT trace_id, i AS io_issue_count, c AS io_complete_count, round(least((i - c) / i * 100, 100), 6) AS io_wait_pct, round(i / s, 9) AS io_issue_rate FROM c""")
def io_pending(s, d):
    out = ME.io_pending(lt(s, d))
    return tidy(out.withColumn("io_wait_pct", F.round("io_wait_pct", 6)), 9)


@query("disk_bw", "lt", """
, c AS (SELECT trace_id, CAST(coalesce(sum(sectors * 512) FILTER (name = 'block_rq_complete' AND rwbs <> 'W'), 0) AS BIGINT) AS r,
 CAST(coalesce(sum(sectors * 512) FILTER (name = 'block_rq_complete' AND rwbs = 'W'), 0) AS BIGINT) AS w, (max(ts) - min(ts)) / 1e6 AS s FROM lt GROUP BY 1)
SELECT trace_id, r AS read_bytes, w AS write_bytes, round(r / s / 1048576, 12) AS read_bw_mbs, round(w / s / 1048576, 12) AS write_bw_mbs FROM c""")
def disk_bw(s, d):
    return tidy(ME.disk_bandwidth(lt(s, d)), 12)


@query("io_latency", "lt", """
, m AS (SELECT * FROM lt WHERE name LIKE 'block_rq%'),
x AS (SELECT *, max(CASE WHEN name = 'block_rq_issue' THEN ts END) OVER w AS li, max(CASE WHEN name = 'block_rq_complete' THEN ts END) OVER w AS lc FROM m
 WINDOW w AS (PARTITION BY trace_id, dev, sector ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trace_id, dev, sector, li AS issue_ts, ts - li AS latency_us FROM x WHERE name = 'block_rq_complete' AND li IS NOT NULL AND (lc IS NULL OR li > lc)""")
def io_latency(s, d):
    return ME.io_latency(lt(s, d))


@query("fault_counts", "lt", """
SELECT trace_id, count(*) FILTER (fault_type = 'major') AS major_page_faults, count(*) FILTER (fault_type = 'minor') AS minor_page_faults,
 count(*) FILTER (name = 'sched_switch' AND prev_state LIKE 'D%') AS thread_block_count, round(count(*) FILTER (fault_type = 'minor') / ((max(ts) - min(ts)) / 1e6), 9) AS minor_page_fault_rate FROM lt GROUP BY 1""")
def fault_counts(s, d):
    return tidy(ME.fault_counts(lt(s, d)), 9)


@query("cpu_util_idle", "lt", """
, sp AS (SELECT trace_id, max(ts) - min(ts) AS span FROM lt GROUP BY 1),
x AS (SELECT *, max(CASE WHEN state > 0 THEN ts END) OVER w AS li, max(CASE WHEN state = 0 THEN ts END) OVER w AS lx FROM lt WHERE state IS NOT NULL
 WINDOW w AS (PARTITION BY trace_id, cpu ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT trace_id, cpu, CAST(sum(ts - li) AS BIGINT) AS idle_us FROM x WHERE state = 0 AND li IS NOT NULL AND (lx IS NULL OR li > lx) GROUP BY 1, 2)
SELECT trace_id, cpu, idle_us, round((1 - CAST(idle_us AS DOUBLE) / span) * 100, 6) AS util_pct FROM i JOIN sp USING (trace_id)""")
def cpu_util_idle(s, d):
    return tidy(ME.cpu_util_idle(lt(s, d)))


@query("cpu_util_bucket", "tv", _SW + f"""
SELECT trace_id, count(DISTINCT (cpu, ts // {HOUR})) AS busy_cells, count(DISTINCT cpu) AS cpus,
 round(count(DISTINCT (cpu, ts // {HOUR})) / ((max(ts) - min(ts)) / CAST({HOUR} AS DOUBLE) * count(DISTINCT cpu)) * 100, 6) AS util_pct FROM sw GROUP BY 1""")
def cpu_util_bucket(s, d):
    return tidy(ME.cpu_util_bucket(tv(s, d), bucket_us=HOUR))


@query("loader_share", "lt", """
, sp AS (SELECT trace_id, max(ts) - min(ts) AS span FROM lt GROUP BY 1),
x AS (SELECT *, max(CASE WHEN name = 'dataloader_start' THEN ts END) OVER w AS li, max(CASE WHEN name = 'dataloader_end' THEN ts END) OVER w AS lx FROM lt WHERE name LIKE 'dataloader%'
 WINDOW w AS (PARTITION BY trace_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT trace_id, CAST(sum(ts - li) AS BIGINT) AS us FROM x WHERE name = 'dataloader_end' AND li IS NOT NULL AND (lx IS NULL OR li > lx) GROUP BY 1)
SELECT trace_id, coalesce(us, 0) AS loader_us, round(coalesce(us, 0) / CAST(span AS DOUBLE) * 100, 6) AS dataloader_time_pct FROM sp LEFT JOIN i USING (trace_id)""")
def loader_share(s, d):
    return tidy(ME.loader_share(lt(s, d)))


@query("ffill_melt", "", """
WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS brand, p_size % 2 AS f_even, p_size % 3 AS f_three, p_partkey % 5 AS grp FROM part),
f AS (SELECT *, last_value(brand IGNORE NULLS) OVER (PARTITION BY grp ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS filled FROM b)
SELECT p_partkey, filled AS brand, 'f_even' AS feature, CAST(f_even AS BIGINT) AS flag FROM f UNION ALL SELECT p_partkey, filled, 'f_three', CAST(f_three AS BIGINT) FROM f""")
def ffill_melt(s, d):
    p = s.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS brand", "CAST(p_size % 2 AS BIGINT) AS f_even",
        "CAST(p_size % 3 AS BIGINT) AS f_three", "p_partkey % 5 AS grp")
    return TL.ffill(p, ["grp"], ["p_partkey"], ["brand"]).unpivot(["p_partkey", "brand"], ["f_even", "f_three"], "feature", "flag")


# ------------------------------------------------------------------ correlation

_HOST = ", ho AS (SELECT seq AS host_seq, trace_id, name AS host_name, cat AS host_cat, ts AS host_ts, dur AS host_dur FROM tv WHERE device_id < 0 AND cat <> 'metadata')"


def _join_sql(extra: str) -> str:
    return _SIG + _HOST + f"""
, pr AS (SELECT sg.*, ho.* EXCLUDE (trace_id), row_number() OVER (PARTITION BY sg.trace_id, sg.device_id, sg.stream_id, sg.gap_start ORDER BY host_dur DESC, host_ts, host_seq) AS rank
  FROM sg JOIN ho ON ho.trace_id = sg.trace_id AND ho.host_ts <= sg.gap_end AND ho.host_ts + ho.host_dur >= sg.gap_start {extra}),
jn AS (SELECT sg.*, pr.host_seq, pr.host_name, pr.host_cat, pr.host_ts, pr.host_dur, pr.rank FROM sg LEFT JOIN pr ON pr.rank <= 5 AND pr.trace_id = sg.trace_id AND pr.device_id = sg.device_id
  AND pr.stream_id = sg.stream_id AND pr.gap_start = sg.gap_start)"""


_JOIN = _join_sql(f"AND ho.host_ts >= greatest(0, sg.gap_start - {OFFSET})")
_ATTR = _JOIN + """
, att AS (SELECT trace_id, device_id, stream_id, gap_start, gap_end, gap_dur, CASE WHEN host_seq IS NULL THEN 'OTHER' WHEN host_cat = 'cpu_sched' THEN 'CPU_SCHED' WHEN host_cat = 'data_loader' THEN 'DATA_LOADER'
  WHEN host_cat = 'cuda_npu_api' THEN 'LAUNCH_GAP' WHEN host_cat = 'io' THEN 'IO_WAIT' WHEN host_cat = 'runtime' THEN 'RUNTIME_BLOCK' ELSE 'OTHER' END AS attribution,
  CASE WHEN host_seq IS NULL THEN 0 ELSE least(host_dur / CAST(gap_dur AS DOUBLE), 1.0) END AS confidence FROM jn WHERE rank = 1 OR rank IS NULL)"""


def sig_gaps(ev):
    return TL.gap_scan(ev, min_gap_us=SIGNIFICANT)


@query("gap_host_join", "tv", _JOIN + " SELECT trace_id, device_id, stream_id, gap_start, gap_end, host_seq, host_name, host_cat, host_ts, host_dur, rank FROM jn")
def gap_host_join(s, d):
    ev = tv(s, d)
    return CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=OFFSET).select(
        "trace_id", "device_id", "stream_id", "gap_start", "gap_end", *CO.HOST_COLS, F.col("rank").cast("long").alias("rank"))


@query("gap_host_join_full", "tv", _join_sql("") + " SELECT trace_id, device_id, stream_id, gap_start, gap_end, host_seq, host_dur, rank FROM jn")
def gap_host_join_full(s, d):
    ev = tv(s, d)
    return CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=None, bucket_us=OFFSET).select(
        "trace_id", "device_id", "stream_id", "gap_start", "gap_end", "host_seq", "host_dur", F.col("rank").cast("long").alias("rank"))


@query("gap_attribution", "tv", _ATTR + " SELECT trace_id, device_id, stream_id, gap_start, gap_end, gap_dur, attribution, round(confidence, 6) AS confidence FROM att")
def gap_attribution(s, d):
    ev = tv(s, d)
    return tidy(CO.attribute_gaps(CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=OFFSET)))


@query("attribution_share", "tv", _ATTR + """
SELECT trace_id, attribution, CAST(sum(gap_dur) AS BIGINT) AS gap_us, round(CAST(sum(gap_dur) AS DOUBLE) / sum(sum(gap_dur)) OVER (PARTITION BY trace_id), 6) AS ratio FROM att GROUP BY 1, 2""")
def attribution_share(s, d):
    ev = tv(s, d)
    return tidy(CO.attribution_share(CO.attribute_gaps(CO.gap_host_join(sig_gaps(ev), ev, max_offset_us=OFFSET))))


@query("critical_path", "tv", _JOIN + """
, r AS (SELECT *, dense_rank() OVER (PARTITION BY trace_id ORDER BY gap_dur DESC, gap_start, device_id, stream_id) AS gap_rank FROM jn)
SELECT trace_id, gap_rank, gap_start, gap_dur, prev_kernel, next_kernel, string_agg(host_name || ':' || CAST(host_dur AS STRING), ',' ORDER BY rank) AS hosts FROM r WHERE gap_rank <= 5 GROUP BY ALL""")
def critical_path(s, d):
    ev = tv(s, d)
    out = CO.critical_path(sig_gaps(ev), ev, n=5, max_offset_us=OFFSET)
    hosts = F.transform("host_events", lambda h: F.concat(h["host_name"], F.lit(":"), h["host_dur"].cast("string")))
    return out.select("trace_id", F.col("gap_rank").cast("long").alias("gap_rank"), "gap_start", "gap_dur", "prev_kernel", "next_kernel",
                      F.nullif(F.array_join(hosts, ","), F.lit("")).alias("hosts"))


@query("host_device_corr", "tv", _GAPS + f"""
, b AS (SELECT trace_id, min(ts) AS t0, greatest((max(ts + dur) - min(ts)) // {HOUR}, 1) AS n FROM tv GROUP BY 1),
wd AS (SELECT trace_id, t0, unnest(range(n)) AS w, n FROM b),
h AS (SELECT tv.trace_id, (ts - t0) // {HOUR} AS w, sum(dur) AS x FROM tv JOIN b USING (trace_id) WHERE device_id < 0 AND dur > 0 AND cat <> 'metadata' GROUP BY 1, 2),
dd AS (SELECT g.trace_id, (gap_start - t0) // {HOUR} AS w, sum(gap_dur) AS y FROM g JOIN b USING (trace_id) GROUP BY 1, 2),
p AS (SELECT wd.trace_id, wd.n, least(coalesce(x, 0) / CAST({HOUR} AS DOUBLE), 1.0) AS x, least(coalesce(y, 0) / CAST({HOUR} AS DOUBLE), 1.0) AS y FROM wd LEFT JOIN h USING (trace_id, w) LEFT JOIN dd USING (trace_id, w))
SELECT trace_id, any_value(n) AS n_windows, round(greatest(corr(x, y), 0), 6) AS score FROM p GROUP BY 1""")
def host_device_corr(s, d):
    ev = tv(s, d)
    return tidy(CO.host_device_corr(TL.gap_scan(ev, min_gap_us=1), ev, window_us=HOUR, flat=float("nan")))  # as corr() of the SQL


_LOOK = _SIG + """
, sg2 AS (SELECT trace_id, ts AS hts, name, prev_state, dur FROM tv WHERE device_id < 0),
lk AS (SELECT sg.trace_id, sg.device_id, sg.stream_id, sg.gap_start, sg.gap_dur,
  coalesce(bool_or(prev_state = 'R' AND hts >= gap_start - 300000000), false) AND coalesce(bool_or(name = 'sched_wakeup' AND dur > 100000000 AND hts >= gap_start - 300000000), false) AS a,
  coalesce(bool_or(name = 'read_block' AND hts >= gap_start - 600000000), false) AND coalesce(bool_or(prev_state = 'D' AND hts >= gap_start - 600000000), false) AS b,
  coalesce(bool_or(name = 'stream_sync' AND hts >= gap_start - 1200000000), false) AS c,
  max(CASE WHEN prev_state IN ('R', 'D') OR (name = 'sched_wakeup' AND dur > 100000000) OR name IN ('read_block', 'stream_sync') THEN hts END) AS closest_ts
  FROM sg LEFT JOIN sg2 ON sg2.trace_id = sg.trace_id AND hts >= gap_start - 1200000000 AND hts < gap_start GROUP BY ALL),
pt AS (SELECT trace_id, device_id, stream_id, gap_start, gap_dur, closest_ts, CASE WHEN a THEN 'CPU_SCHED_CONTENTION' WHEN b THEN 'IO_BLOCK' WHEN c THEN 'MEMORY_PRESSURE' WHEN gap_dur > 1200000000 THEN 'KERNEL_LAUNCH_GAP' END AS pattern,
  CAST(CASE WHEN a THEN 0.85 WHEN b THEN 0.78 WHEN c THEN 0.72 WHEN gap_dur > 1200000000 THEN 0.6 END AS DOUBLE) AS confidence FROM lk)"""


def _looked(s, d):
    ev = tv(s, d)
    sig = ev.where("device_id < 0").select(
        "trace_id", "ts", F.coalesce(F.col("prev_state") == "R", F.lit(False)).alias("queue_high"),
        ((F.col("name") == "sched_wakeup") & (F.col("dur") > 100_000_000)).alias("sched_delay"),
        (F.col("name") == "read_block").alias("io_pending"), F.coalesce(F.col("prev_state") == "D", F.lit(False)).alias("d_state"),
        (F.col("name") == "stream_sync").alias("major_fault"))
    look = {"CPU_SCHED_CONTENTION": 300_000_000, "IO_BLOCK": 600_000_000, "MEMORY_PRESSURE": 1_200_000_000}
    return CO.gap_lookback(sig_gaps(ev), sig, lookback_us=look, launch_gap_us=1_200_000_000)


@query("gap_lookback", "tv", _LOOK + " SELECT trace_id, device_id, stream_id, gap_start, closest_ts, pattern, CAST(confidence AS DOUBLE) AS confidence FROM pt")
def gap_lookback(s, d):
    return tidy(_looked(s, d).select("trace_id", "device_id", "stream_id", "gap_start", "closest_ts", "pattern", "confidence"))


@query("gap_patterns", "tv", _LOOK + """
, fq AS (SELECT *, count(*) OVER (PARTITION BY trace_id, pattern) / count(*) OVER (PARTITION BY trace_id) AS f FROM pt)
SELECT trace_id, device_id, stream_id, gap_start, pattern, round(least(confidence + CASE WHEN gap_start - closest_ts < 60000000 THEN 0.05 WHEN gap_start - closest_ts > 300000000 THEN -0.1 ELSE 0 END
  + CASE WHEN f > 0.8 THEN 0.1 ELSE 0 END, 1.0), 6) AS adjusted FROM fq WHERE pattern IS NOT NULL""")
def gap_patterns(s, d):
    return tidy(CO.gap_patterns(_looked(s, d), near_us=60_000_000, far_us=300_000_000).select(
        "trace_id", "device_id", "stream_id", "gap_start", "pattern", "adjusted"))


@query("primary_pattern", "tv", _LOOK + """
, c AS (SELECT trace_id, pattern, count(*) AS n FROM pt WHERE pattern IS NOT NULL GROUP BY 1, 2)
SELECT trace_id, first(pattern ORDER BY n DESC, pattern DESC) AS primary_pattern, CAST(sum(n) AS BIGINT) AS correlated_gaps FROM c GROUP BY 1""")
def primary_pattern(s, d):
    return CO.primary_pattern(_looked(s, d))
