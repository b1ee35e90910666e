"""Cluster, profile-comparison, configuration and log families."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators import cluster as CL
from perfloom.operators import compare as CP
from perfloom.operators import configdiff as CF
from perfloom.operators import logs as LG
from perfloom.operators import lookup as LK
from perfloom.plans.registry import query, tidy
from perfloom.plans.views import view
from perfloom.sources import cluster as SC
from perfloom.sources.events import step_events
from perfloom.sources.files import NODE_DOMAINS, log_domains


def st(s, d):
    return view(s, d, "st")


def cm(s, d):
    return view(s, d, "cm")


def table(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


# ------------------------------------------------------------------ cluster

_MEANS = """round(avg(computing), 6) AS avg_compute, round(avg(communication), 6) AS avg_comm, round(avg(free), 6) AS avg_free, round(avg(stage), 6) AS avg_stage, round(avg(overlapped), 6) AS avg_overlap"""
_SS = """, ss AS (SELECT cluster_id, step, avg(computing) AS c, avg(communication) AS m, avg(free) AS f, avg(stage) AS g, avg(overlapped) AS o FROM st GROUP BY 1, 2),
cr AS (SELECT cluster_id, avg(c) AS avg_compute, avg(m) AS avg_comm, avg(f) AS avg_free, avg(g) AS avg_stage, avg(o) AS avg_overlap FROM ss GROUP BY 1),
rk AS (SELECT cluster_id, rank, avg(stage) AS avg_stage FROM st GROUP BY 1, 2)"""


@query("step_summary", "st", f"SELECT cluster_id, step, {_MEANS} FROM st GROUP BY 1, 2")
def step_summary(s, d):
    return tidy(CL.step_summary(st(s, d)))


@query("rank_summary", "st", f"SELECT cluster_id, rank, {_MEANS} FROM st GROUP BY 1, 2")
def rank_summary(s, d):
    return tidy(CL.rank_summary(st(s, d)))


@query("step_rank_sets", "st", f"SELECT cluster_id, step, rank, {_MEANS} FROM st GROUP BY GROUPING SETS ((cluster_id, step), (cluster_id, rank))")
def step_rank_sets(s, d):
    return tidy(CL.step_and_rank_summary(st(s, d)))


@query("cluster_ratios", "st", _SS + """
SELECT cluster_id, round(avg_compute, 4) AS avg_compute, round(avg_comm, 4) AS avg_comm, round(avg_free, 4) AS avg_free, round(avg_stage, 4) AS avg_stage, round(avg_overlap, 4) AS avg_overlap,
 round(avg_compute / avg_stage * 100, 4) AS compute_ratio, round(avg_comm / avg_stage * 100, 4) AS comm_ratio, round(avg_free / avg_stage * 100, 4) AS free_ratio FROM cr""")
def cluster_ratios(s, d):
    return tidy(CL.cluster_ratios(st(s, d)), 4)


@query("rank_step_heatmap", "st", _SS + """
, g AS (SELECT r.cluster_id, r.rank, t.step FROM (SELECT DISTINCT cluster_id, rank FROM st) r JOIN (SELECT DISTINCT cluster_id, step FROM st) t USING (cluster_id)),
v AS (SELECT cluster_id, rank, step, max(stage) AS value FROM st GROUP BY 1, 2, 3)
SELECT g.cluster_id, g.rank, g.step, coalesce(v.value, 0) AS value, CASE WHEN coalesce(v.value, 0) / avg_stage > 1.1 THEN 'high' WHEN coalesce(v.value, 0) / avg_stage < 0.9 THEN 'low' ELSE 'mid' END AS level
FROM g LEFT JOIN v USING (cluster_id, rank, step) JOIN cr ON cr.cluster_id = g.cluster_id""")
def rank_step_heatmap(s, d):
    return tidy(CL.rank_step_heatmap(st(s, d)))


@query("slow_rank", "st", _SS + """
SELECT cluster_id, rank, round(rk.avg_stage, 4) AS avg_stage, round((rk.avg_stage - cr.avg_stage) / cr.avg_stage * 100, 4) AS deviation_pct,
 CASE WHEN (rk.avg_stage - cr.avg_stage) / cr.avg_stage * 100 > 10 THEN 'slow' WHEN (rk.avg_stage - cr.avg_stage) / cr.avg_stage * 100 < -10 THEN 'fast' ELSE 'normal' END AS flag FROM rk JOIN cr USING (cluster_id)""")
def slow_rank(s, d):
    return tidy(CL.slow_ranks(st(s, d)), 4)


@query("cluster_advice", "st", _SS + """
, dv AS (SELECT cluster_id, max(abs((rk.avg_stage - cr.avg_stage) / cr.avg_stage * 100)) AS dev, count(*) AS n FROM rk JOIN cr USING (cluster_id) GROUP BY 1)
SELECT cluster_id, CASE WHEN a = '' THEN 'healthy' ELSE a END AS advice FROM (SELECT cluster_id, concat_ws(',', CASE WHEN avg_comm / avg_stage > 0.5 THEN 'communication_bound' END, CASE WHEN avg_free / avg_stage > 0.2 THEN 'idle_time' END,
 CASE WHEN n > 1 AND dev > 10 THEN 'slow_rank' END, CASE WHEN avg_compute / avg_stage > 0.7 THEN 'compute_bound' END) AS a FROM cr JOIN dv USING (cluster_id))""")
def cluster_advice(s, d):
    return CL.cluster_advice(st(s, d)).withColumn("advice", F.array_join("advice", ","))


@query("ab_contribution", "st", _SS + """
, u AS (SELECT 'stage' AS metric, a.avg_stage AS a, b.avg_stage AS b, b.avg_stage - a.avg_stage AS ds, a.avg_stage AS sa FROM cr a, cr b WHERE a.cluster_id = 'A' AND b.cluster_id = 'R'
 UNION ALL SELECT 'compute', a.avg_compute, b.avg_compute, b.avg_stage - a.avg_stage, a.avg_stage FROM cr a, cr b WHERE a.cluster_id = 'A' AND b.cluster_id = 'R'
 UNION ALL SELECT 'comm', a.avg_comm, b.avg_comm, b.avg_stage - a.avg_stage, a.avg_stage FROM cr a, cr b WHERE a.cluster_id = 'A' AND b.cluster_id = 'R'
 UNION ALL SELECT 'free', a.avg_free, b.avg_free, b.avg_stage - a.avg_stage, a.avg_stage FROM cr a, cr b WHERE a.cluster_id = 'A' AND b.cluster_id = 'R')
SELECT metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS delta, round((b - a) / ds * 100, 4) AS contribution_pct,
 CASE WHEN ds / sa * 100 > 10 THEN 'severe' WHEN ds / sa * 100 > 5 THEN 'moderate' WHEN ds > 0 THEN 'slight' ELSE 'improved' END AS grade FROM u""")
def ab_contribution(s, d):
    return tidy(CL.ab_contribution(st(s, d), "A", "R"), 4)


def _diff_sql(key):
    return f"""
, x AS (SELECT {key}, avg(stage) AS a FROM st WHERE cluster_id = 'A' GROUP BY 1), y AS (SELECT {key}, avg(stage) AS b FROM st WHERE cluster_id = 'R' GROUP BY 1),
j AS (SELECT coalesce(x.{key}, y.{key}) AS {key}, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM x FULL JOIN y ON x.{key} = y.{key})
SELECT {key}, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS diff, round(CASE WHEN a = 0 THEN 0 ELSE (b - a) / a * 100 END, 4) AS pct, CASE WHEN b > a THEN 'slower' WHEN b < a THEN 'faster' ELSE 'same' END AS trend FROM j"""


@query("rank_diff", "st", _diff_sql("rank"))
def rank_diff(s, d):
    return tidy(CL.rank_diff(st(s, d), "A", "R"), 4)


@query("step_diff", "st", _diff_sql("step"))
def step_diff(s, d):
    return tidy(CL.rank_diff(st(s, d), "A", "R", key="step"), 4)


@query("numeric_sort", "st", """
, i AS (SELECT DISTINCT cluster_id, CASE WHEN rank = 3 THEN 'head' ELSE CAST(rank AS STRING) END AS rank_text FROM st)
SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(TRY_CAST(rank_text AS BIGINT), 999), rank_text) AS position FROM i""")
def numeric_sort(s, d):
    ids = st(s, d).withColumn("rank_text", F.when(F.col("rank") == 3, "head").otherwise(F.col("rank").cast("string")))
    return CL.numeric_sort(ids, "rank_text")


@query("rank_host_count", "st", "SELECT cluster_id, count(DISTINCT rank) AS rank_count, count(DISTINCT step) AS host_count FROM st GROUP BY 1")
def rank_host_count(s, d):
    return CL.rank_host_count(st(s, d).withColumnRenamed("step", "host"))


@query("rank_set_fallback", "st", """
, gr AS (SELECT DISTINCT 'A' AS cluster_id, unnest([s_suppkey % 20, CAST(s_nationkey AS BIGINT)]) AS rank FROM supplier)
SELECT cluster_id, rank, 'groups' AS origin FROM gr UNION ALL SELECT DISTINCT cluster_id, rank, 'steps' FROM st WHERE cluster_id <> 'A'""")
def rank_set_fallback(s, d):
    groups = table(s, d, "supplier").select(F.lit("A").alias("cluster_id"), F.array(F.col("s_suppkey") % 20, F.col("s_nationkey").cast("long")).alias("ranks"))
    return CL.rank_set(groups, st(s, d))


@query("comm_op_top", "cm", """
SELECT cluster_id, op_name, round(avg(elapsed), 4) AS avg_elapsed, round(avg(transit), 4) AS avg_transit, round(avg(wait), 4) AS avg_wait, round(avg(sync), 4) AS avg_sync,
 row_number() OVER (PARTITION BY cluster_id ORDER BY avg(elapsed) DESC, op_name) AS rank FROM cm GROUP BY 1, 2 QUALIFY rank <= 5""")
def comm_op_top(s, d):
    return tidy(CL.comm_op_top(cm(s, d), top_n=5), 4)


@query("comm_op_diff", "cm", """
, j AS (SELECT op_name, coalesce(avg(elapsed) FILTER (cluster_id = 'A'), 0) AS a, coalesce(avg(elapsed) FILTER (cluster_id = 'R') / 1000, 0) AS b FROM cm WHERE cluster_id IN ('A', 'R') GROUP BY 1)
SELECT op_name, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS diff FROM j ORDER BY abs(b - a) DESC, op_name LIMIT 5""")
def comm_op_diff(s, d):
    return tidy(CL.comm_op_diff(cm(s, d), "A", "R", top_n=5, scale_b=0.001), 4)


@query("transport_bw", "cm", "SELECT cluster_id, transport, round(avg(bandwidth), 4) AS avg_bandwidth, round(avg(size), 4) AS avg_size, round(avg(time), 4) AS avg_time FROM cm GROUP BY 1, 2")
def transport_bw(s, d):
    return tidy(CL.transport_bw(cm(s, d)), 4)


@query("comm_matrix", "cm", "SELECT cluster_id, src, dst, transport, round(avg(bandwidth), 4) AS avg_bandwidth, round(avg(size), 4) AS avg_size FROM cm GROUP BY ALL")
def comm_matrix(s, d):
    return tidy(CL.comm_matrix(cm(s, d)), 4)


@query("comm_matrix_top", "cm", """
SELECT * FROM (SELECT cluster_id, src, dst, transport, op_name, bandwidth, size FROM cm ORDER BY bandwidth DESC, src, dst, transport, op_name, cluster_id, size LIMIT 50)""")
def comm_matrix_top(s, d):
    return CL.comm_matrix_top(cm(s, d), ties=["cluster_id", "size"]).select("cluster_id", "src", "dst", "transport", "op_name", "bandwidth", "size")


@query("transport_locality", "cm", """
SELECT cluster_id, CASE WHEN transport = 'RDMA' THEN 'inter_node' ELSE 'intra_node' END AS locality, round(avg(bandwidth), 4) AS avg_bandwidth, round(avg(time), 4) AS avg_time,
 arg_max(op_name, (time, op_name)) AS slowest_op FROM cm GROUP BY 1, 2""")
def transport_locality(s, d):
    return tidy(CL.transport_locality(cm(s, d)), 4)


@query("bandwidth_drop", "cm", """
, b AS (SELECT cluster_id, transport, avg(bandwidth) AS bw FROM cm GROUP BY 1, 2)
SELECT a.transport, round(a.bw, 4) AS a, round(r.bw, 4) AS b, round((r.bw - a.bw) / a.bw * 100, 4) AS change_pct, (r.bw - a.bw) / a.bw * 100 < -10 AS dropped FROM b a JOIN b r USING (transport) WHERE a.cluster_id = 'A' AND r.cluster_id = 'R'""")
def bandwidth_drop(s, d):
    bw = CL.transport_bw(cm(s, d))
    return tidy(CL.bandwidth_drop(bw.where("cluster_id = 'A'"), bw.where("cluster_id = 'R'")), 4)


@query("comm_time_explode", "", """
SELECT l_orderkey AS doc_id, 'op' || CAST(l_linenumber AS STRING) AS op_name, count(*) AS n, sum(l_quantity + round(l_discount * 100) + round(l_tax * 100)) AS elapsed
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) WHERE l_linenumber <> 4 GROUP BY 1, 2""")
def comm_time_explode(s, d):
    # one nested document per order: group -> step -> operation@group -> times; operation 4 is a total row
    one = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(
        F.struct("l_quantity", "l_discount", "l_tax"), F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("x"))
    op = F.concat(F.when(F.col("l_linenumber") == 4, "Total Op").otherwise(F.concat(F.lit("op"), F.col("l_linenumber").cast("string"))), F.lit("@g1"))
    info = F.struct(F.lit(0).alias("rank_id"), F.struct(
        F.round(F.col("x.l_discount") * 100).alias("wait_time_ms"), F.col("x.l_quantity").alias("transit_time_ms"),
        F.round(F.col("x.l_tax") * 100).alias("synchronization_time_ms")).alias("communication_time_info"))
    ops = one.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(op, info))).alias("ops"))
    docs = ops.select(F.col("l_orderkey").alias("doc_id"), F.create_map(F.lit("(0,1)"), F.create_map(F.lit("1"), F.col("ops"))).alias("doc"))
    return SC.comm_time_rows(docs, ["doc_id"]).groupBy("doc_id", "op_name").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed").alias("elapsed"))


@query("comm_matrix_explode", "", """
SELECT p_partkey AS doc_id, 'allreduce' AS op_name, CAST(p_size % 4 AS BIGINT) AS src, CAST(p_size % 7 AS BIGINT) AS dst, CASE WHEN p_size % 2 = 0 THEN 'HCCS' ELSE 'UNKNOWN' END AS transport, round(p_retailprice) AS bandwidth
FROM part WHERE p_size % 3 <> 0""")
def comm_matrix_explode(s, d):
    pair = F.when(F.col("p_size") % 3 == 0, F.lit("all-0")).otherwise(F.concat((F.col("p_size") % 4).cast("string"), F.lit("-"), (F.col("p_size") % 7).cast("string")))
    link = F.struct(F.when(F.col("p_size") % 2 == 0, "HCCS").alias("Transport Type"), F.lit(1.0).alias("Transit Time(ms)"), F.lit(2.0).alias("Transit Size(MB)"),
                    F.lit("x").alias("Op Name"), F.round("p_retailprice").alias("Bandwidth(GB/s)"))
    doc = F.create_map(F.lit("(0)"), F.create_map(F.lit("step5"), F.create_map(F.lit("allreduce@77"), F.create_map(pair, link))))
    docs = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), doc.alias("doc"))
    return SC.comm_matrix_rows(docs, ["doc_id"]).select("doc_id", "op_name", "src", "dst", "transport", "bandwidth")


@query("step_phase_explode", "", """
WITH o AS (SELECT o_custkey % 10 AS trace_id, o_orderkey AS seq, o_orderkey * 100 AS t0, o_orderkey * 100 + CAST(round(o_totalprice) AS BIGINT) % 90 - 10 AS t1, o_orderkey % 3 AS m FROM orders)
SELECT trace_id, seq, 'Step#' || CAST(seq AS STRING) AS name, t0 AS ts, greatest(0, t1 - t0) AS dur, 'X' AS ph FROM o
UNION ALL SELECT trace_id, seq, 'Forward', t0 + 1, 0, 'I' FROM o WHERE m <> 0 UNION ALL SELECT trace_id, seq, 'Backward', t0 + 2, 0, 'I' FROM o WHERE m <> 1 UNION ALL SELECT trace_id, seq, 'Optimizer', t0 + 3, 0, 'I' FROM o WHERE m <> 2""")
def step_phase_explode(s, d):
    o = table(s, d, "orders").selectExpr(
        "o_custkey % 10 AS trace_id", "o_orderkey AS seq", "o_orderkey AS step_id", "o_orderkey * 100 AS start_time",
        "o_orderkey * 100 + CAST(round(o_totalprice) AS BIGINT) % 90 - 10 AS end_time", "IF(o_orderkey % 3 <> 0, o_orderkey * 100 + 1, NULL) AS forward_start",
        "IF(o_orderkey % 3 <> 1, o_orderkey * 100 + 2, NULL) AS backward_start", "IF(o_orderkey % 3 <> 2, o_orderkey * 100 + 3, NULL) AS optimizer_start")
    return step_events(o).select("trace_id", "seq", "name", "ts", "dur", "ph")


# ------------------------------------------------------------------ profile tables

def pr(s, d):
    return view(s, d, "pr")


@query("kernel_type_stats", "pr", "SELECT side, coalesce(CASE WHEN kernel_type <> 'SMALL' THEN kernel_type END, 'N/A') AS kernel_type, sum(duration) AS total_dur, count(*) AS count, round(avg(duration), 4) AS avg_dur FROM pr GROUP BY 1, 2")
def kernel_type_stats(s, d):
    p = pr(s, d).withColumn("kernel_type", F.when(F.col("kernel_type") != "SMALL", F.col("kernel_type")))
    return tidy(CL.kernel_type_stats(p, ["side"]), 4)


@query("comm_ops", "pr", "SELECT side, kernel, sum(duration) AS total_dur, count(*) AS count FROM pr WHERE starts_with(kernel, 'hcom_') OR line_no = 3 GROUP BY 1, 2")
def comm_ops(s, d):
    return CL.comm_ops(pr(s, d).withColumn("cat", F.when(F.col("line_no") == 3, "communication").otherwise("compute")), ["side"], "kernel")


@query("copy_engine_totals", "pr", "SELECT side, count(*) AS count, sum(duration) AS total_dur FROM pr WHERE line_no = 5 GROUP BY 1")
def copy_engine_totals(s, d):
    return CL.copy_engine_totals(pr(s, d).withColumn("name", F.when(F.col("line_no") == 5, "SDMA").otherwise(F.col("kernel"))), ["side"])


@query("api_by_level", "pr", """
SELECT side, level, kernel AS api_name, sum(duration) AS total_time, CAST(sum(line_no) AS BIGINT) AS calls, row_number() OVER (PARTITION BY side, level ORDER BY sum(duration) DESC, kernel) AS rank FROM pr GROUP BY 1, 2, 3 QUALIFY rank <= 20""")
def api_by_level(s, d):
    api = pr(s, d).select("side", "level", F.col("kernel").alias("api_name"), F.col("duration").alias("time"), F.col("line_no").alias("count"))
    return tidy(CL.api_by_level(api, ["side"]))


@query("task_join_topk", "", """
SELECT o_orderstatus AS cluster_id, o_orderkey AS task_id, l_partkey AS start_ns, CAST(l_partkey + round(l_extendedprice) AS BIGINT) AS end_ns, o_orderpriority AS op_type, CAST(round(l_extendedprice) AS BIGINT) AS duration,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY round(l_extendedprice) DESC, o_orderkey, l_partkey) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY rank <= 20""")
def task_join_topk(s, d):
    tasks = table(s, d, "lineitem").selectExpr("l_orderkey AS task_id", "l_partkey AS start_ns", "CAST(l_partkey + round(l_extendedprice) AS BIGINT) AS end_ns")
    comp = table(s, d, "orders").selectExpr("o_orderkey AS task_id", "o_orderstatus AS cluster_id", "o_orderpriority AS op_type")
    return tidy(CL.task_join_topk(tasks, comp, "task_id").select("cluster_id", "task_id", "start_ns", "end_ns", "op_type", "duration", "rank"))


@query("source_fill", "", """
SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS key, 'db' AS origin, round(c_acctbal) AS value FROM customer UNION ALL SELECT o_custkey, 'csv', sum(round(o_totalprice)) FROM orders
WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END FROM customer) GROUP BY 1""")
def source_fill(s, d):
    db = table(s, d, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS key", "'db' AS origin", "round(c_acctbal) AS value")
    csv = table(s, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.lit("csv").alias("origin"), F.sum(F.round("o_totalprice")).alias("value"))
    return CL.source_fill(db, csv, ["key"])


# ------------------------------------------------------------------ comparison

_KC = """
, b AS (SELECT kernel, shape, sum(duration) AS t, avg(duration) AS a, max(duration) AS mx, min(duration) AS mn, count(*) AS n FROM pr WHERE side = 'A' GROUP BY 1, 2),
c AS (SELECT kernel, shape, sum(duration) AS t, avg(duration) AS a, max(duration) AS mx, min(duration) AS mn, count(*) AS n FROM pr WHERE side <> 'A' GROUP BY 1, 2),
kc AS (SELECT coalesce(b.kernel, c.kernel) AS kernel, coalesce(b.shape, c.shape) AS shape, coalesce(b.t, 0) AS base_total, coalesce(c.t, 0) AS comp_total, coalesce(b.a, 0) AS base_avg, coalesce(c.a, 0) AS comp_avg,
 coalesce(c.mx, 0) AS comp_max, coalesce(c.mn, 0) AS comp_min, coalesce(b.n, 0) AS base_calls, coalesce(c.n, 0) AS comp_calls, coalesce(c.t, 0) - coalesce(b.t, 0) AS diff_total,
 CASE WHEN coalesce(b.a, 0) = 0 AND coalesce(c.a, 0) = 0 THEN 1.0 WHEN coalesce(b.a, 0) = 0 THEN CAST('inf' AS DOUBLE) ELSE coalesce(c.a, 0) / b.a END AS ratio_avg,
 CASE WHEN coalesce(b.t, 0) = 0 AND coalesce(c.t, 0) = 0 THEN 1.0 WHEN coalesce(b.t, 0) = 0 THEN CAST('inf' AS DOUBLE) ELSE coalesce(c.t, 0) / b.t END AS ratio_total
 FROM b FULL JOIN c ON b.kernel = c.kernel AND b.shape = c.shape)"""


def kc(s, d):
    return CP.compare_rows(pr(s, d), F.col("side") == "A", ["kernel", "shape"])


@query("compare_full_outer", "pr", _KC + " SELECT kernel, shape, base_total, comp_total, diff_total, round(ratio_total, 6) AS ratio_total, base_calls, comp_calls FROM kc")
def compare_full_outer(s, d):
    return tidy(kc(s, d).select("kernel", "shape", "base_total", "comp_total", "diff_total", "ratio_total", "base_calls", "comp_calls"))


@query("diff_ratio", "pr", _KC + " SELECT kernel, shape, round(diff_total, 2) AS diff, round(ratio_avg, 4) AS ratio FROM kc")
def diff_ratio(s, d):
    k = kc(s, d)
    return k.select("kernel", "shape", F.round("diff_total", 2).alias("diff"), F.round(X.ratio("base_avg", "comp_avg"), 4).alias("ratio"))


_BAND = "CASE WHEN {r} = CAST('inf' AS DOUBLE) THEN 'new' WHEN {r} < 0.1 THEN 'extreme_improvement' WHEN {r} < 0.9 THEN 'improved' WHEN {r} < 1 THEN 'slightly_improved' WHEN {r} = 1 THEN 'unchanged' WHEN {r} <= 1.05 THEN 'slightly_degraded' WHEN {r} <= 1.1 THEN 'degraded' ELSE 'severely_degraded' END"


@query("ratio_band", "pr", _KC + f" SELECT {_BAND.format(r='ratio_total')} AS band, count(*) AS n FROM kc GROUP BY 1")
def ratio_band(s, d):
    return kc(s, d).groupBy(X.ratio_band("ratio_total").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("compare_totals", "pr", _KC + """
, t AS (SELECT sum(diff_total) AS top FROM (SELECT diff_total FROM kc ORDER BY diff_total DESC LIMIT 10))
SELECT count(*) AS total_rows, count(*) FILTER (diff_total > 0) AS degraded_count, count(*) FILTER (diff_total < 0) AS improved_count, sum(greatest(diff_total, 0)) AS total_degraded, sum(greatest(-diff_total, 0)) AS total_improved, sum(diff_total) AS total_diff,
 CASE WHEN sum(diff_total) > 0 THEN 'degraded' WHEN sum(diff_total) < 0 THEN 'improved' ELSE 'flat' END AS net_trend, round(abs(any_value(top)) / abs(sum(diff_total)) * 100, 4) AS concentration, abs(any_value(top)) / abs(sum(diff_total)) * 100 > 80 AS is_concentrated FROM kc, t""")
def compare_totals(s, d):
    return tidy(CP.stat_totals(kc(s, d)), 4)


@query("detail_semi", "pr", _KC + """
, nm AS (SELECT kernel FROM kc GROUP BY 1 ORDER BY sum(diff_total) DESC, kernel LIMIT 10), dt AS (SELECT row_id, line_no, CASE WHEN side = 'A' THEN kernel END AS base_name, CASE WHEN side <> 'A' THEN kernel END AS comp_name FROM pr)
SELECT * FROM dt WHERE base_name IN (SELECT kernel FROM nm) OR comp_name IN (SELECT kernel FROM nm)""")
def detail_semi(s, d):
    names = kc(s, d).groupBy("kernel").agg(F.sum("diff_total").alias("_d")).orderBy(F.desc("_d"), "kernel").limit(10).select(F.col("kernel").alias("name"))
    detail = pr(s, d).select("row_id", "line_no", F.when(F.col("side") == "A", F.col("kernel")).alias("base_name"),
                             F.when(F.col("side") != "A", F.col("kernel")).alias("comp_name"))
    return CP.detail_for(detail, names)


@query("topk_signed", "pr", _KC + """
, g AS (SELECT *, CASE WHEN diff_total < 0 THEN 'improved' WHEN diff_total > 0 THEN 'degraded' END AS side FROM kc)
SELECT kernel, shape, side, diff_total, row_number() OVER (PARTITION BY side ORDER BY abs(diff_total) DESC, kernel || shape) AS rank FROM g WHERE side IS NOT NULL QUALIFY rank <= 5""")
def topk_signed(s, d):
    rows = kc(s, d).withColumn("tie", F.concat("kernel", "shape"))
    return tidy(CP.topk_signed(rows, "diff_total", "tie").select("kernel", "shape", "side", "diff_total", "rank"))


@query("degradation_type", "pr", _KC + """
SELECT kernel, shape, CASE WHEN base_calls <> comp_calls AND ratio_avg > 1.05 THEN 'duration_and_calls' WHEN base_calls <> comp_calls THEN 'calls' WHEN ratio_avg > 1.05 THEN 'single_duration' ELSE 'slight' END AS degradation_type,
 base_total > 0 AND comp_total > 0 AND diff_total > 0 AND ratio_total > 1.05 AS significant, starts_with(kernel, 'hcom_') AS is_comm FROM kc""")
def degradation_type(s, d):
    return CP.kernel_compare(kc(s, d)).select("kernel", "shape", "degradation_type", "significant", "is_comm")


@query("load_imbalance", "pr", _KC + """
SELECT kernel, shape, round(comp_max / comp_min, 4) AS variance_ratio, CASE WHEN comp_max / comp_min > 5 THEN 'severe' WHEN comp_max / comp_min > 3 THEN 'significant' ELSE 'slight' END AS imbalance FROM kc
WHERE comp_calls > 10 AND comp_min > 0 AND comp_max / comp_min > 2""")
def load_imbalance(s, d):
    return tidy(CP.load_imbalance(kc(s, d)).select("kernel", "shape", "variance_ratio", "imbalance"), 4)


@query("multi_shape", "pr", _KC + " SELECT kernel, count(*) AS shapes FROM kc GROUP BY 1 HAVING count(*) > 1")
def multi_shape(s, d):
    return CP.multi_shape(kc(s, d))


_ELEMS = "list_sum(list_transform(string_split(shape, ';'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+(,[0-9]+)*') THEN list_product(list_transform(string_split(p, ','), lambda x: CAST(x AS BIGINT))) ELSE 0 END))"
_MAXEL = _ELEMS.replace("list_sum(", "list_max(", 1)


@query("shape_elements", "pr", f"SELECT DISTINCT shape, CAST({_ELEMS} AS BIGINT) AS total, CAST({_MAXEL} AS BIGINT) AS largest FROM pr")
def shape_elements(s, d):
    return pr(s, d).select("shape").distinct().select("shape", X.shape_elements("shape").alias("total"), X.shape_elements("shape", largest=True).alias("largest"))


@query("data_volume", "pr", _KC + f"""
SELECT CAST(sum({_ELEMS} * base_calls) AS BIGINT) AS base_elements, CAST(sum({_ELEMS} * comp_calls) AS BIGINT) AS comp_elements, CAST(sum(base_calls) AS BIGINT) AS base_calls, CAST(sum(comp_calls) AS BIGINT) AS comp_calls,
 sum(base_total) AS base_total, sum(comp_total) AS comp_total FROM kc WHERE NOT starts_with(kernel, 'hcom_') AND shape <> ''""")
def data_volume(s, d):
    return CP.data_volume(CP.kernel_compare(kc(s, d)))


@query("level_distribution", "pr", "SELECT level, count(*) AS n, sum(CASE WHEN side = 'A' THEN -duration ELSE duration END) AS sum_diff FROM pr GROUP BY 1")
def level_distribution(s, d):
    return CP.level_distribution(pr(s, d).withColumn("x", F.when(F.col("side") == "A", -F.col("duration")).otherwise(F.col("duration"))), "level", "x")


@query("kernel_type_compare", "pr", """
, k AS (SELECT kernel_type, core_type, coalesce(sum(duration) FILTER (side = 'A'), 0) AS base_total, coalesce(sum(duration) FILTER (side = 'R'), 0) AS comp_total FROM pr GROUP BY 1, 2)
SELECT *, comp_total - base_total AS diff_total FROM k ORDER BY abs(comp_total - base_total) DESC, kernel_type, core_type LIMIT 10""")
def kernel_type_compare(s, d):
    z = F.lit(0.0)
    rows = pr(s, d).select("kernel_type", "core_type", F.when(F.col("side") == "A", F.col("duration")).otherwise(z).alias("base_total"),
                           F.when(F.col("side") == "R", F.col("duration")).otherwise(z).alias("comp_total"))
    return CP.kernel_type_compare(rows)


@query("memory_compare", "pr", _KC + """
, m AS (SELECT kernel LIKE '%7' AS g, CASE WHEN kernel LIKE '%7' THEN 0 ELSE base_total END AS bm, CASE WHEN kernel LIKE '%7' THEN 0 ELSE comp_total END AS cmem, diff_total AS dm FROM kc)
SELECT g, bool_and(bm = 0 AND cmem = 0) AS all_zero, count(*) AS operators, CASE WHEN bool_and(bm = 0 AND cmem = 0) THEN 0 ELSE count(*) FILTER (dm > 0) END AS increased,
 CASE WHEN bool_and(bm = 0 AND cmem = 0) THEN 0 ELSE count(*) FILTER (dm < 0) END AS decreased, CASE WHEN bool_and(bm = 0 AND cmem = 0) THEN 0 ELSE sum(dm) END AS total_diff FROM m GROUP BY 1""")
def memory_compare(s, d):
    g = F.col("kernel").like("%7")
    rows = kc(s, d).select(g.alias("g"), F.when(g, 0).otherwise(F.col("base_total")).alias("base_memory"),
                           F.when(g, 0).otherwise(F.col("comp_total")).alias("comp_memory"), F.col("diff_total").alias("diff_memory"))
    return tidy(CP.memory_compare(rows, ["g"]))


@query("extreme_improve", "pr", _KC + " SELECT kernel, shape, ratio_total < 0.1 AND base_total > 1000 AS extreme FROM kc")
def extreme_improve(s, d):
    return kc(s, d).select("kernel", "shape", CP.extreme_improvement("ratio_total", "base_total").alias("extreme"))


_API = """
, ap AS (SELECT level || kernel AS api, coalesce(sum(duration) FILTER (side = 'A'), 0) AS base_total, coalesce(sum(duration) FILTER (side = 'R'), 0) AS comp_total, count(*) FILTER (side = 'A') AS base_calls, count(*) FILTER (side = 'R') AS comp_calls FROM pr WHERE side <> 'N' GROUP BY 1),
ar AS (SELECT *, comp_total - base_total AS diff_total, CASE WHEN base_total = 0 AND comp_total = 0 THEN 1 WHEN base_total = 0 THEN CAST('inf' AS DOUBLE) ELSE comp_total / base_total END AS ratio_total,
 CASE WHEN base_calls = 0 AND comp_calls = 0 THEN 1 WHEN base_calls = 0 THEN CAST('inf' AS DOUBLE) ELSE comp_calls / CAST(base_calls AS DOUBLE) END AS ratio_calls FROM ap)"""


def _api_rows(s, d):
    return CP.compare_rows(pr(s, d).withColumn("api", F.concat("level", "kernel")), F.col("side") == "A", ["api"], measures=["total", "calls"])


@query("compare_api", "pr", _API + """
SELECT api, base_total, comp_total, diff_total, round(ratio_total, 6) AS ratio_total, base_calls, comp_calls, CASE WHEN ratio_calls > 1.05 AND ratio_total > 1.05 THEN 'self_and_calls' WHEN ratio_calls > 1.05 THEN 'calls' WHEN ratio_total > 1.05 THEN 'self_duration'
 WHEN diff_total > 0 THEN 'slight_degradation' ELSE 'slight' END AS degradation_type FROM ar""")
def compare_api(s, d):
    rows = _api_rows(s, d)
    return tidy(rows.select("api", "base_total", "comp_total", "diff_total", "ratio_total", "base_calls", "comp_calls",
                            CP.api_degradation("ratio_calls", "ratio_total", "diff_total").alias("degradation_type")))


@query("compare_comm", "cm", """
, j AS (SELECT op_name, coalesce(sum(elapsed) FILTER (cluster_id = 'A'), 0) AS base_elapsed, coalesce(sum(elapsed) FILTER (cluster_id = 'R'), 0) AS comp_elapsed FROM cm WHERE cluster_id <> 'N' GROUP BY 1)
SELECT op_name, base_elapsed, comp_elapsed, comp_elapsed - base_elapsed AS diff_elapsed, round(comp_elapsed / base_elapsed, 6) AS ratio_elapsed FROM j ORDER BY abs(comp_elapsed - base_elapsed) DESC, op_name LIMIT 5""")
def compare_comm(s, d):
    c = cm(s, d)
    a, b = (c.where(F.col("cluster_id") == x).groupBy("op_name").agg(F.sum("elapsed").alias("elapsed")) for x in ("A", "R"))
    return tidy(CP.compare(a, b, ["op_name"], ["elapsed"], top_n=5))


@query("compare_overall", "st", """
, p AS (SELECT cluster_id AS s, step, avg(stage) AS g, avg(computing) AS c, avg(communication) AS m, avg(overlapped) AS o, avg(free) AS f FROM st WHERE cluster_id <> 'N' GROUP BY 1, 2),
q AS (SELECT s, avg(g) AS g, avg(c) AS c, avg(m) AS m, avg(o) AS o, avg(f) AS f, count(*) AS n FROM p GROUP BY 1), u AS (SELECT s, n, g AS stage, unnest(['E2E Time (Stage)', 'Computing Time', 'Communication Time', 'Overlapped Time', 'Free Time']) AS metric, unnest([g, c, m, o, f]) AS v FROM q)
SELECT metric, round(a.v, 4) AS base, round(a.v / a.stage, 4) AS base_share, a.n AS base_steps, round(b.v, 4) AS comp, round(b.v / b.stage, 4) AS comp_share, b.n AS comp_steps, round(b.v - a.v, 4) AS diff, round(b.v / a.v, 4) AS ratio
FROM u a JOIN u b USING (metric) WHERE a.s = 'A' AND b.s = 'R'""")
def compare_overall(s, d):
    t = st(s, d)
    return tidy(CP.compare_overall(t.where("cluster_id = 'A'"), t.where("cluster_id = 'R'")), 4)


_DIM = """
, m AS (SELECT kernel_type, coalesce(sum(duration) FILTER (side = 'A'), 0) AS b, coalesce(sum(duration) FILTER (side = 'R'), 0) AS c, CASE level WHEN 'L0' THEN 'compute' WHEN 'L1' THEN 'communication' ELSE 'schedule' END AS dimension FROM pr GROUP BY 1, 4)
SELECT kernel_type, dimension, b AS base_duration, c AS comp_duration, c - b AS diff_duration, round(CASE WHEN c > b THEN (c - b) / sum(greatest(c - b, 0)) OVER (PARTITION BY kernel_type) * 100 END, 4) AS contribution_pct,
 CASE WHEN c > b THEN 'degraded' WHEN c < b THEN 'improved' ELSE 'flat' END AS trend FROM m"""


def _shares(s, d):
    label = F.when(F.col("level") == "L0", "Computing Time").when(F.col("level") == "L1", "\tUncovered Communication Time").otherwise("Free Time")
    m = pr(s, d).groupBy("kernel_type", "level").agg(
        F.coalesce(F.sum(F.when(F.col("side") == "A", F.col("duration"))), F.lit(0.0)).alias("base_duration"),
        F.coalesce(F.sum(F.when(F.col("side") == "R", F.col("duration"))), F.lit(0.0)).alias("comp_duration"))
    m = m.select("kernel_type", label.alias("index"), F.col("level").alias("seq"), "base_duration", "comp_duration",
                 (F.col("comp_duration") - F.col("base_duration")).alias("diff_duration"))
    return CP.dimension_share(m, ["kernel_type"])


@query("dimension_share", "pr", _DIM)
def dimension_share(s, d):
    return tidy(_shares(s, d), 4)


@query("primary_dimensions", "pr", ", q AS (SELECT * FROM (" + _DIM.strip().lstrip(",").replace("m AS (", "WITH m AS (", 1) + """))
SELECT kernel_type, arg_min(dimension, (diff_duration, dimension)) FILTER (diff_duration < 0) AS primary_improved, arg_min(dimension, (-diff_duration, dimension)) FILTER (diff_duration > 0) AS primary_degraded FROM q GROUP BY 1""")
def primary_dimensions(s, d):
    return CP.primary_dimensions(_shares(s, d), ["kernel_type"])


@query("degraded_with_stack", "", """
SELECT l_orderkey AS module_rank, CAST(l_linenumber AS BIGINT) AS seq, CAST(round(l_extendedprice) - 50000 AS BIGINT) AS diff_self_time FROM lineitem
WHERE round(l_extendedprice) > 50000 AND (l_linestatus <> 'O' OR l_returnflag = 'A') ORDER BY 1, 2 LIMIT 5""")
def degraded_with_stack(s, d):
    rows = table(s, d, "lineitem").selectExpr(
        "l_orderkey AS module_rank", "CAST(l_linenumber AS BIGINT) AS seq", "CAST(round(l_extendedprice) - 50000 AS BIGINT) AS diff_self_time",
        "CASE WHEN l_linestatus = 'O' THEN '  ' ELSE l_linestatus END AS base_call_stack", "CASE WHEN l_returnflag = 'A' THEN 'f > g' END AS comp_call_stack")
    return CP.degraded_with_stack(rows).select("module_rank", "seq", "diff_self_time")


@query("row_kind", "", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'total' WHEN p_size % 5 = 1 THEN 'task' WHEN p_size % 5 = 2 THEN 'summary' ELSE 'detail' END AS row_kind FROM part""")
def row_kind(s, d):
    p = table(s, d, "part").selectExpr("p_partkey", "CASE p_size % 5 WHEN 0 THEN ' [ TOTAL ]' WHEN 1 THEN '|task' WHEN 2 THEN '  ' ELSE p_name END AS label")
    return CP.row_kind(p, "label").drop("label")


@query("compare_summary", "pr", _KC + _API + """
SELECT 'kernel' AS sheet, count(*) FILTER (diff_total < 0) AS improvements, count(*) FILTER (diff_total > 0) AS risks, sum(diff_total) AS net_diff FROM kc
UNION ALL SELECT 'api', count(*) FILTER (diff_total < 0), count(*) FILTER (diff_total > 0), sum(diff_total) FROM ar""")
def compare_summary(s, d):
    return CP.compare_summary(kernel=kc(s, d), api=_api_rows(s, d))


@query("module_compare", "pr", """
, sm AS (SELECT kernel AS module, CASE WHEN max(line_no) % 2 = 1 THEN 'total' ELSE 'detail' END AS row_kind, coalesce(sum(duration) FILTER (side = 'R'), 0) - coalesce(sum(duration) FILTER (side = 'A'), 0) AS diff_total FROM pr GROUP BY 1),
t AS (SELECT module, row_number() OVER (ORDER BY diff_total DESC, module) AS module_rank FROM sm WHERE row_kind = 'total' QUALIFY module_rank <= 10)
SELECT pr.kernel AS module, pr.level, module_rank, count(*) AS n, sum(duration) AS total FROM pr JOIN t ON t.module = pr.kernel GROUP BY 1, 2, 3""")
def module_compare(s, d):
    p = pr(s, d).withColumnRenamed("kernel", "module")
    stat = p.groupBy("module").agg(
        F.when(F.max("line_no") % 2 == 1, "total").otherwise("detail").alias("row_kind"),
        (F.coalesce(F.sum(F.when(F.col("side") == "R", F.col("duration"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(F.col("side") == "A", F.col("duration"))), F.lit(0.0))).alias("diff_total"))
    return CP.module_compare(stat, p).groupBy("module", "level", "module_rank").agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("total"))


# ------------------------------------------------------------------ scalar helpers

@query("fmt_count", "", """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END) // (CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 1 END) AS n FROM orders),
t AS (SELECT *, CASE WHEN n >= 1000000000 THEN 1000000000 WHEN n >= 1000000 THEN 1000000 ELSE 1000 END AS u FROM o)
SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(n AS STRING) ELSE CAST((n + u // 20) // (u // 10) // 10 AS STRING) || '.' || CAST((n + u // 20) // (u // 10) % 10 AS STRING) || CASE u WHEN 1000 THEN 'K' WHEN 1000000 THEN 'M' ELSE 'B' END END AS text FROM t""")
def fmt_count(s, d):
    n = "CAST(round(o_totalprice) AS BIGINT) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END) div (CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 1 END)"
    return table(s, d, "orders").selectExpr("o_orderkey", f"{n} AS n").select("o_orderkey", X.format_count("n").alias("text"))


@query("kernel_count", "", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM documents")
def kernel_count(s, d):
    return table(s, d, "documents").select("doc_id", X.count_lines("text").alias("n"))


@query("unit_convert", "ev_k", """
SELECT event_id, round(v / 1000.0, 6) AS ms, round(CASE WHEN k % 4 < 2 THEN v / 1024.0 ELSE v END, 6) AS gb FROM ev_k""")
def unit_convert(s, d):
    e = view(s, d, "ev_k")
    unit = F.element_at(F.array(F.lit("MB"), F.lit("MiB"), F.lit("GB"), F.lit("GiB")), (F.col("k") % 4 + 1).cast("int"))
    return tidy(e.select("event_id", X.us_to_ms("v").alias("ms"), X.memory_gb(F.col("v").cast("string"), unit).alias("gb")))


@query("duration_parse", "ev_k", """
SELECT event_id, CASE k % 5 WHEN 0 THEN k WHEN 1 THEN k * 1000 WHEN 2 THEN k + 0.5 WHEN 3 THEN NULL ELSE k * 1000 END::DOUBLE AS ms FROM ev_k""")
def duration_parse(s, d):
    t = F.expr("""CASE k % 5 WHEN 0 THEN '<' || k || 'ms' WHEN 1 THEN k || ' s' WHEN 2 THEN k || '.5' WHEN 3 THEN 'None' ELSE ' ≤ ' || k || 'S ' END""")
    return view(s, d, "ev_k").select("event_id", X.duration_ms(t).alias("ms"))


@query("truncate_display", "", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '... (' || CAST(length(text) AS STRING) || ' chars)' ELSE text END AS shown FROM documents")
def truncate_display(s, d):
    return table(s, d, "documents").select("doc_id", X.truncate_display("text").alias("shown"))


@query("path_section", "dp", """
SELECT path, split_part(path, '.', 1) AS section, CASE split_part(path, '.', 1) WHEN 'system' THEN 'system' WHEN 'env' THEN 'env' WHEN 'user config' THEN 'config' WHEN 'ping' THEN 'network' ELSE 'meta' END AS category FROM dp""")
def path_section(s, d):
    sec = X.path_section("path")
    return view(s, d, "dp").select("path", sec.alias("section"), X.section_category(sec).alias("category"))


@query("cell_flag_parse", "ev_k", """
SELECT event_id, CASE k % 6 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'note ' || k WHEN 3 THEN 'only ' || k WHEN 4 THEN NULL ELSE 'plain' END AS flag FROM ev_k""")
def cell_flag_parse(s, d):
    t = F.expr("CASE k % 6 WHEN 0 THEN '✓' WHEN 1 THEN ' × ' WHEN 2 THEN '✓ note ' || k WHEN 3 THEN '×only ' || k WHEN 4 THEN '-' ELSE 'plain' END")
    return view(s, d, "ev_k").select("event_id", X.cell_flag(t).alias("flag"))


@query("key_normalize", "", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'sub/' ELSE '' END || replace(lower(p_name), ' ', '-') AS key FROM part")
def key_normalize(s, d):
    t = F.concat(F.lit(" Org/"), F.when(F.col("p_partkey") % 3 == 0, "Sub/").otherwise(""), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(s, d, "part").select("p_partkey", X.normal_key(t).alias("key"))


@query("precision_key", "", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'bf16' WHEN 1 THEN 'w8a8' WHEN 2 THEN 'w4a8' WHEN 3 THEN 'bf16' ELSE 'int' || CAST(p_size AS STRING) END AS key FROM part""")
def precision_key(s, d):
    t = F.expr("CASE p_size % 5 WHEN 0 THEN 'BFloat-16' WHEN 1 THEN 'W8A8_C16' WHEN 2 THEN 'w4a8c8' WHEN 3 THEN ' FP16' ELSE 'INT-' || p_size END")
    return table(s, d, "part").select("p_partkey", X.precision_key(t).alias("key"))


@query("key_interest", "ev_k", """
SELECT event_id, k % 5 IN (0, 1, 2, 3) AS kept FROM ev_k""")
def key_interest(s, d):
    t = F.expr("CASE k % 5 WHEN 0 THEN 'max_model_len' WHEN 1 THEN 'a.b.quantization' WHEN 2 THEN 'x.fuse_' || k WHEN 3 THEN 'my_Eagle3_' || k ELSE 'seed' || k END")
    return view(s, d, "ev_k").select("event_id", LG.is_interesting(t).alias("kept"))


# ------------------------------------------------------------------ configuration

def dp(s, d):
    return view(s, d, "dp")


_ND = """
, one AS (SELECT dump_id, path, max(value) AS value FROM dp WHERE NOT starts_with(path, '_meta') GROUP BY 1, 2), pa AS (SELECT DISTINCT path FROM one), du AS (SELECT unnest(['n0', 'n1', 'n2']) AS dump_id),
gr AS (SELECT pa.path, du.dump_id, one.value FROM pa CROSS JOIN du LEFT JOIN one ON one.path = pa.path AND one.dump_id = du.dump_id),
nd AS (SELECT path, count(DISTINCT coalesce(value, '<none>')) AS n_values, coalesce(string_agg(dump_id, ',' ORDER BY dump_id) FILTER (value IS NOT NULL), '') AS present_in, coalesce(string_agg(dump_id, ',' ORDER BY dump_id) FILTER (value IS NULL), '') AS absent_in FROM gr GROUP BY 1),
nk AS (SELECT *, CASE WHEN n_values = 1 THEN 'identical' WHEN absent_in <> '' THEN 'only_in' ELSE 'modified' END AS kind, split_part(path, '.', 1) AS section FROM nd)"""


def _nway(s, d):
    return CF.nway_diff(dp(s, d), "dump_id", ["n0", "n1", "n2"])


@query("dump_nway_diff", "dp", _ND + " SELECT path, section, CASE section WHEN 'user config' THEN 'config' WHEN 'ping' THEN 'network' ELSE section END AS category, kind, n_values, present_in, absent_in FROM nk")
def dump_nway_diff(s, d):
    return _nway(s, d)


@query("dump_similarity", "dp", _ND + " SELECT count(*) AS total, count(*) FILTER (kind = 'identical') AS identical, round(count(*) FILTER (kind = 'identical') * 100.0 / count(*), 4) AS similarity_pct FROM nk")
def dump_similarity(s, d):
    return tidy(CF.similarity(_nway(s, d)), 4)


@query("section_stats", "dp", _ND + " SELECT section, count(*) AS total, count(*) FILTER (kind = 'identical') AS identical, count(*) FILTER (kind <> 'identical') AS different FROM nk GROUP BY 1")
def section_stats(s, d):
    return CF.section_stats(_nway(s, d))


_CFG = """
WITH a AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS key, CAST(c_custkey % 4 AS STRING) AS value FROM customer), b AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS key, CAST(c_custkey % 3 AS STRING) AS value FROM customer)"""


def _cfg(s, d):
    c = table(s, d, "customer")
    return (c.selectExpr("CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS key", "CAST(c_custkey % 4 AS STRING) AS value"),
            c.selectExpr("CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS key", "CAST(c_custkey % 3 AS STRING) AS value"))


@query("config_diff", "", _CFG + """
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_in_a' WHEN a.key IS NULL THEN 'only_in_b' ELSE 'value_mismatch' END AS kind, a.value AS value_a, b.value AS value_b FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""")
def config_diff(s, d):
    return CF.config_diff(*_cfg(s, d))


@query("key_union", "", _CFG + " SELECT key FROM a UNION SELECT key FROM b")
def key_union(s, d):
    return CF.key_union(*_cfg(s, d), ["key"])


@query("line_multiset_diff", "", """
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT lang, line, count(*) AS n FROM l WHERE doc_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT lang, line, count(*) AS n FROM l WHERE doc_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.line, b.line) AS line, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'a' ELSE 'b' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM a FULL JOIN b ON a.lang = b.lang AND a.line = b.line WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def line_multiset_diff(s, d):
    lines = table(s, d, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("line"))
    return CF.line_diff(lines.where("doc_id % 2 = 0"), lines.where("doc_id % 2 = 1"), ["lang"])


@query("json_flatten", "", """
WITH b AS (SELECT c_custkey AS dump_id, c_nationkey AS n, c_mktsegment AS g, c_custkey % 3 AS m FROM customer)
SELECT dump_id, 'a.name' AS path, g AS value FROM b UNION ALL SELECT dump_id, 'a.list[0]', CAST(n AS STRING) FROM b UNION ALL SELECT dump_id, 'a.list[1].x', 'v' || CAST(m AS STRING) FROM b
UNION ALL SELECT dump_id, 'empty', '{}' FROM b UNION ALL SELECT dump_id, 'none', '[]' FROM b UNION ALL SELECT dump_id, 'nul', NULL FROM b UNION ALL SELECT dump_id, 'ok', CASE WHEN m = 0 THEN 'true' ELSE 'false' END FROM b""")
def json_flatten(s, d):
    text = F.format_string('{"a": {"name": "%s", "list": [%d, {"x": "v%d"}]}, "empty": {}, "none": [], "nul": null, "ok": %s}',
                           "c_mktsegment", "c_nationkey", F.col("c_custkey") % 3, F.when(F.col("c_custkey") % 3 == 0, "true").otherwise("false"))
    docs = table(s, d, "customer").select(F.col("c_custkey").alias("dump_id"), F.parse_json(text).alias("doc"))
    return CF.json_flatten(docs, "doc", ["dump_id"])


@query("args_flatten", "", """
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS STRING) AS k FROM events)
SELECT event_id, 'outer' AS path, '{"k":' || k || '}' AS value FROM e UNION ALL SELECT event_id, 'outer.k', k FROM e UNION ALL SELECT event_id, 'plain', 'x' FROM e""")
def args_flatten(s, d):
    text = F.concat(F.lit('{"outer": '), F.col("props"), F.lit(', "plain": "x"}'))
    docs = table(s, d, "events").select("event_id", F.parse_json(text).alias("doc"))
    return CF.json_flatten(docs, "doc", ["event_id"], keep_parents=True)


@query("env_health", "", """
WITH p AS (SELECT 'c' || CAST(c_custkey % 50 AS STRING) AS dump_id, c_custkey % 8 AS m, c_custkey AS k FROM customer),
f AS (SELECT dump_id, CASE m WHEN 0 THEN 'system.page_size' WHEN 1 THEN 'env.OMP_NUM_THREADS' WHEN 2 THEN 'env.MY_API_KEY' WHEN 3 THEN 'ping.r0' WHEN 4 THEN 'npu.toolkit.version' WHEN 5 THEN 'weight.a' WHEN 6 THEN 'system.virtual_machine' ELSE 'link.d0' END AS path,
 CASE m WHEN 0 THEN CASE WHEN k % 3 = 0 THEN '65536' ELSE '4096' END WHEN 3 THEN CASE WHEN k % 2 = 1 AND k % 3 = 0 THEN '100% packet loss' ELSE '3 sent, 0% packet loss' END WHEN 4 THEN CASE WHEN k % 3 = 0 THEN '8.2.RC1' WHEN k % 3 = 1 THEN '' ELSE '8.2' END
  WHEN 6 THEN CASE WHEN k % 3 = 0 THEN 'True' ELSE 'False' END WHEN 7 THEN CASE WHEN k % 3 = 0 THEN 'link status: DOWN' ELSE 'link status: UP' END ELSE 'x' END AS value FROM p),
d AS (SELECT DISTINCT dump_id FROM f),
sc(path, good, bad) AS (VALUES ('system.high_performance', 'true', 'problem'), ('system.virtual_machine', 'false', 'notice'), ('system.transparent_hugepage', 'always', 'warning'), ('system.overcommit_memory', '0', 'problem'), ('system.page_size', '4096', 'notice')),
mx AS (SELECT dump_id, path, max(lower(value)) AS v FROM f GROUP BY 1, 2),
s1 AS (SELECT d.dump_id, 'system' AS "check", sc.path AS subject, CASE WHEN v IS NULL THEN 'missing' WHEN v = good THEN 'ok' ELSE bad END AS status, v AS value FROM d CROSS JOIN sc LEFT JOIN mx ON mx.dump_id = d.dump_id AND mx.path = sc.path),
vr AS (SELECT d.dump_id, 'variable' AS c, n AS subject, 'missing' AS status, CAST(NULL AS STRING) AS value FROM d CROSS JOIN (SELECT unnest(['LD_LIBRARY_PATH', 'ATB_HOME_PATH', 'ATB_SPEED_HOME_PATH', 'HCCL_BUFFSIZE', 'TASK_QUEUE_ENABLE', 'RANK_TABLE_FILE', 'OMP_NUM_THREADS', 'PYTORCH_NPU_ALLOC_CONF']) AS n) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dump_id = d.dump_id AND f.path = 'env.' || n)),
se AS (SELECT d.dump_id, 'section' AS c, n AS subject, 'missing' AS status, CAST(NULL AS STRING) AS value FROM d CROSS JOIN (SELECT unnest(['mies config', 'user config', 'model config', 'weight', 'ping', 'hccl', 'link', 'vnic', 'tls']) AS n) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.dump_id = d.dump_id AND split_part(f.path, '.', 1) = n))
SELECT * FROM s1 WHERE status <> 'ok' UNION ALL SELECT * FROM vr UNION ALL SELECT * FROM se
UNION ALL SELECT dump_id, 'secret_name', path, 'problem', NULL FROM f WHERE path = 'env.MY_API_KEY' UNION ALL SELECT dump_id, 'release_candidate', path, 'notice', NULL FROM f WHERE path LIKE '%.version' AND value LIKE '%RC1'
UNION ALL SELECT dump_id, 'version', path, 'missing', NULL FROM f WHERE path LIKE '%.version' AND value = '' UNION ALL SELECT dump_id, 'network_ping', path, 'problem', NULL FROM f WHERE path = 'ping.r0' AND value LIKE '100%'
UNION ALL SELECT dump_id, 'network_link', path, 'problem', NULL FROM f WHERE path = 'link.d0' AND value LIKE '%DOWN'""")
def env_health(s, d):
    p = table(s, d, "customer").selectExpr(
        "'c' || CAST(c_custkey % 50 AS STRING) AS dump_id",
        """CASE c_custkey % 8 WHEN 0 THEN 'system.page_size' WHEN 1 THEN 'env.OMP_NUM_THREADS' WHEN 2 THEN 'env.MY_API_KEY' WHEN 3 THEN 'ping.r0' WHEN 4 THEN 'npu.toolkit.version'
        WHEN 5 THEN 'weight.a' WHEN 6 THEN 'system.virtual_machine' ELSE 'link.d0' END AS path""",
        """CASE c_custkey % 8 WHEN 0 THEN IF(c_custkey % 3 = 0, '65536', '4096') WHEN 3 THEN IF(c_custkey % 2 = 1 AND c_custkey % 3 = 0, '100% packet loss', '3 sent, 0% packet loss')
        WHEN 4 THEN CASE c_custkey % 3 WHEN 0 THEN '8.2.RC1' WHEN 1 THEN '' ELSE '8.2' END WHEN 6 THEN IF(c_custkey % 3 = 0, 'True', 'False')
        WHEN 7 THEN IF(c_custkey % 3 = 0, 'link status: DOWN', 'link status: UP') ELSE 'x' END AS value""")
    return CF.env_health(p)


def _domain_sql() -> str:
    import re

    return " UNION ALL ".join(
        f"SELECT page_id, '{dom}' AS domain FROM p WHERE NOT ends_with(path, '.md5') AND ({' OR '.join('regexp_matches(path, ' + chr(39) + '(^|/)' + re.escape(x[3:]).replace(chr(92) + '*', '[^/]*') + '$' + chr(39) + ')' for x in pats)})"
        for dom, pats in NODE_DOMAINS.items())


_PATH = """CASE page_id % 7 WHEN 0 THEN '/OSDump/systemcom.tar.gz' WHEN 1 THEN '/x/CpuMem/npu_info' WHEN 2 THEN '/networkinfo/ifconfig_info' WHEN 3 THEN '/y/cooling_app/fan_info.txt' WHEN 4 THEN '/BIOS/currentvalue.json' WHEN 5 THEN '/BIOS/currentvalue.json.md5' ELSE '/other' END"""


@query("component_consistency", "", """
WITH p AS (SELECT 'd' || CAST(c_nationkey AS STRING) AS dump_id, 'RC' || CAST(max(c_custkey) % 2 AS STRING) AS a, 'RC' || CAST(min(c_custkey) % 2 AS STRING) AS b FROM customer GROUP BY c_nationkey)
SELECT dump_id, a AS left_series, b AS right_series, a = b AS consistent FROM p""")
def component_consistency(s, d):
    c = table(s, d, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("hi"), F.min("c_custkey").alias("lo"))
    rows = c.selectExpr("'d' || CAST(c_nationkey AS STRING) AS dump_id", """stack(2, 'npu.toolkit.version', '8.2.0 (RC' || CAST(hi % 2 AS STRING) || ')',
        'npu.kernel.version', 'RC' || CAST(lo % 2 AS STRING)) AS (path, value)""")
    return CF.component_consistency(rows, "npu.toolkit.version", "npu.kernel.version")


@query("sub_metrics", "", """
SELECT p_partkey, p_name AS "index" FROM part WHERE p_size % 3 = 1""")
def sub_metrics(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat(F.repeat(F.lit("\t"), F.col("p_size") % 3), "p_name").alias("index"))
    return CP.sub_metrics(p)


@query("node_log_domain", "", f"WITH p AS (SELECT page_id, url || {_PATH} AS path FROM pages) " + _domain_sql())
def node_log_domain(s, d):
    p = table(s, d, "pages").selectExpr("page_id", f"url || {_PATH} AS path")
    return p.select("page_id", F.explode(log_domains(F.col("path"))).alias("domain"))


# ------------------------------------------------------------------ logs

def lg(s, d):
    return view(s, d, "lg")


_LM = """
, lm AS (SELECT log_id, seq, CASE WHEN contains(value, 'Loading model weights') THEN 'model_weight_memory' WHEN contains(value, 'Available KV') THEN 'kv_cache_memory' WHEN contains(value, 'GPU KV cache usage') THEN 'kv_cache_usage' ELSE 'accepted_tokens' END AS metric,
 CASE WHEN contains(value, 'Loading model weights') THEN regexp_extract(value, 'took ([0-9.]+)', 1) WHEN contains(value, 'Available KV') THEN regexp_extract(value, 'memory: ([0-9.]+)', 1) WHEN contains(value, 'GPU KV cache usage') THEN regexp_extract(value, 'usage: ([0-9.]+)', 1)
  ELSE regexp_extract(value, 'Accepted: ([0-9]+)', 1) END AS value, CASE WHEN contains(value, 'Loading model weights') THEN 'GB' WHEN contains(value, 'Available KV') THEN 'GiB' WHEN contains(value, 'GPU KV cache usage') THEN '%' ELSE 'tokens' END AS unit FROM lg WHERE NOT starts_with(value, 'DEBUG'))"""


@query("log_metrics_lines", "lg", _LM + " SELECT * FROM lm")
def log_metrics_lines(s, d):
    return LG.line_metrics(lg(s, d))


@query("log_metrics_agg", "lg", """
, w AS (SELECT log_id, seq, regexp_extract(value, 'took ([0-9.]+)', 1) AS v FROM lg WHERE contains(value, 'Loading model weights')), k AS (SELECT log_id, seq, regexp_extract(value, 'memory: ([0-9.]+)', 1) AS v FROM lg WHERE contains(value, 'Available KV')),
a AS (SELECT * FROM lg WHERE contains(value, 'Engines Aggregated'))
SELECT log_id, 'model_weight_memory' AS metric, min(seq) AS seq, v AS value, 'GB' AS unit FROM w GROUP BY log_id, v UNION ALL SELECT log_id, 'kv_cache_memory', min(seq), arg_min(v, seq), 'GiB' FROM k GROUP BY 1
UNION ALL SELECT log_id, 'generation_throughput', seq, regexp_extract(value, 'generation throughput: ([0-9.]+)', 1), 'tokens/s' FROM a UNION ALL SELECT log_id, 'kv_cache_usage', seq, regexp_extract(value, 'usage: ([0-9.]+)', 1), '%' FROM a
UNION ALL SELECT log_id, 'prefix_cache_hit_rate', seq, regexp_extract(value, 'hit rate: ([0-9.]+)', 1), '%' FROM a""")
def log_metrics_agg(s, d):
    return LG.aggregated_metrics(lg(s, d))


@query("log_format", "lg", "SELECT log_id, CASE WHEN bool_or(contains(value, 'Engines Aggregated')) THEN 'b' WHEN bool_or(contains(value, 'Loading model weights')) THEN 'a' ELSE 'unknown' END AS format FROM lg GROUP BY 1")
def log_format(s, d):
    return LG.log_format(lg(s, d))


@query("metric_transpose", "lg", _LM + """
, r AS (SELECT *, row_number() OVER (PARTITION BY log_id, metric ORDER BY seq) AS k FROM lm)
SELECT log_id, metric, k, value FROM r""")
def metric_transpose(s, d):
    return LG.transpose(LG.line_metrics(lg(s, d)))


@query("first_seen_distinct", "lg", _LM + " SELECT log_id, value, min(seq) AS first_seq FROM lm WHERE metric = 'model_weight_memory' GROUP BY 1, 2")
def first_seen_distinct(s, d):
    return LG.first_seen_distinct(LG.line_metrics(lg(s, d)).where("metric = 'model_weight_memory'"), ["log_id"], "value")


@query("launch_args", "", """
WITH e AS (SELECT 'u' || CAST(user_id AS STRING) AS log_id, arg_min(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), event_id) AS k FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT log_id, 'model' AS key, 'm' || CAST(k AS STRING) AS value, 'feature' AS "group" FROM e UNION ALL SELECT log_id, 'enable_list', '[1, [2, ' || CAST(k AS STRING) || ']]', 'feature' FROM e
UNION ALL SELECT log_id, 'speculative_config.x.num_spec_tokens', '9', 'speculative' FROM e UNION ALL SELECT log_id, 'speculative_config.enable_deep', 'True', 'feature' FROM e
UNION ALL SELECT log_id, 'max_model_len' AS key, CAST(k * 1024 AS STRING) AS value, 'config' AS "group" FROM e UNION ALL SELECT log_id, 'quantization', 'w8a8', 'quantization' FROM e
UNION ALL SELECT log_id, 'enable_expert_parallel', CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END, 'parallel' FROM e UNION ALL SELECT log_id, 'speculative_config', '{''num_spec_tokens'': ' || CAST(k % 5 AS STRING) || ', ''method'': ''mtp'', ''x'': {''num_spec_tokens'': 9}, ''enable_deep'': True}', 'speculative' FROM e
UNION ALL SELECT log_id, 'speculative_config.num_spec_tokens', CAST(k % 5 AS STRING), 'speculative' FROM e""")
def launch_args(s, d):
    e = view(s, d, "ev_k")
    line = F.expr("""CASE WHEN event_type = 'signup' THEN 'INFO non-default args: {''model'': ''m' || k || ''', ''max_model_len'': ' || (k * 1024) || ', ''quantization'': ''w8a8'', ''enable_expert_parallel'': '
        || IF(k % 2 = 0, 'True', 'False') || ', ''speculative_config'': {''num_spec_tokens'': ' || (k % 5) || ', ''method'': ''mtp'', ''x'': {''num_spec_tokens'': 9}, ''enable_deep'': True}, ''enable_list'': [1, [2, ' || k || ']], ''config'': Config(level=3, x=(1, 2)), ''seed'': ' || k || '}' ELSE 'INFO other line' END""")
    lines = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("log_id"), F.col("event_id").alias("seq"), line.alias("value"))
    return LG.launch_args(lines)


# ------------------------------------------------------------------ look-ups

_WANT = "WITH w AS (SELECT o_orderkey, o_orderkey % 25 AS brand, CAST(round(o_totalprice) AS BIGINT) % 2100 AS want FROM orders), t AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS brand, CAST(round(p_retailprice) AS BIGINT) AS size, p_partkey AS tie, p_name AS latency FROM part)"


def _want(s, d):
    w = table(s, d, "orders").selectExpr("o_orderkey", "o_orderkey % 25 AS brand", "CAST(round(o_totalprice) AS BIGINT) % 2100 AS want")
    t = table(s, d, "part").selectExpr("CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS brand", "CAST(round(p_retailprice) AS BIGINT) AS size",
                                       "p_partkey AS tie", "p_name AS latency")
    return w, t


@query("nearest_lookup", "", _WANT + """
SELECT w.o_orderkey, w.brand, w.want, arg_min(t.size, (abs(t.size - w.want), t.tie)) AS matched_size, arg_min(t.latency, (abs(t.size - w.want), t.tie)) AS latency FROM w LEFT JOIN t ON t.brand = w.brand GROUP BY 1, 2, 3""")
def nearest_lookup(s, d):
    return LK.nearest(*_want(s, d), ["brand"], "want", "size", "latency", "tie")


@query("bucket_lookup", "", _WANT + """
, m AS (SELECT w.o_orderkey, w.brand, w.want, min(t.size) FILTER (t.size >= w.want) AS up, max(t.size) AS top FROM w LEFT JOIN t ON t.brand = w.brand GROUP BY 1, 2, 3)
SELECT m.o_orderkey, m.brand, m.want, coalesce(up, top) AS matched_size, arg_min(t.latency, t.tie) AS latency FROM m LEFT JOIN t ON t.brand = m.brand AND t.size = coalesce(up, top) GROUP BY 1, 2, 3, 4""")
def bucket_lookup(s, d):
    return LK.ceiling(*_want(s, d), ["brand"], "want", "size", "latency", "tie")
