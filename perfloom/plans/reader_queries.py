"""The parsing parts of the readers over text that is built from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfloom.operators.configdiff import parse_json_tolerant
from perfloom.plans.registry import query
from perfloom.plans.views import view
from perfloom.shared import shared_dir
from perfloom.sources import cluster as SC
from perfloom.sources import events as SE
from perfloom.sources import files as SF


def _lt(s, d):
    """Kernel line events with the parts of a text line."""
    return view(s, d, "lt").select("trace_id", "seq", "ts", "pid", "cpu", "name", "prev_pid", "next_pid", "prev_state", "wake_pid", "sector", "sectors", "rwbs")


def _sec():
    return F.format_string("%d.%06d", F.floor(F.col("ts") / 1000000), F.col("ts") % 1000000)


@query("read_kernel_lines", "lt", """
SELECT trace_id, seq, ts, cpu, CASE WHEN name = 'sched_switch' THEN prev_pid WHEN name LIKE 'sched_wak%' THEN wake_pid ELSE pid END AS pid, name,
 CASE WHEN name LIKE 'sched%' THEN 'cpu_sched' WHEN name LIKE 'numa%' THEN 'memory' WHEN name LIKE 'block%' THEN 'io' ELSE 'cpu_function' END AS cat,
 CASE WHEN name = 'sched_switch' THEN 'other app' END AS next_comm, CASE WHEN name = 'sched_switch' THEN next_pid END AS next_pid, CASE WHEN name = 'sched_switch' THEN prev_state END AS prev_state,
 CASE WHEN name LIKE 'sched_wak%' THEN cpu END AS target_cpu, CASE WHEN name LIKE 'numa%' THEN cpu + 1 END AS nid, CASE WHEN name LIKE 'block%' THEN rwbs END AS rwbs,
 CASE WHEN name LIKE 'block%' THEN sector END AS sector, CASE WHEN name LIKE 'block%' THEN sectors END AS sectors FROM lt""")
def read_kernel_lines(s, d):
    n = F.col("name")
    head = F.concat(F.format_string("my app-%d [%03d] d.h1 ", "pid", "cpu"), _sec(), F.lit(": "))
    body = F.when(n == "sched_switch", F.format_string(
        "sched_switch: prev_comm=my app prev_pid=%d prev_prio=120 prev_state=%s ==> next_comm=other app next_pid=%d next_prio=120", "prev_pid", "prev_state", "next_pid")).when(
        n.startswith("sched_wak"), F.format_string("%s: comm=a b pid=%d prio=120 target_cpu=%03d", "name", "wake_pid", "cpu")).when(
        n.startswith("numa"), F.format_string("%s: pid=%d cpu=%d nid=%d", "name", "pid", "cpu", F.col("cpu") + 1)).when(
        n.startswith("block"), F.format_string("%s: 8,0 %s 4096 () %d + %d [kworker]", "name", "rwbs", "sector", "sectors")).otherwise(n)
    lines = _lt(s, d).select("trace_id", "seq", F.concat(head, body).alias("value"))
    ev = SE._ftrace_events(lines.union(lines.select("trace_id", "seq", F.lit("# comment"))), True)
    a = {c: F.get_json_object("args", f"$.{c}") for c in ("next_comm", "next_pid", "prev_state", "target_cpu", "nid", "rwbs", "sector", "sectors")}
    return ev.select("trace_id", "seq", "ts", "cpu", "pid", "name", "cat", *[
        (c if k in ("next_comm", "prev_state", "rwbs") else c.cast("long")).alias(k) for k, c in a.items()])


@query("read_perf_lines", "lt", "SELECT trace_id, seq, ts, pid, pid + 1 AS tid, cpu, 'sub:' || replace(name, ':', '_') AS name FROM lt")
def read_perf_lines(s, d):
    line = F.concat(F.format_string("app %d/%d [%03d] ", F.col("pid"), F.col("pid") + 1, F.col("cpu")), _sec(),
                    F.lit(": sub:"), F.replace("name", F.lit(":"), F.lit("_")), F.lit(": some text"))
    lines = _lt(s, d).select("trace_id", "seq", line.alias("value"))
    return SE._perf_line_events(lines).select("trace_id", "seq", "ts", "pid", "tid", "cpu", "name")


@query("read_perf_samples", "lt", """
SELECT trace_id, 2 * seq AS seq, ts, pid, cpu, 'fn_' || CAST(cpu AS STRING) AS name, 2 AS depth FROM lt UNION ALL SELECT trace_id, 2 * seq + 1, ts, pid, cpu, 'swapper task', 0 FROM lt""")
def read_perf_samples(s, d):
    sec = F.concat(_sec(), F.format_string(" CPU: %d", "cpu"))
    full = F.concat(F.format_string("app %d ", "pid"), sec, F.format_string("\n\tfn_%d ([kernel])\n\tmain (/bin/app)\n", "cpu"))
    bare = F.concat(F.format_string("swapper task %d ", "pid"), sec)
    end = F.when(F.col("seq") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    rows = _lt(s, d).select("trace_id", F.inline(F.array(
        F.struct((2 * F.col("seq")).alias("seq"), F.replace(full, F.lit("\n"), end).alias("value")), F.struct((2 * F.col("seq") + 1).alias("seq"), bare.alias("value")))))
    return SE._perf_events(rows).select("trace_id", "seq", "ts", "pid", "cpu", "name", F.get_json_object("args", "$.stack_depth").cast("int").alias("depth"))


@query("read_json_lines", "tv", """
SELECT trace_id, seq, ts, dur, pid, tid, CASE WHEN seq % 2 = 0 THEN 'unknown' ELSE name END AS name, CASE WHEN seq % 3 = 0 THEN '' ELSE cat END AS cat FROM tv WHERE seq % 11 <> 0
UNION ALL SELECT trace_id, seq, 0, 0, 0, 0, 'other', '' FROM tv WHERE seq % 11 = 0""")
def read_json_lines(s, d):
    ev = view(s, d, "tv")
    whole = F.to_json(F.struct(
        F.when(F.col("seq") % 2 != 0, F.col("name")).alias("name"), F.col("ts").alias("timestamp"), "dur", F.when(F.col("seq") % 3 != 0, F.col("cat")).alias("cat"), "pid", "tid"))
    text = F.when(F.col("seq") % 11 == 0, F.lit('{"type": "other"}')).otherwise(whole)
    lines = ev.select("trace_id", "seq", text.alias("value"))
    bad = ev.select("trace_id", "seq", F.lit('{"name": broken').alias("value")).union(ev.select("trace_id", "seq", F.lit("no object")))
    return SE._jsonl_events(lines.union(bad)).select("trace_id", "seq", "ts", "dur", "pid", "tid", "name", "cat")


@query("read_operator_table", "tv", """
SELECT trace_id, seq, ts, dur, device_id, stream_id, name FROM tv WHERE seq % 7 <> 0""")
def read_operator_table(s, d):
    rows = view(s, d, "tv").select(
        "trace_id", "seq", F.col("name").alias("Op Name"), F.lit("MatMul").alias("Op Type"), F.col("ts").cast("string").alias("Start Time(us)"),
        F.when(F.col("seq") % 7 == 0, "n/a").otherwise(F.col("dur").cast("string")).alias("Duration(us)"),
        F.col("device_id").alias("Device ID"), F.col("stream_id").alias("Stream ID"), F.lit("1,2").alias("Input Shapes"))
    return SE.table_events(rows, F.col("trace_id"), F.col("seq")).select("trace_id", "seq", "ts", "dur", "device_id", "stream_id", "name")


@query("read_step_tables", "st", """
SELECT cluster_id, CAST(step AS STRING) AS step, CAST(rank AS STRING) AS rank, computing, communication, free, stage, 'old' AS version FROM st
UNION ALL SELECT cluster_id, CAST(step AS STRING), CAST(rank AS STRING), computing, communication, 0.0, stage, 'new' FROM st WHERE row_id % 2 = 0""")
def read_step_tables(s, d):
    st = view(s, d, "st")
    old = st.select("cluster_id", F.col("step").alias("step_id"), F.col("rank").alias("rank_id"), F.col("computing").alias("compute_time"),
                    F.col("communication").alias("communication_time"), F.col("free").alias("free_time"), F.col("stage").alias("stage_time"))
    new = st.select("cluster_id", F.when(F.col("row_id") % 2 == 0, "rank").otherwise("stage").alias("Type"), F.col("step").alias("Step"), F.col("rank").alias("Index"),
                    F.col("computing").cast("string").alias("Computing"), F.col("communication").alias("Communication"), F.lit("bad").alias("Free"), F.col("stage").alias("Stage"))
    cols = ["cluster_id", "step", "rank", "computing", "communication", "free", "stage"]
    return SC.canonical_steps(old, F.col("cluster_id")).select(*cols, F.lit("old").alias("version")).union(
        SC.canonical_steps(new, F.col("cluster_id")).select(*cols, F.lit("new").alias("version")))


@query("directory_kinds", "", """
SELECT '/land/run' || CAST(p_size AS STRING) AS directory, CASE WHEN bool_or(p_partkey % 40 IN (0, 1, 2, 3)) THEN 'profiler' ELSE 'unknown' END AS kind FROM part GROUP BY 1""")
def directory_kinds(s, d):
    name = "CASE p_partkey % 40 WHEN 0 THEN 'Trace_View.json' WHEN 1 THEN 'operator_detail_7.csv' WHEN 2 THEN 'step_trace_1.json' WHEN 3 THEN 'my_profiler_0.db' WHEN 4 THEN 'operator_detail.txt' WHEN 5 THEN 'other.db' ELSE 'f' || p_partkey || '.log' END"
    return SF.directory_kinds(s.read.parquet(f"{d}/part.parquet").selectExpr(f"'/land/run' || p_size || '/' || {name} AS file_path"))


@query("read_dump_repair", "", """
SELECT c_custkey AS dump_id, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE 'x_' || CAST(c_nationkey AS STRING) END AS name, CASE WHEN c_custkey % 5 <> 4 THEN c_mktsegment END AS segment FROM customer""")
def read_dump_repair(s, d):
    text = F.format_string('{"name": "x_%d",\n\n   \n"segment": "%s"}', "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey") % 5
    odd = F.when(k == 1, F.replace(text, F.lit("x_"), F.lit("x\\_"))).when(k == 4, F.lit("{no json")).otherwise(text)
    doc = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("dump_id"), parse_json_tolerant(odd).alias("v"))
    return doc.select("dump_id", F.try_variant_get("v", "$.name", "string").alias("name"), F.try_variant_get("v", "$.segment", "string").alias("segment"))


@query("read_trace_documents", "tv", """
SELECT trace_id, seq, ts, dur, pid, tid, name, 'X' AS ph FROM tv""")
def read_trace_documents(s, d):
    """Events written as JSON documents of one line each, which the reader splits."""
    args = F.struct(F.col("trace_id").cast("string").alias("trace"), F.col("seq").cast("string").alias("at"), F.lit('}],"{').alias("note"))
    ev = view(s, d, "tv").select(F.to_json(F.struct("name", "ts", "dur", "pid", "tid", F.lit("X").alias("ph"), args.alias("args"))).alias("value"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    path = shared_dir(s)
    ev.select(F.when(first, F.concat(F.lit('{"a": {"x": []}, "traceEvents": ['), "value")).otherwise(F.col("value")).alias("value")).write.option("lineSep", ",").text(path)
    a = {c: F.get_json_object("args", f"$.{c}") for c in ("trace", "at")}
    found = SE.chrome_trace(s, path).where(F.get_json_object("args", "$.note") == '}],"{')
    return found.select(a["trace"].cast(view(s, d, "tv").schema["trace_id"].dataType).alias("trace_id"), a["at"].cast("long").alias("seq"), "ts", "dur", "pid", "tid", "name", "ph")
