import json

import pytest

from perfloom.functions import exprs as X
from perfloom.operators import configdiff as CF
from perfloom.operators import events as EV
from perfloom.operators import logs as LG
from perfloom.sources import cluster, files, read
from perfloom.sources import events as SE


def put(d, name, text):
    p = d / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


FTRACE = """# tracer: nop
#
# entries-in-buffer/entries-written: 8/10   #P:8
# P:8
          bash-1234  [001] d... 100.000100: sched_switch: prev_comm=bash prev_pid=1234 prev_prio=120 prev_state=S ==> next_comm=my-app next_pid=77 next_prio=120
my-app-77 [001] d... 100.000200: sched_wakeup: comm=bash pid=1234 prio=120 target_cpu=003
my-app-77 [002] .... 100.000300: sched_switch: prev_comm=a prev_pid=1 prev_prio=1 prev_state=R next_comm=b next_pid=2 next_prio=1
my-app-77 [002] .... 100.000400: block_rq_issue: 8,0 WS 0 () 128 + 8 [python]
my-app-77 [002] .... 100.000500: numa_hit: pid=9 cpu=2 nid=1 preferred_node=0
my-app-77 [002] .... 100.000600: do_page_fault <-page_fault
my-app-77 [002] .... 100.000700: sched_switch: broken
garbage line
"""


def test_ftrace(spark, tmp_path):
    p = put(tmp_path, "a.txt", FTRACE)
    rows = {r.ts: r for r in read(spark, "ftrace", p).collect()}
    assert len(rows) == 6
    first = rows[100_000_100]
    assert (first.trace_id, first.pid, first.cpu, first.cat, first.name) == ("a", 1234, 1, "cpu_sched", "sched_switch")
    assert json.loads(first.args)["next_comm"] == "my-app"
    wake = rows[100_000_200]
    assert (wake.pid, json.loads(wake.args)["target_cpu"]) == (1234, 3)
    assert json.loads(rows[100_000_400].args) == {"dev": "8,0", "rwbs": "WS", "sector": 128, "sectors": 8}
    assert json.loads(rows[100_000_500].args)["preferred_node"] == 0
    fn = rows[100_000_600]
    assert (fn.name, fn.cat, fn.pid, json.loads(fn.args)) == ("do_page_fault <-page_fault", "cpu_function", 77, {"task": "my-app"})
    typed = {r.ts: r for r in EV.typed_args(read(spark, "ftrace", p)).collect()}
    assert (typed[100_000_100].next_pid, typed[100_000_200].wake_pid) == (77, 1234)
    head = SE.ftrace_header(spark, p).collect()[0]
    assert (head.tracer, head.entries_in_buffer, head.entries_written, head.cpu_count) == ("nop", 8, 10, 8)


def test_chrome_document_and_lines(spark, tmp_path):
    ev = [{"name": "a", "ph": "B", "ts": 1, "pid": 1, "tid": 2}, {"name": "a", "ph": "E", "ts": 9.7, "pid": 1, "tid": 2}, 5,
          {"name": "k", "ph": "X", "ts": 3, "dur": 4, "args": {"device": "1", "stream": 2, "cpu": 6}}, {"name": "bad", "ts": "zzz"}]
    doc = put(tmp_path / "doc", "t1.json", json.dumps({"traceEvents": ev}))
    bare = put(tmp_path / "bare", "t2.json", json.dumps(ev))
    lines = put(tmp_path / "lines", "t3.json", "[\n" + ",\n".join(json.dumps(e) for e in ev) + "\n]")
    for path, layout in ((doc, "document"), (bare, "document"), (lines, "lines")):
        rows = sorted(read(spark, "chrome", path, layout=layout).collect(), key=lambda r: r.seq)
        assert [(r.name, r.ph, r.ts) for r in rows] == [("a", "B", 1), ("a", "E", 9), ("k", "X", 3)]
        assert (rows[2].device_id, rows[2].stream_id, rows[2].cpu, rows[2].dur, rows[2].cat) == (1, 2, 6, 4, "unknown")
        paired = EV.pair_begin_end(read(spark, "chrome", path, layout=layout)).where("name = 'a'").collect()
        assert [(r.ph, r.ts, r.dur) for r in paired] == [("X", 1, 8)]


PERF = """python  12 5.000001 CPU:3
        do_work (ffff+0x1)
        main (aaaa)

python  12 5.000002 CPU:1
bash  13 5.000003 CPU: 0
        shell_main (bbbb)
"""


def test_perf(spark, tmp_path):
    rows = sorted(read(spark, "perf", put(tmp_path, "p.txt", PERF)).collect(), key=lambda r: r.ts)
    assert [(r.name, r.pid, r.cpu, r.ts) for r in rows] == [("do_work", 12, 3, 5_000_001), ("python", 12, 1, 5_000_002), ("shell_main", 13, 0, 5_000_003)]
    assert json.loads(rows[0].args)["callstack"] == ["do_work (ffff+0x1)", "main (aaaa)"]
    one = put(tmp_path / "x", "q.txt", "app 5/6 [002] 1.5: sched:sched_switch: hello\nmy-app-77 [002] .... 100.000600: f\n")
    got = sorted(SE.perf_lines(spark, one).collect(), key=lambda r: r.ts)
    assert [(r.name, r.pid, r.tid, r.ts) for r in got] == [("sched:sched_switch", 5, 6, 1_500_000), ("f", 77, 77, 100_000_600)]


def test_perf_samples_over_splits_and_line_ends(spark, tmp_path):
    samples = [(f"my app {k}" if k % 3 else "app", 10 + k, k % 4) for k in range(900)]
    text = "".join(f"{c} {p} {k}.5 CPU:{u}\n" + "".join(f"\tfn{j}(int) (lib{j}.so)\n" for j in range(k % 6)) + ("\n" if k % 2 else "")
                   for k, (c, p, u) in enumerate(samples))
    put(tmp_path, "lf.txt", text)
    (tmp_path / "crlf.txt").write_bytes(text.replace("\n", "\r\n").encode())
    keys = {"spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "100"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = read(spark, "perf", str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for trace in ("lf", "crlf"):
        own = sorted((r for r in rows if r.trace_id == trace), key=lambda r: r.seq)
        assert len({r.seq for r in own}) == len(own) == 900
        assert [(r.ts, r.pid, r.cpu, r.name) for r in own] == [(k * 1_000_000 + 500_000, p, u, "fn0(int)" if k % 6 else c) for k, (c, p, u) in enumerate(samples)]
        assert [json.loads(r.args)["callstack"] for r in own] == [[f"fn{j}(int) (lib{j}.so)" for j in range(k % 6)] for k in range(900)]


def test_jsonl(spark, tmp_path):
    p = put(tmp_path, "e.jsonl", '{"type":"x","timestamp":5,"cpu":2}\nnot json\n{"name":"y","ts":7,"pid":3,"args":{"a":1}}\n{bad\n')
    rows = sorted(read(spark, "jsonl", p).collect(), key=lambda r: r.ts)
    assert [(r.name, r.ts, r.pid, r.cpu) for r in rows] == [("x", 5, 0, 2), ("y", 7, 3, -1)]


def test_operator_csv_and_kernel_table(spark, tmp_path):
    text = ("Op Name,Op Type,Task Type,Start Time(us),Duration(us),Device ID,Stream ID,Input Shapes,Output Shapes\n"
            'MatMul,MatMul,AI,10.9,5,0,1,"2,3","2,3"\ncopy_x,Memcpy,DMA,20,1,0,2,,\nSyncAll,E,E,bad,1,0,2,,\nSyncAll,E,E,30,,,,,\n')
    rows = sorted(read(spark, "op_csv", put(tmp_path, "operator_detail_0.csv", text)).collect(), key=lambda r: r.ts)
    assert [(r.name, r.cat, r.ts, r.dur, r.device_id, r.stream_id) for r in rows] == [
        ("MatMul", "npu_kernel", 10, 5, 0, 1), ("copy_x", "npu_memcpy", 20, 1, 0, 2), ("SyncAll", "stream_sync", 30, 0, -1, -1)]
    out = str(tmp_path / "k")
    spark.createDataFrame([("k1", "MatMul", 5.0, 2.0, 0)], "kernel_name string, kernel_type string, start_time double, elapsed double, device int").write.parquet(out)
    r = read(spark, "kernel_table", out).collect()[0]
    assert (r.name, r.ts, r.dur, r.device_id, r.pid) == ("k1", 5, 2, 0, -1)


def test_step_json(spark, tmp_path):
    steps = [{"step_id": 1, "start_time": 10, "end_time": 30, "forward_start": 12}, {"iteration": 2, "ts": 40}]
    rows = read(spark, "step_json", put(tmp_path, "step_trace_1.json", json.dumps(steps))).collect()
    assert sorted((r.name, r.ts, r.dur, r.ph) for r in rows) == [("Forward", 12, 0, "I"), ("Step#1", 10, 20, "X"), ("Step#2", 40, 0, "X")]


def test_write_and_scan(spark, tmp_path):
    ev = read(spark, "ftrace", put(tmp_path, "a.txt", FTRACE))
    EV.write_events(ev, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert EV.event_filter(back, ts_start=100_000_100, ts_end=100_000_200).count() == 2
    files.write_result(back.select("name", "ts"), str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6


def test_event_table_is_read_without_a_shuffle_and_by_time(spark, tmp_path):
    from pyspark.sql import functions as F

    from perfloom.operators import timeline as TL
    from perfloom.plans.trace_queries import HOUR, tv

    ev = tv(spark, "/root/testdata/sf0.001")
    EV.save_event_table(ev, "saved_events", str(tmp_path / "table"), buckets=4, slot_us=24 * HOUR)
    back = EV.event_table(spark, "saved_events")
    assert back.columns == ev.columns and back.count() == ev.count()
    slices = TL.cpu_slices(back)
    assert "Exchange" not in slices._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, slices.collect())) == sorted(map(tuple, TL.cpu_slices(ev).collect()))
    lo, hi = ev.agg(F.min("ts"), F.min("ts") + 48 * HOUR).first()
    part = EV.event_table(spark, "saved_events", lo, hi)
    assert part.count() == ev.where((F.col("ts") >= lo) & (F.col("ts") <= hi)).count() > 0
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(part) <= 12 < files(back)
    spark.sql("DROP TABLE saved_events")


def test_catalog(spark, tmp_path):
    put(tmp_path, "in/a.txt", FTRACE)
    put(tmp_path, "in/b.json", '{"traceEvents": []}')
    put(tmp_path, "in/c.csv", "a,b,c\n1,2,3\n")
    put(tmp_path, "in/d.txt", PERF)
    put(tmp_path, "in/e.bin", "PERFILE2xxxx")
    put(tmp_path, "in/f.txt", "hello")
    put(tmp_path, "in/g.txt", "app-12 [001] .... 1.0: func\n")
    put(tmp_path, "in/operator_detail_1.csv", "Op Name,Op Type,x\n")
    got = {r.file_path.rsplit("/", 1)[1]: r.format for r in files.trace_catalog(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": "ftrace", "b.json": "chrome", "c.csv": "csv", "d.txt": "perf", "e.bin": "perf_data", "f.txt": "unknown",
                   "g.txt": "ftrace", "operator_detail_1.csv": "op_csv"}


def test_cluster_sources(spark, tmp_path):
    head = "Step,Type,Index,Computing,Communication(Not Overlapped),Overlapped,Communication,Free,Stage,Bubble,Preparing\n"
    p = put(tmp_path, "c1.csv", head + "1,rank,0,10,1,2,3,4,17,0,0\n1,stage,0,9,9,9,9,9,9,9,9\n1,rank,1,bad,1,2,3,4,17,0,0\n")
    rows = sorted(read(spark, "cluster_csv", p).collect(), key=lambda r: r.rank)
    assert [(r.cluster_id, r.step, r.rank, r.computing, r.communication, r.stage) for r in rows] == [
        ("c1", "1", "0", 10.0, 3.0, 17.0), ("c1", "1", "1", 0.0, 3.0, 17.0)]
    old = spark.createDataFrame([("1", "0", 5.0, 2.0, 1.0, 9.0)], "step_id string, rank_id string, compute_time double, communication_time double, free_time double, stage_time double")
    from pyspark.sql import functions as F
    r = cluster.canonical_steps(old, F.lit("x")).collect()[0]
    assert (r.computing, r.communication, r.overlapped, r.stage) == (5.0, 2.0, 0.0, 9.0)
    g = read(spark, "groups", put(tmp_path, "g1.json", json.dumps({"collective": [[0, 1], [2]], "p2p": [[1, 3]]}))).collect()[0]
    assert sorted(g.ranks) == [0, 1, 2, 3]
    comm = {"(0,1)": {"1": {"hcom_a@g": {"rank_id": 0, "communication_time_info": {"wait_time_ms": 1.0, "transit_time_ms": 2.0}}, "Total Op Info@g": {"rank_id": 0}}}}
    r = read(spark, "comm_time", put(tmp_path, "ct.json", json.dumps(comm))).collect()
    assert [(x.op_name, x.elapsed, x.sync) for x in r] == [("hcom_a", 3.0, 0.0)]
    mat = {"(0,1)": {"s": {"all-top1@5": {"0-1": {"Transport Type": "HCCS", "Transit Time(ms)": 1.0, "Bandwidth(GB/s)": 9.5}, "x": {"Transport Type": "Q"}}}}}
    r = read(spark, "comm_matrix", put(tmp_path, "cmx.json", json.dumps(mat))).collect()
    assert [(x.src, x.dst, x.transport, x.bandwidth, x.size) for x in r] == [(0, 1, "HCCS", 9.5, 0.0)]


def test_profile_csv(spark, tmp_path):
    put(tmp_path, "rank0/kernel_details.csv", "Name,Type,Duration(us),Wait Time(us),Block Dim,Step Id\nk,,5.5,x,2,1\n")
    r = cluster.profile_csv(spark, str(tmp_path), "kernel_details").collect()[0]
    assert (r.name, r.kernel_type, r.duration, r.wait_time, r.block_dim) == ("k", None, 5.5, 0.0, 2)


def test_dump_repair_and_flatten(spark, tmp_path):
    put(tmp_path, "a.json", '{"system": {"page_size": 4096, "l": [1, {"x": null}]}, "env": {}}')
    put(tmp_path, "b.json", '{"system": {"page\\_size": 4096}, \n\n"env": []}')
    docs = read(spark, "dump", str(tmp_path))
    flat = {(r.dump_id, r.path): r.value for r in CF.json_flatten(docs, "doc", ["dump_id"]).collect()}
    assert flat == {("a", "system.page_size"): "4096", ("a", "system.l[0]"): "1", ("a", "system.l[1].x"): None, ("a", "env"): "{}",
                    ("b", "system.page_size"): "4096", ("b", "env"): "[]"}


def test_node_logs(spark, tmp_path):
    put(tmp_path, "n/BIOS/currentvalue.json", "{}")
    put(tmp_path, "n/BIOS/currentvalue.json.md5", "x")
    put(tmp_path, "n/CpuMem/npu_info", "abc")
    got = sorted((r.file_path.rsplit("/", 1)[1], r.domain) for r in files.node_logs(spark, str(tmp_path)).collect())
    assert got == [("currentvalue.json", "perf_config"), ("npu_info", "hardware"), ("npu_info", "perf_config")]


def test_sheet(spark, tmp_path):
    p = put(tmp_path, "s.csv", "Index,Base,Comp\n\tComputing,1,2\n,,\nE2E,inf,/\n")
    rows = [(r.i, r.b) for r in files.sheet_csv(spark, p, ["i", "b", "c"]).select("i", X.tolerant_double("b").alias("b")).collect()]
    assert ("E2E", float("inf")) in rows and len(rows) == 2


START = """INFO boot
INFO (APIServer pid=1) non-default args: {"model": "m", "max_model_len": 4096, "speculative_config": {"method": "eagle3"}}
INFO non-default args: {'max_model_len': 1}
"""
BROKEN = "INFO non-default args: {'max_num_seqs': 8, 'compilation_config': CompilationConfig(level=3), 'enable_x': True, 'quantization': 'w8'\n"


def test_launch_args(spark, tmp_path):
    put(tmp_path, "a.log", START)
    put(tmp_path, "b.log", BROKEN)
    got = {(r.log_id, r.key): (r.value, r.group) for r in LG.launch_args(read(spark, "log", str(tmp_path))).collect()}
    assert got[("a", "max_model_len")] == ("4096", "config")
    assert got[("b", "max_num_seqs")] == ("8", "config") and got[("b", "enable_x")] == ("True", "feature")
    assert got[("b", "quantization")] == ("w8", "quantization")
    assert ("a", "speculative_config") in got and ("b", "compilation_config") not in got


@pytest.mark.parametrize("text, want", [
    ("'a': 1, 'b': {'c': 2, 'd': {'e': [1, {'x': 2}], 'f': Config(level=3, x=(1, 2))}}, 'g': 'x, y'}",
     {"a": "1", "b.c": "2", "b.d.e": "[1, {'x': 2}]", "b.d.f": "Config(level=3, x=(1, 2))", "b.d": "{'e': [1, {'x': 2}], 'f': Config(level=3, x=(1, 2))}",
      "b": "{'c': 2, 'd': {'e': [1, {'x': 2}], 'f': Config(level=3, x=(1, 2))}}", "g": "'x, y'"}),
    ("'a': {'b': 1, 'c', 'd': <obj at 0x1>, 'e': [1, 2}, 'k': 'un", {"a.b": "1", "a.d": "<obj at 0x1>", "a.e": "[1, 2", "a": "{'b': 1, 'c', 'd': <obj at 0x1>, 'e': [1, 2}", "k": "'un"}),
    ("'x': {'y': {'z': ", {"x.y": "{'z':", "x": "{'y': {'z':"}), ("'q': 'it\\'s {', 'r': {}}, 'after': 1", {"q": "'it\\'s {'", "r": "{}"}), ("", {})])
def test_literal_pairs(text, want):
    assert dict(LG.literal_pairs(text)) == want


def test_launch_args_of_any_depth(spark, tmp_path):
    put(tmp_path, "a.log", "INFO non-default args: {" + "'enable_c': {" * 40 + "'max_num_seqs': 8" + "}" * 40 + ", 'model': 'm'}\n")
    got = {r.key: r.value for r in LG.launch_args(read(spark, "log", str(tmp_path))).collect()}
    assert len(got) == 42 and got[".".join(["enable_c"] * 40) + ".max_num_seqs"] == "8" and got["model"] == "m"


@pytest.mark.parametrize("text,want", [("", 0.0), ("/", 0.0), ("inf", float("inf")), ("-inf", 0.0), ("nan", 0.0), (" 2.5 ", 2.5), ("x", 0.0), (None, 0.0)])
def test_tolerant_double(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.tolerant_double("t")).collect()[0][0] == want


def test_sql_functions(spark):
    X.register_functions(spark)
    r = spark.sql("SELECT attribution_class('x', 'DataLoader') AS a, attribution_class('x', 'operation') AS b, shape_elements('2,3;4;;x') AS n").collect()[0]
    assert (r.a, r.b, r.n) == ("DATA_LOADER", "IO_WAIT", 10)


def test_json_flatten_has_no_depth_limit(spark):
    from pyspark.sql import functions as F

    from perfloom.operators.configdiff import json_flatten

    text = '{"a":' * 20 + '[1, "x]{"]' + "}" * 20
    df = spark.createDataFrame([(1, text), (2, "5")], "id int, t string").select("id", F.parse_json("t").alias("v"))
    got = {(r.id, r.path): r.value for r in json_flatten(df, "v", ["id"]).collect()}
    assert got == {(1, ".".join("a" * 20) + "[0]"): "1", (1, ".".join("a" * 20) + "[1]"): "x]{", (2, ""): "5"}


def test_json_flatten_of_texts_in_a_fixed_plan(spark):
    deep = '{"a":' * 5000 + '[1,{}]' + "}" * 5000
    rows = [(1, deep), (2, None), (3, '{"a": {"n": "x\\"y", "l": [1.50, {"x": "v"}, [], [[2]]]}, "e": {}, "": 5, "z": null, "ok": true}'), (4, "{}")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = CF.json_flatten(df, "t", ["id"])
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    have = {(r.id, r.path): r.value for r in got.collect()}
    path = ".".join("a" * 5000)
    assert have == {(1, path + "[0]"): "1", (1, path + "[1]"): "{}", (2, ""): None, (3, "a.n"): 'x"y', (3, "a.l[0]"): "1.50", (3, "a.l[1].x"): "v", (3, "a.l[2]"): "[]",
                    (3, "a.l[3][0][0]"): "2", (3, "e"): "{}", (3, ""): "5", (3, "z"): None, (3, "ok"): "true", (4, ""): "{}"}
    parents = {(r.path): r.value for r in CF.json_flatten(df.where("id = 3"), "t", ["id"], keep_parents=True).collect()}
    assert parents["a.l[3]"] == "[[2]]" and parents["a.l[3][0]"] == "[2]" and parents["e"] == "{}" and "" in parents


def test_node_logs_keep_whole_texts(spark, tmp_path):
    put(tmp_path, "networkinfo/ifconfig_info", "\n".join(f"line {i}" for i in range(30_000)))
    put(tmp_path, "OSDump/systemcom.tar.gz", "binary")
    rows = files.node_logs(spark, str(tmp_path))
    assert rows.count() == 30_000 and rows.where("file_path like '%.gz'").count() == 0
    last = rows.orderBy("seq").collect()[-1]
    assert last.value == "line 29999"
