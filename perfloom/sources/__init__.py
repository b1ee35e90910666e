"""Readers: each is ``(spark, path, ...) -> DataFrame``; add your own to ``SOURCES``."""

from perfloom.sources import cluster, events, files

SOURCES = {
    "chrome": events.chrome_trace, "ftrace": events.ftrace, "perf": events.perf_script, "jsonl": events.jsonl_events,
    "op_csv": events.operator_csv, "kernel_table": events.kernel_table, "step_json": events.step_trace_json,
    "cluster_csv": cluster.step_csv, "cluster_table": cluster.step_table, "comm_time": cluster.comm_time_json,
    "comm_matrix": cluster.comm_matrix_json, "groups": cluster.group_json, "log": files.log_lines,
    "dump": files.dump_json, "sheet": files.sheet_csv, "node_logs": files.node_logs,
}


def read(spark, kind: str, path: str, **options):
    return SOURCES[kind](spark, path, **options)
