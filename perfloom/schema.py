"""Canonical event table and its fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# Event phases and categories of the trace model.
PHASES = ("B", "E", "X", "I", "C", "M", "b", "e", "n", "s", "t", "f")
HOST_CATEGORIES = (
    "cpu_sched", "cpu_function", "memory", "io", "runtime", "data_loader", "python", "cuda_npu_api",
)
DEVICE_CATEGORIES = ("npu_kernel", "gpu_kernel", "npu_memcpy", "stream_sync")
OTHER_CATEGORIES = ("metadata", "unknown")

# -1 means "not applicable" for every integer id; times are integer microseconds.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("trace_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("dur", T.LongType()),
        T.StructField("pid", T.LongType()),
        T.StructField("tid", T.LongType()),
        T.StructField("cpu", T.LongType()),
        T.StructField("device_id", T.LongType()),
        T.StructField("stream_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("cat", T.StringType()),
        T.StructField("ph", T.StringType()),
        T.StructField("args", T.StringType()),
    ]
)

# Scheduler, copy, fault and block fields inside ``args`` that the operators read.
ARGS_FIELDS = T.StructType(
    [
        T.StructField("prev_pid", T.LongType()),
        T.StructField("next_pid", T.LongType()),
        T.StructField("prev_state", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("direction", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("fault_type", T.StringType()),
        T.StructField("dev", T.StringType()),
        T.StructField("rwbs", T.StringType()),
        T.StructField("sector", T.LongType()),
        T.StructField("sectors", T.LongType()),
    ]
)
