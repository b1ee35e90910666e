"""Trace readers.  All return the canonical event columns; parsing is column expressions over split text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.events import locate_from_args, normalize
from perfloom.shared import ship
from perfloom.sources.documents import batches_of, by_split, joined_parts, json_objects
from perfloom.sources.files import file_id, numbered_lines

_NUM = r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?"


def _whole(text: Column) -> Column:
    """int(float(text)), null when it is no number."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").cast("bigint"))


def chrome_trace(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """``{"traceEvents": [...]}`` or ``[...]``.

    ``document`` takes JSON laid out in any way, ``lines`` is quicker for one event per line; both read large files by many tasks.
    Items that are no objects, or whose numbers do not parse, are dropped.
    """
    if layout == "lines":
        lines = numbered_lines(spark, path)
        body = F.regexp_replace(F.trim("value"), r"^[\[,]+\s*|\s*[,\]]+$", "")
        body = F.regexp_replace(body, r'^\{\s*"traceEvents"\s*:\s*\[\s*', "")
        items = lines.select("trace_id", "seq", F.try_parse_json(body).alias("e"))
    else:
        found = json_objects(spark, path, [(), ("traceEvents",)])
        items = found.select(file_id(F.col("file")).alias("trace_id"), "seq", F.try_parse_json("text").alias("e"))
    items = items.where(F.col("e").isNotNull() & F.schema_of_variant("e").startswith("OBJECT"))
    text = {n: F.try_variant_get("e", f"$.{n}", "string") for n in ("ts", "dur", "pid", "tid", "name", "cat", "ph")}
    fields = items.select(
        "trace_id", "seq", *[c.alias(n) for n, c in text.items()],
        F.coalesce(F.to_json(F.try_variant_get("e", "$.args", "variant")), F.lit("{}")).alias("args"))
    good = F.lit(True)
    for n in ("ts", "dur"):
        good = good & (F.col(n).isNull() | _whole(F.col(n)).isNotNull())
    named = fields.where(good).withColumn("args", F.when(F.col("args").startswith("{"), F.col("args")).otherwise("{}"))
    return locate_from_args(normalize(named))


# ---------------------------------------------------------------- ftrace

# task-pid [cpu] flags seconds: event: fields; a task name may hold blanks
_LINE = r"^\s*(.*?\S)\s+\[(\d+)\]\s+(\S+)\s+(\d[\d.]*):\s*(.*)$"


def _field(text: Column, name: str) -> Column:
    """Value of ``name=``: up to the next ``key=``, an arrow or the end, so it may hold blanks; null where there is none."""
    c = F.regexp_extract(text, rf"(?:^|\s){name}=(.*?)\s*(?=$|==>|\s\w+=)", 1)
    return F.nullif(c, F.lit(""))


def _number(text: Column, name: str) -> Column:
    return _field(text, name).try_cast("long")


def ftrace(spark: SparkSession, path: str, extended: bool = True) -> DataFrame:
    """Kernel trace text.  Scheduler lines become ``cpu_sched`` events with their fields in ``args``; with ``extended``
    NUMA and block lines keep their fields too; everything else is a function event.  Scheduler lines whose fields do not
    parse and lines that are no events are dropped."""
    return _ftrace_events(numbered_lines(spark, path), extended)


def _ftrace_events(lines: DataFrame, extended: bool) -> DataFrame:
    def part(i):
        return F.regexp_extract("value", _LINE, i)

    p = lines.where(F.col("value").rlike(_LINE)).select(
        "trace_id", "seq", part(1).alias("tp"), part(2).try_cast("long").alias("cpu"), X.to_us(part(4)).alias("ts"),
        part(5).alias("content"))
    p = p.withColumns({"kind": F.regexp_extract("content", r"^([\w:]+):", 1),
                       "data": F.trim(F.regexp_replace("content", r"^[\w:]+:\s*", ""))})
    kind, data = F.col("kind"), F.col("data")
    is_switch, is_wake = kind == "sched_switch", kind.isin("sched_wakeup", "sched_wakeup_new", "sched_waking")
    is_numa, is_block = kind.startswith("numa_") & F.lit(extended), kind.startswith("block_rq_") & F.lit(extended)

    def fields(texts: Sequence[str], numbers: Sequence[str]) -> list[Column]:
        return [_field(data, n).alias(n) for n in texts] + [_number(data, n).alias(n) for n in numbers]

    switch_args = F.struct(*fields(["prev_comm", "next_comm", "prev_state"], ["prev_pid", "prev_prio", "next_pid", "next_prio"]))
    wake_args = F.struct(*fields(["comm"], ["pid", "prio", "target_cpu"]), F.col("cpu").alias("woken_on_cpu"))
    numa_args = F.struct(_number(data, "pid").alias("numa_pid"), _number(data, "cpu").alias("numa_cpu"), *fields([], ["nid", "preferred_node"]))
    # block lines have no names: device and kind lead, the sector and its count stand around a plus sign
    words, sides = F.split(data, r"\s+"), F.split(data, r"\s*\+\s*", 2)
    block_args = F.struct(
        F.get(words, F.lit(0)).alias("dev"), F.get(words, F.lit(1)).alias("rwbs"),
        F.regexp_substr(F.get(sides, F.lit(0)), F.lit(r"\d+$")).try_cast("long").alias("sector"),
        F.regexp_substr(F.get(sides, F.lit(1)), F.lit(r"^\d+")).try_cast("long").alias("sectors"))
    task, tpid = X.task_name("tp"), X.task_pid("tp")
    pid = X.first_match((is_switch, _number(data, "prev_pid")), (is_wake, _number(data, "pid")), default=tpid)
    out = p.where(
        ~(is_switch & (_number(data, "prev_pid").isNull() | _number(data, "next_pid").isNull()))
        & ~(is_wake & (_number(data, "pid").isNull() | _number(data, "target_cpu").isNull())) & (F.trim("content") != ""))
    known = is_switch | is_wake | is_numa | is_block
    args = X.first_match(
        (is_switch, F.to_json(switch_args)), (is_wake, F.to_json(wake_args)), (is_numa, F.to_json(numa_args)),
        (is_block, F.to_json(block_args)), default=F.to_json(F.struct(task.alias("task"))))
    return normalize(out.select(
        "trace_id", "seq", "ts", F.lit(0).alias("dur"), pid.alias("pid"), pid.alias("tid"), "cpu",
        F.when(known, kind).otherwise(F.trim("content")).alias("name"),
        X.first_match((is_switch | is_wake, "cpu_sched"), (is_numa, "memory"), (is_block, "io"), default="cpu_function").alias("cat"),
        F.lit("I").alias("ph"), args.alias("args")))


def ftrace_header(spark: SparkSession, path: str) -> DataFrame:
    """Tracer name, buffer entries and cpu count from the comment lines."""
    h = numbered_lines(spark, path).where(F.col("value").startswith("#"))

    def fact(pattern, i=1):
        return F.max(F.nullif(F.regexp_extract("value", pattern, i), F.lit("")))

    entries = r"^#\s*entries-in-buffer/entries-written:\s*(\d+)/(\d+)"
    return h.groupBy("trace_id").agg(
        fact(r"^#\s*tracer:\s*(\S+)").alias("tracer"), fact(entries, 1).cast("long").alias("entries_in_buffer"),
        fact(entries, 2).cast("long").alias("entries_written"), fact(r"#\s*P:(\d+)").cast("long").alias("cpu_count"))


# ---------------------------------------------------------------- perf script

def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _rest(text: Column, mark: str, n: int = 1) -> Column:
    """What follows the ``n``-th ``mark``."""
    return F.substring(text, F.length(F.substring_index(text, mark, n)) + len(mark) + 1, F.length(text))


def is_sample_head(line: str) -> bool:
    """``task pid seconds CPU:n`` without indent."""
    left, mark, right = line.partition("CPU:")
    words = left.split()
    if not mark or line[0].isspace() or len(words) < 3 or not right.lstrip()[:1].isdigit() or not words[-2].isdigit():
        return False
    return words[-1].replace(".", "", 1).isdigit()


class _Samples:
    """Lines of a split put together to samples: a head, then the lines up to a blank one or the next head."""

    def __init__(self, file: str, block: int, _state):
        self.file, self.block, self.seq, self.lines, self.open = file, block, None, [], True

    def add(self, seq: int, line: str) -> Iterator[tuple]:
        if is_sample_head(line):
            yield from self._row(True)
            self.seq, self.lines, self.open = seq, [line], True
        elif not line.strip():
            yield from self._row(True)
            self.open = False
        elif self.open:
            self.lines.append(line)

    def end(self) -> Iterator[tuple]:
        yield from self._row(not self.open)

    def _row(self, ends: bool) -> Iterator[tuple]:
        # a split's first lines may belong to a head before it, even if there are none but the blank line that ends the sample
        if self.open:
            yield self.file, self.block, self.seq, "".join(x + "\n" for x in self.lines), ends
        self.seq, self.lines, self.open = None, [], False


def perf_script(spark: SparkSession, path: str) -> DataFrame:
    """Samples: a head line, indented frames; a blank line or the next head ends a sample.

    Files are read in splits, with line ends of either kind; samples on both sides of a split's end are put together. ``seq`` is
    the place of the head line.
    """
    ship(spark)
    m = F.col("_metadata")
    lines = spark.read.text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("block"), "value", F.lit("").alias("state"),
        (m["file_block_length"] < m["file_size"]).alias("split"))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("ends", pa.bool_())])

    def samples(df: DataFrame) -> DataFrame:
        return df.select("file", "block", "value", "state").mapInArrow(
            lambda batches: batches_of(by_split(batches, _Samples), schema), "file string, block long, seq long, text string, ends boolean")

    whole = samples(lines).where("seq is not null and ends")
    # the last sample of a file ends with it
    last = samples(lines.where("not split")).where("seq is not null and not ends")
    parts = joined_parts(samples(lines.where("split")).where("seq is null or not ends")).where("seq is not null")
    found = whole.select("file", "seq", "text").union(last.select("file", "seq", "text")).union(parts.select("file", "seq", "text"))
    return _perf_events(found.select(file_id(F.col("file")).alias("trace_id"), "seq", F.col("text").alias("value")))


def _perf_events(samples: DataFrame) -> DataFrame:
    """``trace_id, seq, value``, one sample each; others are dropped."""
    lines = F.split("value", r"\r?\n")
    head, words = F.col("_l")[0], F.col("_w")
    s = samples.select("trace_id", "seq", lines.alias("_l")).withColumn("_w", _words(F.substring_index(head, "CPU:", 1)))

    def frame(line: Column) -> Column:
        text = F.regexp_replace(line, r"^\s+|\s+$", "")
        module = F.substring_index(text, "(", -1)
        name = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(module) - 1))
        return F.when(line.rlike(r"^\s") & text.endswith(")") & (name != "") & (F.length(module) > 1) & (F.length(module) < F.length(text)),
                      F.concat(name, F.lit(" ("), F.trim(F.substring(module, F.lit(1), F.length(module) - 1)), F.lit(")")))

    size = F.size(words)
    s = s.where((size >= 3) & head.contains("CPU:") & ~head.rlike(r"^\s")).select(
        "trace_id", "seq", F.get(words, size - 2).alias("pid"), F.get(words, size - 1).alias("sec"),
        F.array_join(F.slice(words, F.lit(1), size - 2), " ").alias("comm"), F.regexp_substr(F.ltrim(_rest(head, "CPU:")), F.lit(r"^\d+")).alias("cpu"),
        F.array_compact(F.transform(F.slice("_l", F.lit(2), F.size("_l")), frame)).alias("frames"))
    s = s.where(F.col("pid").try_cast("long").isNotNull() & F.col("sec").try_cast("double").isNotNull() & F.col("cpu").isNotNull())
    return normalize(s.select(
        "trace_id", "seq", X.to_us("sec").alias("ts"), F.lit(0).alias("dur"), "pid", F.col("pid").alias("tid"), "cpu",
        F.when(F.size("frames") > 0, F.trim(F.substring_index(F.col("frames")[0], " (", 1))).otherwise(F.col("comm")).alias("name"),
        F.lit("cpu_function").alias("cat"), F.lit("I").alias("ph"),
        F.to_json(F.struct("comm", F.col("frames").alias("callstack"), F.size("frames").alias("stack_depth"))).alias("args")))


def perf_lines(spark: SparkSession, path: str) -> DataFrame:
    """One-line variant ``comm pid/tid [cpu] sec: subsystem:event: text``; other lines are read as ftrace."""
    return _perf_line_events(numbered_lines(spark, path))


def _perf_line_events(lines: DataFrame) -> DataFrame:
    before, after = F.substring_index("value", "]", 1), _rest(F.col("value"), "]")
    words = _words(F.substring(before, F.lit(1), F.length(before) - F.length(F.substring_index(before, "[", -1)) - 1))
    ids, tail = F.get(words, F.size(words) - 1), F.trim(_rest(after, ":"))
    named = lines.withColumns({
        "_cpu": F.substring_index(before, "[", -1), "_pid": F.substring_index(ids, "/", 1), "_tid": F.substring_index(ids, "/", -1),
        "_sec": F.trim(F.substring_index(after, ":", 1)), "_event": F.substring_index(tail, ":", 2),
        "_task": F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " "), "_raw": F.ltrim(_rest(tail, ":", 2)),
        "_is": ids.contains("/") & (F.size(F.split(tail, ":")) > 2)})
    numbers = F.lit(True)
    for c in ("_cpu", "_pid", "_tid"):
        numbers = numbers & F.col(c).try_cast("long").isNotNull()
    hit = F.coalesce(F.col("_is") & numbers & F.col("_sec").contains(".") & F.col("_sec").try_cast("double").isNotNull()
                     & (F.col("_task") != "") & F.col("_event").rlike(r"^\w+:\w+$"), F.lit(False))
    named = named.withColumn("_is", hit)
    found = named.where("_is").select(
        "trace_id", "seq", X.to_us("_sec").alias("ts"), F.lit(0).alias("dur"), F.col("_pid").alias("pid"), F.col("_tid").alias("tid"),
        F.col("_cpu").alias("cpu"), F.col("_event").alias("name"), F.lit("cpu_function").alias("cat"), F.lit("I").alias("ph"),
        F.to_json(F.struct(F.col("_task").alias("task"), F.col("_raw").alias("raw"))).alias("args"))
    return normalize(found).unionByName(_ftrace_events(named.where("not _is").select(*lines.columns), True))


def jsonl_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; ``name`` or ``type``, ``ts`` or ``timestamp``.  Lines that do not parse are dropped."""
    return _jsonl_events(numbered_lines(spark, path))


def _jsonl_events(lines: DataFrame) -> DataFrame:
    e = lines.where(F.trim("value").startswith("{")).select("trace_id", "seq", F.try_parse_json(F.trim("value")).alias("e")).where("e is not null")

    def t(n):
        return F.try_variant_get("e", f"$.{n}", "string")

    return normalize(e.select(
        "trace_id", "seq", F.coalesce(t("name"), t("type"), F.lit("unknown")).alias("name"),
        F.coalesce(t("ts"), t("timestamp"), F.lit("0")).alias("ts"), t("dur").alias("dur"), F.coalesce(t("cat"), F.lit("")).alias("cat"),
        F.coalesce(t("pid"), F.lit("0")).alias("pid"), F.coalesce(t("tid"), F.lit("0")).alias("tid"), t("cpu").alias("cpu"),
        F.coalesce(F.to_json(F.try_variant_get("e", "$.args", "variant")), F.lit("{}")).alias("args")))


# ---------------------------------------------------------------- profiler tables

# Event field -> header words, tried in order against every header (substring, any case).
_WORDS = {
    "name": ("Op Name", "Name", "op_name", "kernel_name"), "op_type": ("Op Type", "Type", "op_type", "kernel_type"),
    "ts": ("Start Time", "ts", "start", "start_time"), "dur": ("Duration", "dur", "duration", "elapsed"),
    "device_id": ("Device ID", "device", "Device"), "stream_id": ("Stream ID", "stream", "Stream"),
    "pid": ("PID", "pid", "Process"), "tid": ("TID", "tid", "Thread"),
    "input_shapes": ("Input", "Shape", "input_shapes"), "output_shapes": ("Output", "output_shapes"),
}


def resolve_headers(headers: Sequence[str], words=_WORDS) -> dict[str, str]:
    """Event field -> header, first word first, first header first."""
    found = {}
    for field, keys in words.items():
        for k in keys:
            hit = next((h for h in headers if k.lower() in h.lower()), None)
            if hit:
                found[field] = hit
                break
    return found


def table_events(df: DataFrame, trace_id: Column, seq: Column, process_ids: bool = True) -> DataFrame:
    """Profiler rows with free header names to events; rows with a number that does not parse are dropped."""
    headers = resolve_headers(df.columns)
    defaults = {"ts": "0", "dur": "0", "device_id": "-1", "stream_id": "-1", "pid": "-1", "tid": "-1"}

    def text(field, default=""):
        if field not in headers or (field in ("pid", "tid") and not process_ids):
            return F.lit(default)
        c = F.col(f"`{headers[field]}`").cast("string")
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))

    nums = {f: _whole(F.trim(text(f, d))) for f, d in defaults.items()}
    good = F.lit(True)
    for c in nums.values():
        good = good & c.isNotNull()
    rows = df.where(good)
    return normalize(rows.select(
        trace_id.alias("trace_id"), seq.alias("seq"), *[c.alias(f) for f, c in nums.items()], text("name").alias("name"),
        X.device_category(text("op_type"), text("name")).alias("cat"), F.lit("X").alias("ph"),
        F.to_json(F.struct(text("op_type").alias("op_type"), text("input_shapes").alias("input_shapes"),
                           text("output_shapes").alias("output_shapes"))).alias("args")))


def operator_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path).withColumns(
        {"_file": file_id(F.col("_metadata.file_path")),
         "_seq": F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    return table_events(df, F.col("_file"), F.col("_seq"))


def kernel_table(spark: SparkSession, path: str, fmt: str = "parquet", trace_id: str | None = None) -> DataFrame:
    """Kernel rows of database exports, each file a trace unless ``trace_id`` names one for all; process ids are not read."""
    df = spark.read.option("header", True).format(fmt).load(path).withColumns(
        {"_file": file_id(F.col("_metadata.file_path")) if trace_id is None else F.lit(trace_id), "_seq": F.monotonically_increasing_id()})
    return table_events(df, F.col("_file"), F.col("_seq"), process_ids=False)


def step_events(steps: DataFrame, keys: Sequence[str] = ("trace_id",)) -> DataFrame:
    """Step rows to one ``Step#id`` span and up to three phase marks each.

    Columns: keys, ``seq, step_id, start_time, end_time, forward_start, backward_start, optimizer_start``.
    """
    end = F.coalesce("end_time", "start_time")
    dur = F.greatest(F.lit(0).cast("long"), end - F.col("start_time"))

    def mark(name, ts, length, ph):
        return F.struct(name.alias("name"), ts.cast("long").alias("ts"), length.cast("long").alias("dur"), F.lit(ph).alias("ph"))

    marks = F.array(
        mark(F.concat(F.lit("Step#"), F.col("step_id").cast("string")), F.coalesce("start_time", F.lit(0)), F.coalesce(dur, F.lit(0)), "X"),
        *[mark(F.lit(n), F.col(c), F.lit(0), "I") for n, c in
          (("Forward", "forward_start"), ("Backward", "backward_start"), ("Optimizer", "optimizer_start"))])
    return steps.select(*keys, "seq", "step_id", F.inline(marks)).where("ts is not null").withColumn("cat", F.lit("runtime"))


def step_trace_json(spark: SparkSession, path: str) -> DataFrame:
    """Step records of a root array, or of ``steps`` or else ``traceEvents`` of a root object; ``steps`` with records wins."""
    first = json_objects(spark, path, [(), ("steps",)])
    other = json_objects(spark, path, [("traceEvents",)]).join(first.select("file").distinct(), "file", "left_anti")
    items = first.union(other).select(file_id(F.col("file")).alias("trace_id"), "seq", F.try_parse_json("text").alias("e")).where("e is not null")

    def n(*names):
        return F.coalesce(*[_whole(F.try_variant_get("e", f"$.{x}", "string")) for x in names])

    steps = items.select(
        "trace_id", "seq", F.coalesce(n("step_id", "iteration"), F.lit(-1)).alias("step_id"),
        F.coalesce(n("start_time", "ts"), F.lit(0)).alias("start_time"), n("end_time").alias("end_time"),
        *[n(c).alias(c) for c in ("forward_start", "backward_start", "optimizer_start")])
    ev = step_events(steps)
    return normalize(ev.withColumns({"pid": F.lit(0), "tid": F.lit(0),
                                     "args": F.to_json(F.struct("step_id"))}))
