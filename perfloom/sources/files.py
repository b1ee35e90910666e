"""Line, dump, sheet and node-log readers, the landing-directory catalog, and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.configdiff import parse_json_tolerant

_LOW33 = (1 << 33) - 1


def file_id(path: Column) -> Column:
    """File name without folders and the last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def numbered_lines(spark: SparkSession, path: str, id_col: str = "trace_id", line_sep: str | None = None) -> DataFrame:
    """``id_col, seq, value`` of text files read in parallel splits.

    ``seq`` is the split's byte offset plus the row's number inside its task.  A split has fewer lines than bytes, so the
    numbers are unique and follow file order without a sort.
    """
    reader = spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))
    return reader.text(path).select(
        file_id(F.col("_metadata.file_path")).alias(id_col), (F.col("_metadata.file_block_start") + row).alias("seq"), "value")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path, "log_id")


def dump_json(spark: SparkSession, path: str) -> DataFrame:
    """``dump_id, doc`` (variant) of one-document files, repaired where needed; unreadable files give a null document."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(file_id(F.col("_metadata.file_path")).alias("dump_id"), parse_json_tolerant("value").alias("doc"))


def sheet_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Comparison sheet exported as CSV, columns named by position, blank rows dropped, text kept as it is."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, columns)])
    return named.dropna("all")


# Node-log domains and their path patterns.
NODE_DOMAINS = {
    "crash": ["**/OSDump/systemcom.tar*", "**/LogDump/fdm_output*", "**/sensor_alarm/current_event.txt",
              "**/sensor_alarm/sel.db*", "**/LogDump/dmesg_info*", "**/sysinfo/ps_info"],
    "hardware": ["**/CpuMem/cpu_info", "**/CpuMem/mem_info", "**/CpuMem/npu_info", "**/CpuMem/npu_ecc_info.json",
                 "**/LogDump/*dfx_reg_log*", "**/storage/SubhealthyStatus.db", "**/StorageMgnt/RAID_Controller_Info.txt",
                 "**/LogDump/PD_SMART_INFO_C*"],
    "network": ["**/NpuIO/optical_module_history_info_log.csv", "**/NpuIO/port_history_log.tar.gz",
                "**/networkinfo/ifconfig_info", "**/BMC/lldp_info.txt", "**/netcard/netcard_info.txt"],
    "thermal": ["**/cooling_app/fan_info.txt", "**/pram/env_web_view.dat", "**/pram/cpu_utilise_webview.dat",
                "**/BMC/psu_info.txt"],
    "perf_config": ["**/BIOS/currentvalue.json", "**/sysinfo/cmdline", "**/sysinfo/top_info", "**/sysinfo/meminfo",
                    "**/sysinfo/zoneinfo", "**/versioninfo/server_config.txt", "**/CpuMem/npu_info",
                    "**/driver_info/lsmod_info", "**/networkinfo/netstat_info"],
}
IGNORED_SUFFIXES = (".md5", ".sha256", ".bak")


def glob_regex(pattern: str) -> str:
    return re.escape(pattern).replace(r"\*\*/", "(.*/)?").replace(r"\*", "[^/]*") + "$"


BINARY_FILES = r"\.(tar(\.[a-z0-9]+)?|t?gz|zip|bz2|xz|zst|7z|db|sqlite3?|bin|pcap|core)(\.\d+)?$"


def log_domains(path: Column, domains: dict[str, list[str]] = NODE_DOMAINS) -> Column:
    """Array of the domains whose patterns a path matches; checksum and backup files match none."""
    hits = [F.when(path.rlike("|".join("^" + glob_regex(p) for p in ps)), d) for d, ps in domains.items()]
    ignored = path.rlike("(" + "|".join(re.escape(x) for x in IGNORED_SUFFIXES) + ")$")
    return F.when(ignored, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*hits)))


def node_logs(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """``file_path, domain, seq, value``: the lines of a node dump tree; archives and database files are no text and left out.

    Files are read in splits, so ``seq`` (place of the split, then of the line in it) orders a file's lines without one task
    holding the file. The tree is listed once; the test on the path picks files before any is opened, archives among them.
    """
    file = F.col("_metadata.file_path")
    raw = spark.read.option("recursiveFileLookup", True).text(path).where(~F.lower(file).rlike(BINARY_FILES) & (F.size(log_domains(file)) > 0))
    lines = raw.select(file.alias("file_path"), F.col("_metadata.file_block_start").alias("_at"), "value").withColumn("_row", F.monotonically_increasing_id())
    out = lines.select("file_path", F.explode(log_domains(F.col("file_path"))).alias("domain"), F.struct("_at", "_row").alias("seq"), "value")
    return out.where(F.col("domain") == domain) if domain else out


# ---------------------------------------------------------------- catalog

def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        heads = []
        for p in pdf["path"]:
            filesystem, inner = fs.FileSystem.from_uri(p)
            with filesystem.open_input_stream(inner) as f:
                head = f.read(4096)
                # a long comment header hides the first line that tells the format
                while head.lstrip()[:1] == b"#" and all(x.lstrip()[:1] in (b"#", b"") for x in head.split(b"\n")) and (more := f.read(65_536)):
                    head += more
                heads.append(head)
        yield pdf.assign(head=heads)


def classify_head(head: Column, path: Column) -> Column:
    """Format of a trace file from its first bytes and name; the first matching test wins."""
    text = F.decode(head, "UTF-8")
    left = F.ltrim(text)
    first = F.regexp_extract(text, r"^([^\n]*)", 1)
    body = F.regexp_replace(text, r"(?m)^\s*(#[^\n]*)?\n", "")      # without blank and comment lines
    top5 = F.regexp_extract(body, r"^((?:[^\n]*\n?){0,5})", 1)
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return X.first_match(
        (F.hex(F.substring(head, 1, 8)).startswith(F.hex(F.lit("PERFILE"))), "perf_data"),
        (name.contains("operator_detail") & name.endswith(".csv"), "op_csv"),
        (name.contains("step_trace") & name.endswith(".json"), "step_json"),
        (left.startswith("{") & name.endswith(".jsonl"), "jsonl"),
        (left.startswith("[") | left.startswith("{"), "chrome"),
        (first.contains("tracer:") | first.contains("entries-in-buffer"), "ftrace"),
        (top5.rlike(r"sched_switch|sched_wakeup|==>|(?m)^\s*\S*-\d+\s+\S+\s+\S+\s+\S+"), "ftrace"),
        (F.length(first) - F.length(F.replace(first, F.lit(","), F.lit(""))) >= 2, "csv"),
        (F.regexp_extract(left, r"^([^\n]*)", 1).rlike("CPU:|cpu:"), "perf"),
        default="unknown",
    )


def trace_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, file_size, format`` of a landing tree.

    The listing reads no contents; tasks then read each file up to its first line that is no comment.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    heads = listing.mapInPandas(_heads, "path string, length bigint, head binary")
    return heads.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                        classify_head(F.col("head"), F.col("path")).alias("format"))


def directory_kinds(paths: DataFrame, path_col: str = "file_path", database_word: str = "profiler") -> DataFrame:
    """(directory, kind): ``profiler`` where a directory directly holds a timeline view, an operator detail table, a step trace
    or a database file with ``database_word`` in its name, else ``unknown``."""
    p = F.lower(path_col)
    name = F.element_at(F.split(p, "/"), -1)
    hit = name.contains("trace_view") | (name.contains("operator_detail") & name.endswith(".csv")) | name.contains("step_trace") | (
        name.endswith(".db") & name.contains(database_word.lower()))
    folder = F.regexp_replace(path_col, "/[^/]*$", "")
    return paths.groupBy(folder.alias("directory")).agg(F.when(F.bool_or(hit), "profiler").otherwise("unknown").alias("kind"))


# ---------------------------------------------------------------- sinks

def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """JSON, CSV (with header) or Parquet; nested columns go to CSV as JSON text."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
