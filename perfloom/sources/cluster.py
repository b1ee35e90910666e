"""Readers of cluster step tables, group mappings, communication documents and single-rank profile CSVs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfloom.sources.documents import json_objects
from perfloom.sources.files import file_id

# Canonical column -> names in text, old-table and new-table exports.
STEP_COLUMNS = {
    "step": ("Step", "step", "step_id"), "rank": ("Index", "index", "rank_id"),
    "computing": ("Computing", "computing", "compute_time"),
    "communication_not_overlapped": ("Communication(Not Overlapped)", "communication_not_overlapped", "pure_communication_time"),
    "overlapped": ("Overlapped", "overlapped", "overlap_communication_time"),
    "communication": ("Communication", "communication", "communication_time"),
    "free": ("Free", "free", "free_time"), "stage": ("Stage", "stage", "stage_time"),
    "bubble": ("Bubble", "bubble", "bubble_time"), "preparing": ("Preparing", "preparing"),
}


def canonical_steps(df: DataFrame, cluster_id: Column) -> DataFrame:
    """Rank rows of any known step-table version under one set of names; a missing measure is 0."""
    by_lower = {c.lower(): c for c in df.columns}
    kind = by_lower.get("type")
    if kind:
        df = df.where(F.lower(F.col(f"`{kind}`")) == "rank")
    cols = [cluster_id.alias("cluster_id")]
    for name, aliases in STEP_COLUMNS.items():
        hit = next((by_lower[a.lower()] for a in aliases if a.lower() in by_lower), None)
        if name in ("step", "rank"):
            cols.append((F.col(f"`{hit}`") if hit else F.lit(None)).cast("string").alias(name))
        else:
            value = F.col(f"`{hit}`").try_cast("double") if hit else F.lit(0.0)
            cols.append(F.coalesce(value, F.lit(0.0)).alias(name))
    return df.select(*cols)


def step_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path).withColumn("_file", file_id(F.col("_metadata.file_path")))
    return canonical_steps(df, F.col("_file")).drop("_file")


def step_table(spark: SparkSession, path: str, fmt: str = "parquet", cluster_id: str | None = None) -> DataFrame:
    """Step rows of database exports, each file a cluster unless ``cluster_id`` names one for all."""
    df = spark.read.option("header", True).format(fmt).load(path)
    df = df.withColumn("_file", file_id(F.col("_metadata.file_path")) if cluster_id is None else F.lit(cluster_id))
    return canonical_steps(df, F.col("_file")).drop("_file")


def _documents(spark: SparkSession, path: str, schema: str, col: str = "doc") -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(file_id(F.col("_metadata.file_path")).alias("cluster_id"), F.from_json("value", schema).alias(col))


def group_json(spark: SparkSession, path: str) -> DataFrame:
    """``cluster_id, ranks`` of a parallel-group mapping; both kinds of groups are joined."""
    doc = _documents(spark, path, "struct<collective:array<array<int>>, p2p:array<array<int>>>")
    empty = F.array().cast("array<array<int>>")
    both = F.concat(F.coalesce("doc.collective", empty), F.coalesce("doc.p2p", empty))
    return doc.select("cluster_id", F.array_distinct(F.flatten(both)).alias("ranks"))


TIMES = "struct<rank_id:int, communication_time_info:struct<wait_time_ms:double, transit_time_ms:double, synchronization_time_ms:double>>"
LINK = "struct<`Transport Type`:string, `Transit Time(ms)`:double, `Transit Size(MB)`:double, `Op Name`:string, `Bandwidth(GB/s)`:double>"
LINKS = f"map<string, {LINK}>"


def _operations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """group -> step -> operation of documents of any size: one row per operation, read by many tasks."""
    found = json_objects(spark, path, [(None, None)], kind="{")
    return _named(found.select(
        file_id(F.col("file")).alias("cluster_id"), F.col("keys")[0].alias("group"), F.col("keys")[1].alias("step"),
        F.col("keys")[2].alias("_op"), F.from_json("text", schema).alias("info")))


def _named(ops: DataFrame) -> DataFrame:
    """The operation name before '@', without the totals."""
    return ops.withColumn("op_name", F.substring_index("_op", "@", 1)).where(~F.lower("op_name").startswith("total")).drop("_op")


def _levels(df: DataFrame, keys: list[str]) -> DataFrame:
    """group -> step -> operation of nested maps: three explodes."""
    return _named(
        df.select(*keys, F.explode("doc").alias("group", "_s"))
        .select(*keys, "group", F.explode("_s").alias("step", "_o"))
        .select(*keys, "group", "step", F.explode("_o").alias("_op", "info")))


def comm_time_rows(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows (milliseconds) of nested communication-time documents; elapsed = transit + wait + synchronisation."""
    keys = keys or ["cluster_id"]
    return _times(_levels(docs, keys), keys)


def _times(ops: DataFrame, keys: list[str]) -> DataFrame:
    t = ops.where("info.communication_time_info is not null")
    z = {n: F.coalesce(F.col(f"info.communication_time_info.{f}"), F.lit(0.0)) for n, f in
         (("transit", "transit_time_ms"), ("wait", "wait_time_ms"), ("sync", "synchronization_time_ms"))}
    return t.select(*keys, "group", "step", "op_name", F.col("info.rank_id").alias("rank"),
                    (z["transit"] + z["wait"] + z["sync"]).alias("elapsed"), *[c.alias(n) for n, c in z.items()])


def comm_matrix_rows(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per link of nested matrix documents; pairs that are not ``int-int`` are dropped."""
    keys = keys or ["cluster_id"]
    return _links(_levels(docs, keys), keys)


def _links(ops: DataFrame, keys: list[str]) -> DataFrame:
    links = ops.select(*keys, "group", "step", "op_name", F.explode("info").alias("_pair", "_l"))
    src, dst = (F.regexp_extract("_pair", r"^\s*(\d+)\s*-\s*(\d+)\s*$", i).try_cast("long") for i in (1, 2))

    def n(name):
        return F.coalesce(F.col("_l").getField(name), F.lit(0.0))

    return links.where("_l is not null").select(
        *keys, "group", "step", "op_name", src.alias("src"), dst.alias("dst"),
        F.coalesce(F.col("_l").getField("Transport Type"), F.lit("UNKNOWN")).alias("transport"),
        n("Transit Time(ms)").alias("time"), n("Transit Size(MB)").alias("size"), n("Bandwidth(GB/s)").alias("bandwidth"),
    ).where("src is not null and dst is not null")


def comm_time_json(spark: SparkSession, path: str) -> DataFrame:
    return _times(_operations(spark, path, TIMES), ["cluster_id"])


def comm_matrix_json(spark: SparkSession, path: str) -> DataFrame:
    return _links(_operations(spark, path, LINKS), ["cluster_id"])


# Profile CSV -> (output column, header, type).
PROFILE_CSVS = {
    "step_trace_time": (("step", "Step", "string"), ("computing", "Computing", "double"),
                        ("communication", "Communication", "double"), ("free", "Free", "double"), ("stage", "Stage", "double"),
                        ("overlapped", "Overlapped", "double")),
    "kernel_details": (("name", "Name", "string"), ("kernel_type", "Type", "string"), ("duration", "Duration(us)", "double"),
                       ("wait_time", "Wait Time(us)", "double"), ("block_dim", "Block Dim", "int"), ("step_id", "Step Id", "string")),
    "operator_details": (("name", "Name", "string"), ("host_dur", "Host Total Duration(us)", "double"),
                         ("device_dur", "Device Total Duration(us)", "double"),
                         ("device_self_dur", "Device Self Duration(us)", "double"), ("input_shapes", "Input Shapes", "string")),
    "api_statistic": (("level", "Level", "string"), ("api_name", "API Name", "string"), ("time", "Time(us)", "double"),
                      ("count", "Count", "int"), ("avg_time", "Avg(us)", "double"), ("min_time", "Min(us)", "double"),
                      ("max_time", "Max(us)", "double")),
    "op_summary": (("op_name", "Op Name", "string"), ("op_type", "OP Type", "string"), ("task_type", "Task Type", "string"),
                   ("duration", "Task Duration(us)", "double"), ("wait_time", "Task Wait Time(us)", "double"),
                   ("block_dim", "Block Dim", "int")),
}


def profile_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One profile CSV kind of many ranks; bad or missing numbers are 0, missing text is null."""
    df = spark.read.option("header", True).option("pathGlobFilter", f"{kind}*.csv").option("recursiveFileLookup", True).csv(path)
    cols = []
    for out, header, dtype in PROFILE_CSVS[kind]:
        c = F.col(f"`{header}`") if header in df.columns else F.lit(None).cast("string")
        if dtype == "double":
            c = F.coalesce(c.try_cast("double"), F.lit(0.0))
        elif dtype == "int":
            c = F.coalesce(c.try_cast("double").cast("long"), F.lit(0).cast("long"))
        cols.append(c.alias(out))
    return df.select(F.col("_metadata.file_path").alias("file_path"), *cols)
