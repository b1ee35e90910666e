"""Cluster step timings and communication statistics.

The canonical step table is ``cluster_id, step, rank, computing, communication, overlapped, free, stage`` (microseconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.sequence import same_keys, top_k

CK = ("cluster_id",)
MEASURES = {"avg_compute": "computing", "avg_comm": "communication", "avg_free": "free", "avg_stage": "stage",
            "avg_overlap": "overlapped"}
LOCAL_TRANSPORTS = ("LOCAL", "HCCS")


def _means() -> list:
    return [F.avg(c).alias(n) for n, c in MEASURES.items()]


def step_summary(st: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    return st.groupBy(*K, "step").agg(*_means())


def rank_summary(st: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    return st.groupBy(*K, "rank").agg(*_means())


def step_and_rank_summary(st: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    """Both summaries in one scan: rows with a null ``rank`` are per step, rows with a null ``step`` per rank."""
    by = [F.col(k) for k in K]
    return st.groupingSets([[*by, F.col("step")], [*by, F.col("rank")]], *by, F.col("step"), F.col("rank")).agg(*_means())


def cluster_ratios(st: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    """Means over the per-step means, and shares of the stage time in percent."""
    m = step_summary(st, K).groupBy(*K).agg(*[F.avg(c).alias(c) for c in MEASURES])
    total = F.when(F.col("avg_stage") > 0, F.col("avg_stage")).otherwise(1.0)
    return m.withColumns({f"{n}_ratio": X.safe_div(f"avg_{n}", total) * 100 for n in ("compute", "comm", "free")})


def rank_step_heatmap(st: DataFrame, K: Sequence[str] = CK, measure: str = "stage", tol: float = 0.10) -> DataFrame:
    """Dense rank x step cells graded against the cluster mean; a missing cell is 0.

    Each step keeps one map of its ranks, limited by the size of the cluster, and is laid over the cluster's rank list; no
    rows of ranks and steps are paired in a join.
    """
    K = list(K)
    cells = st.groupBy(*K, "rank", "step").agg(F.max(measure).alias("_v"))
    per_step = cells.groupBy(*K, "step").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_m"))
    mean = step_summary(st, K).groupBy(*K).agg(F.avg("avg_stage").alias("_mean"))
    ranks = cells.groupBy(*K).agg(F.sort_array(F.collect_set("rank")).alias("_ranks"))
    out = per_step.join(mean.join(ranks, K), K).select(*K, "step", "_m", "_mean", F.explode("_ranks").alias("rank"))
    v = F.coalesce(F.try_element_at("_m", F.col("rank")), F.lit(0.0))
    r = F.when(F.col("_mean") > 0, X.safe_div(v, "_mean")).otherwise(1.0)
    return out.select(*K, "rank", "step", v.alias("value"),
                      F.when(r > 1 + tol, "high").when(r < 1 - tol, "low").otherwise("mid").alias("level"))


def slow_ranks(st: DataFrame, K: Sequence[str] = CK, tol: float = 0.10) -> DataFrame:
    """Deviation of each rank's mean stage from the cluster mean (mean of step means), in percent."""
    K = list(K)
    base = step_summary(st, K).groupBy(*K).agg(F.avg("avg_stage").alias("_mean"))
    out = rank_summary(st, K).join(base, K)
    dev = F.when(F.col("_mean") > 0, X.safe_div(F.col("avg_stage") - F.col("_mean"), "_mean") * 100).otherwise(0.0)
    return out.select(*K, "rank", "avg_stage", dev.alias("deviation_pct"),
                      F.when(dev > tol * 100, "slow").when(dev < -tol * 100, "fast").otherwise("normal").alias("flag"))


def cluster_advice(st: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    """Advice flags: comm > 50 %, free > 20 %, a rank off by > 10 %, compute > 70 %."""
    K = list(K)
    dev = slow_ranks(st, K).groupBy(*K).agg(F.max(F.abs("deviation_pct")).alias("_dev"), F.count(F.lit(1)).alias("_n"))
    out = cluster_ratios(st, K).join(dev, K)
    flags = F.array_compact(F.array(
        F.when(F.col("comm_ratio") > 50, "communication_bound"), F.when(F.col("free_ratio") > 20, "idle_time"),
        F.when((F.col("_n") > 1) & (F.col("_dev") > 10), "slow_rank"), F.when(F.col("compute_ratio") > 70, "compute_bound")))
    return out.select(*K, F.when(F.size(flags) == 0, F.array(F.lit("healthy"))).otherwise(flags).alias("advice"))


def ab_contribution(st: DataFrame, a: str, b: str, cluster_col: str = "cluster_id") -> DataFrame:
    """Change of stage time from cluster ``a`` to ``b`` and each part's share of it.

    Both sides are conditional aggregates over one scan; the parts are then listed from the single result row.
    """
    m = step_summary(st.where(F.col(cluster_col).isin(a, b)), [cluster_col]).groupBy().agg(
        *[F.coalesce(F.avg(F.when(F.col(cluster_col) == s, F.col(c))), F.lit(0.0)).alias(f"{t}_{c}")
          for s, t in ((a, "a"), (b, "b")) for c in ("avg_stage", "avg_compute", "avg_comm", "avg_free")])
    d_stage = F.col("b_avg_stage") - F.col("a_avg_stage")
    rows = []
    for n in ("stage", "compute", "comm", "free"):
        va, vb = F.col(f"a_avg_{n}"), F.col(f"b_avg_{n}")
        rows.append(F.struct(F.lit(n).alias("metric"), va.alias("a"), vb.alias("b"), (vb - va).alias("delta"),
                             (X.safe_div(vb - va, d_stage) * 100).alias("contribution_pct")))
    pct = X.safe_div(d_stage, "a_avg_stage") * 100
    grade = F.when(pct > 10, "severe").when(pct > 5, "moderate").when(pct > 0, "slight").otherwise("improved")
    return m.select(F.inline(F.array(*rows)), grade.alias("grade"))


def bandwidth_drop(a: DataFrame, b: DataFrame, key: str = "transport", value: str = "avg_bandwidth",
                   limit: float = -10.0) -> DataFrame:
    left = a.select(F.col(key), F.col(value).alias("a"))
    right = b.select(F.col(key), F.col(value).alias("b"))
    out = left.join(right, key).withColumn("change_pct", X.safe_div(F.col("b") - F.col("a"), "a") * 100)
    return out.withColumn("dropped", F.col("change_pct") < limit)


def rank_diff(st: DataFrame, a: str, b: str, key: str = "rank", measure: str = "stage",
              cluster_col: str = "cluster_id") -> DataFrame:
    """Per rank (or step) mean on both sides; a side without the key counts 0.  Same rows as a full outer join of the two
    summaries, from one conditional aggregate."""
    both = st.where(F.col(cluster_col).isin(a, b)).groupBy(key).agg(
        *[F.coalesce(F.avg(F.when(F.col(cluster_col) == s, F.col(measure))), F.lit(0.0)).alias(n)
          for s, n in ((a, "a"), (b, "b"))])
    diff = F.col("b") - F.col("a")
    return both.select(
        key, "a", "b", diff.alias("diff"), F.when(F.col("a") == 0, 0.0).otherwise(X.safe_div(diff, "a") * 100).alias("pct"),
        F.when(diff > 0, "slower").when(diff < 0, "faster").otherwise("same").alias("trend"))


# ---------------------------------------------------------------- communication

def comm_op_top(comm: DataFrame, K: Sequence[str] = CK, top_n: int = 20) -> DataFrame:
    cols = [c for c in ("elapsed", "transit", "wait", "sync", "idle") if c in comm.columns]
    means = comm.groupBy(*K, "op_name").agg(*[F.avg(c).alias(f"avg_{c}") for c in cols])
    return top_k(means, K, [F.desc("avg_elapsed"), F.asc("op_name")], top_n)


def comm_op_diff(comm: DataFrame, a: str, b: str, top_n: int = 10, scale_a: float = 1.0, scale_b: float = 1.0,
                 cluster_col: str = "cluster_id") -> DataFrame:
    """Mean elapsed per operation on both sides after bringing both to one unit, largest change first."""
    side = F.col(cluster_col)
    m = comm.where(side.isin(a, b)).groupBy("op_name").agg(
        F.coalesce(F.avg(F.when(side == a, F.col("elapsed"))) * scale_a, F.lit(0.0)).alias("a"),
        F.coalesce(F.avg(F.when(side == b, F.col("elapsed"))) * scale_b, F.lit(0.0)).alias("b"))
    return m.withColumn("diff", F.col("b") - F.col("a")).orderBy(F.desc(F.abs("diff")), "op_name").limit(top_n)


def transport_bw(bw: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    return bw.groupBy(*K, "transport").agg(
        F.avg("bandwidth").alias("avg_bandwidth"), F.avg("size").alias("avg_size"), F.avg("time").alias("avg_time"))


def comm_matrix(bw: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    return bw.groupBy(*K, "src", "dst", "transport").agg(
        F.avg("bandwidth").alias("avg_bandwidth"), F.avg("size").alias("avg_size"))


def comm_matrix_top(bw: DataFrame, top_n: int = 50, ties: Sequence[str] = ()) -> DataFrame:
    """Raw link records with the highest bandwidth."""
    return bw.orderBy(F.desc("bandwidth"), "src", "dst", "transport", "op_name", *ties).limit(top_n)


def transport_locality(bw: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    where = F.when(F.col("transport").isin(*LOCAL_TRANSPORTS), "intra_node").when(
        F.col("transport") == "RDMA", "inter_node").otherwise("other")
    return bw.groupBy(*K, where.alias("locality")).agg(
        F.avg("bandwidth").alias("avg_bandwidth"), F.avg("time").alias("avg_time"),
        F.max_by("op_name", F.struct("time", "op_name")).alias("slowest_op"))


def rank_host_count(ranks: DataFrame, K: Sequence[str] = CK, approx: bool = False) -> DataFrame:
    n = F.approx_count_distinct if approx else F.count_distinct
    return ranks.groupBy(*K).agg(n("rank").alias("rank_count"), n("host").alias("host_count"))


def rank_set(groups: DataFrame, steps: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    """Ranks named in the group mapping (``ranks`` array); for clusters without any, the ranks of the step table."""
    K = list(K)
    named = groups.select(*K, F.explode("ranks").alias("rank")).distinct().withColumn("origin", F.lit("groups"))
    known = named.select(*[F.col(k).alias(f"_g_{k}") for k in K]).distinct()
    seen = steps.select(*K, "rank").distinct()
    fallback = seen.join(known, same_keys(seen, known, [(k, f"_g_{k}") for k in K]), "left_anti")
    return named.unionByName(fallback.withColumn("origin", F.lit("steps")))


# ---------------------------------------------------------------- single-rank profile tables

def kernel_type_stats(kernels: DataFrame, K: Sequence[str] = CK) -> DataFrame:
    return kernels.groupBy(*K, F.coalesce(F.col("kernel_type"), F.lit("N/A")).alias("kernel_type")).agg(
        F.sum("duration").alias("total_dur"), F.count(F.lit(1)).alias("count"), F.avg("duration").alias("avg_dur"))


def api_by_level(api: DataFrame, K: Sequence[str] = CK, top_n: int = 20) -> DataFrame:
    """Top APIs of each level by time."""
    agg = api.groupBy(*K, "level", "api_name").agg(F.sum("time").alias("total_time"), F.sum("count").alias("calls"))
    return top_k(agg, [*K, "level"], [F.desc("total_time"), F.asc("api_name")], top_n)


def is_comm_op(name: str = "name", cat: str | None = "cat"):
    """Communication rows: by the start of the name, or by a category that has ``comm`` in it."""
    c = F.col(name)
    by_name = c.like("HCom%") | c.like("hcom%")
    return by_name if cat is None else by_name | F.coalesce(F.col(cat).like("%comm%"), F.lit(False))


def copy_engine_totals(rows: DataFrame, K: Sequence[str] = CK, name: str = "name", engine: str = "SDMA") -> DataFrame:
    """Count and time of the rows of the copy engine."""
    return rows.where(F.col(name) == engine).groupBy(*K).agg(F.count(F.lit(1)).alias("count"), F.sum("duration").alias("total_dur"))


def comm_ops(rows: DataFrame, K: Sequence[str] = CK, name: str = "name", cat: str | None = "cat") -> DataFrame:
    return rows.where(is_comm_op(name, cat)).groupBy(*K, name).agg(
        F.sum("duration").alias("total_dur"), F.count(F.lit(1)).alias("count"))


def task_join_topk(tasks: DataFrame, compute: DataFrame, on: str, K: Sequence[str] = CK, top_n: int = 20) -> DataFrame:
    """Longest tasks with their operator name and type."""
    j = tasks.join(compute, on).withColumn("duration", F.col("end_ns") - F.col("start_ns"))
    return top_k(j, K, [F.desc("duration"), F.asc(on), F.asc("start_ns")], top_n)


def source_fill(preferred: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``preferred`` plus those of ``other`` whose key it lacks."""
    return preferred.unionByName(other.join(preferred.select(*keys).distinct(), list(keys), "left_anti"))


def numeric_sort(ids: DataFrame, col: str, K: Sequence[str] = CK) -> DataFrame:
    """Distinct text ids with their position in numeric order; text that is no number sorts as 999."""
    rank = F.row_number().over(Window.partitionBy(*K).orderBy(X.numeric_order(col), col))
    return ids.select(*K, col).distinct().withColumn("position", rank.cast("long"))
