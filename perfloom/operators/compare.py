"""Base-versus-comparison profile diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.sequence import same_keys, top_k


def compare(base: DataFrame, comp: DataFrame, on: Sequence[str], measures: Sequence[str], how: str = "full",
            top_n: int | None = None, rank_by: str | None = None) -> DataFrame:
    """Join two profiles on ``on``: ``base_*, comp_*, diff_*, ratio_*`` per measure, a missing side as 0."""
    a = base.select(*on, *[F.col(m).alias(f"base_{m}") for m in measures])
    b = comp.select(*[F.col(k).alias(f"_c_{k}") for k in on], *[F.col(m).alias(f"comp_{m}") for m in measures])
    j = a.join(b, same_keys(a, b, [(k, f"_c_{k}") for k in on]), how)
    out = j.select(*[F.coalesce(F.col(k), F.col(f"_c_{k}")).alias(k) for k in on], *_changes(measures))
    if top_n:
        out = out.orderBy(F.desc(F.abs(f"diff_{rank_by or measures[0]}")), *on).limit(top_n)
    return out


def _changes(measures: Sequence[str]) -> list[Column]:
    """Both sides, their difference and ratio per measure; a missing side counts as 0."""
    cols = []
    for m in measures:
        x, y = F.coalesce(f"base_{m}", F.lit(0)), F.coalesce(f"comp_{m}", F.lit(0))
        cols += [x.alias(f"base_{m}"), y.alias(f"comp_{m}"), (y - x).alias(f"diff_{m}"), X.ratio(x, y).alias(f"ratio_{m}")]
    return cols


def compare_rows(rows: DataFrame, is_base: Column, on: Sequence[str], value: str = "duration",
                 measures: Sequence[str] = ("total", "avg", "max", "min", "calls")) -> DataFrame:
    """``compare`` of the profiles of two sides of one frame, by one conditional aggregate: one scan, one shuffle."""
    aggs = []
    for side, test in (("base", is_base), ("comp", ~is_base)):
        v = F.when(test, F.col(value))
        of = {"total": F.sum(v), "avg": F.avg(v), "max": F.max(v), "min": F.min(v), "calls": F.count(F.when(test, F.lit(1)))}
        aggs += [of[m].alias(f"{side}_{m}") for m in measures]
    return rows.groupBy(*on).agg(*aggs).select(*on, *_changes(measures))


def profile(rows: DataFrame, by: Sequence[str], value: str = "duration") -> DataFrame:
    """Total, mean, extreme values and calls of one side."""
    return rows.groupBy(*by).agg(
        F.sum(value).alias("total"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.count(F.lit(1)).alias("calls"))


def stat_totals(rows: DataFrame, diff: str = "diff_total", K: Sequence[str] = (), top_n: int = 10) -> DataFrame:
    """Degraded and improved counts and sums, trend, and how much of the change the largest rows hold."""
    d = F.col(diff)
    K = list(K)
    if not K:
        rows, K = rows.withColumn("_all", F.lit(0)), ["_all"]
    # the first rows by map-side limited rank; their sum and the totals are two small aggregates
    top = top_k(rows, K, [F.desc(diff)], top_n).groupBy(*K).agg(F.sum(diff).alias("_top"))
    agg = rows.groupBy(*K).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(d > 0).alias("degraded_count"),
        F.count_if(d < 0).alias("improved_count"), F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0)).alias("total_degraded"),
        F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0)).alias("total_improved"), F.sum(d).alias("total_diff"))
    out = agg.unionByName(top, allowMissingColumns=True).groupBy(*K).agg(*[F.max(c).alias(c) for c in [*agg.columns[len(K):], "_top"]]).drop("_all")
    conc = F.when(F.col("total_diff") == 0, 0.0).otherwise(F.try_divide(F.abs("_top"), F.abs("total_diff")) * 100)
    trend = F.when(F.col("total_degraded") > F.col("total_improved"), "degraded").when(
        F.col("total_improved") > F.col("total_degraded"), "improved").otherwise("flat")
    return out.withColumns({"net_trend": trend, "concentration": conc, "is_concentrated": conc > 80}).drop("_top")


def detail_for(detail: DataFrame, names: DataFrame, base_col: str = "base_name", comp_col: str = "comp_name") -> DataFrame:
    """Detail rows whose base or comparison name is among ``names`` (one ``name`` column, e.g. a top-10 list)."""
    n = names.select(F.col("name").alias("_n")).distinct()
    base = n.select(F.col("_n").alias("_b"))
    found = detail.join(base, F.col(base_col) == F.col("_b"), "left").join(n, F.col(comp_col) == F.col("_n"), "left")
    return found.where(F.col("_b").isNotNull() | F.col("_n").isNotNull()).drop("_b", "_n")


def topk_signed(rows: DataFrame, diff: str, tie: str, K: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Largest improvements and degradations, ``k`` each."""
    side = F.when(F.col(diff) < 0, "improved").when(F.col(diff) > 0, "degraded")
    rows = rows.withColumn("side", side).where("side is not null")
    return top_k(rows, [*K, "side"], [F.desc(F.abs(diff)), F.asc(tie)], k)


def kernel_degradation(base_calls: str, comp_calls: str, avg_ratio: str) -> Column:
    calls = F.col(base_calls) != F.col(comp_calls)
    slow = F.col(avg_ratio) > 1.05
    return X.first_match((calls & slow, "duration_and_calls"), (calls, "calls"), (slow, "single_duration"), default="slight")


def api_degradation(calls_ratio: str, self_ratio: str, diff: str) -> Column:
    calls, slow = F.col(calls_ratio) > 1.05, F.col(self_ratio) > 1.05
    return X.first_match((calls & slow, "self_and_calls"), (calls, "calls"), (slow, "self_duration"),
                         (F.col(diff) > 0, "slight_degradation"), default="slight")


def kernel_compare(rows: DataFrame) -> DataFrame:
    """Kernel rows (``kernel, shape`` plus both sides) with shape size, communication flag and degradation type."""
    return rows.withColumns({
        "elements": X.shape_elements("shape"), "is_comm": F.col("kernel").startswith("hcom_"),
        "is_empty_shape": F.coalesce(F.trim("shape"), F.lit("")) == "",
        "degradation_type": kernel_degradation("base_calls", "comp_calls", "ratio_avg"),
        "significant": (F.col("base_total") > 0) & (F.col("comp_total") > 0) & (F.col("diff_total") > 0)
        & (F.col("ratio_total") > 1.05) & (F.col("ratio_total") != float("inf"))})


def load_imbalance(rows: DataFrame) -> DataFrame:
    """Compute kernels called over 10 times whose longest call is over twice the shortest."""
    r = F.try_divide(F.col("comp_max").cast("double"), F.col("comp_min").cast("double"))
    out = rows.where("comp_calls > 10 and comp_max > 0 and comp_min > 0").withColumn("variance_ratio", r)
    grade = F.when(r > 5, "severe").when(r > 3, "significant").otherwise("slight")
    return out.withColumn("imbalance", grade).where("variance_ratio > 2.0")


def multi_shape(rows: DataFrame, name: str = "kernel") -> DataFrame:
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("shapes")).where("shapes > 1")


def data_volume(rows: DataFrame) -> DataFrame:
    """Elements, calls and time moved on each side over the compute kernels."""
    work = rows.where("NOT is_comm AND NOT is_empty_shape")
    return work.agg(
        *[F.sum(F.col("elements") * F.col(f"{s}_calls")).alias(f"{s}_elements") for s in ("base", "comp")],
        *[F.sum(f"{s}_{m}").alias(f"{s}_{m}") for s in ("base", "comp") for m in ("calls", "total")])


def level_distribution(rows: DataFrame, level: str, diff: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(diff).alias("sum_diff")] if diff else [])
    return rows.groupBy(level).agg(*aggs)


def kernel_type_compare(rows: DataFrame, top_n: int = 10) -> DataFrame:
    """Both sides by kernel type and core type, largest change first."""
    agg = rows.groupBy("kernel_type", "core_type").agg(
        F.sum("base_total").alias("base_total"), F.sum("comp_total").alias("comp_total"),
        (F.sum("comp_total") - F.sum("base_total")).alias("diff_total"))
    return agg.orderBy(F.desc(F.abs("diff_total")), "kernel_type", "core_type").limit(top_n)


def memory_compare(rows: DataFrame, K: Sequence[str] = ()) -> DataFrame:
    """Growth and shrink counts and the total change; all zero when no side used any memory."""
    d = F.col("diff_memory")
    some = F.bool_or((F.col("base_memory") != 0) | (F.col("comp_memory") != 0))
    return rows.groupBy(*K).agg(
        (~some).alias("all_zero"), F.count(F.lit(1)).alias("operators"),
        F.when(some, F.count_if(d > 0)).otherwise(0).alias("increased"),
        F.when(some, F.count_if(d < 0)).otherwise(0).alias("decreased"),
        F.when(some, F.sum(d)).otherwise(0).alias("total_diff"))


def extreme_improvement(ratio: str, base: str) -> Column:
    return (F.col(ratio) < 0.1) & (F.col(base) > 1000)


def dimension_share(metrics: DataFrame, K: Sequence[str] = ()) -> DataFrame:
    """Computing, uncovered communication and free time: each degraded dimension's share of all degradation.

    ``metrics`` has ``index, base_duration, comp_duration, diff_duration``; the first row (by ``seq``) naming a dimension
    is used.
    """
    # Dimension -> row label.
    dims = {"compute": "computing time", "communication": "uncovered communication time", "schedule": "free time"}
    low = F.lower("index")
    pick = [F.min_by(F.when(low.contains(t), F.struct("base_duration", "comp_duration", "diff_duration")),
                     F.when(low.contains(t), F.col("seq"))).alias(n) for n, t in dims.items()]
    one = metrics.groupBy(*K).agg(*pick)
    pos = [F.greatest(F.coalesce(F.col(f"{n}.diff_duration"), F.lit(0)), F.lit(0)) for n in dims]
    rows = [F.struct(F.lit(n).alias("dimension"), F.col(f"{n}.base_duration").alias("base_duration"),
                     F.col(f"{n}.comp_duration").alias("comp_duration"), F.col(f"{n}.diff_duration").alias("diff_duration"))
            for n in dims]
    out = one.withColumn("_deg", sum(pos[1:], pos[0])).select(*K, "_deg", F.inline(F.array(*rows))).where("diff_duration is not null")
    share = F.when(F.col("diff_duration") > 0, F.try_divide(F.col("diff_duration").cast("double"), F.col("_deg").cast("double")) * 100)
    trend = F.when(F.col("diff_duration") > 0, "degraded").when(F.col("diff_duration") < 0, "improved").otherwise("flat")
    return out.select(*K, "dimension", "base_duration", "comp_duration", "diff_duration",
                      share.alias("contribution_pct"), trend.alias("trend"))


def primary_dimensions(shares: DataFrame, K: Sequence[str] = ()) -> DataFrame:
    """The dimension that improved most and the one that degraded most; null where none did."""
    d = F.col("diff_duration")
    return shares.groupBy(*K).agg(
        F.min_by(F.when(d < 0, F.col("dimension")), F.when(d < 0, F.struct(d, F.col("dimension")))).alias("primary_improved"),
        F.min_by(F.when(d > 0, F.col("dimension")), F.when(d > 0, F.struct(-d, F.col("dimension")))).alias("primary_degraded"))


def sub_metrics(metrics: DataFrame, index: str = "index") -> DataFrame:
    """Rows indented by exactly one tab."""
    return metrics.where(F.col(index).rlike(r"^\t[^\t]")).withColumn(index, F.trim(F.regexp_replace(index, "^\t", "")))


def row_kind(rows: DataFrame, label: str) -> DataFrame:
    """Kind of a statistic row: grand total, task row, summary or detail."""
    c = F.trim(F.coalesce(F.col(label), F.lit("")))
    return rows.withColumn("row_kind", F.when(c == "[ TOTAL ]", "total").when(c.startswith("|"), "task").when(
        c == "", "summary").otherwise("detail"))


def compare_overall(a_steps: DataFrame, b_steps: DataFrame) -> DataFrame:
    """Step means of two ranks for the five overall rows, with each row's share of the stage time.

    Inputs are step tables with ``step, stage, computing, communication, overlapped, free``.
    """
    names = {"stage": "E2E Time (Stage)", "computing": "Computing Time", "communication": "Communication Time",
             "overlapped": "Overlapped Time", "free": "Free Time"}
    both = a_steps.select("step", *names, F.lit("a").alias("_s")).unionByName(b_steps.select("step", *names, F.lit("b").alias("_s")))
    per = both.groupBy("_s", "step").agg(*[F.avg(c).alias(c) for c in names])
    m = per.agg(*[F.coalesce(F.avg(F.when(F.col("_s") == s, F.col(c))), F.lit(0.0)).alias(f"{s}_{c}")
                  for s in ("a", "b") for c in names],
                *[F.count_if(F.col("_s") == s).alias(f"{s}_n") for s in ("a", "b")])
    rows = []
    for i, (c, label) in enumerate(names.items()):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        rows.append(F.struct(
            F.lit(label).alias("metric"), a.alias("base"), X.safe_div(a, "a_stage").alias("base_share"),
            F.col("a_n").alias("base_steps"), b.alias("comp"), X.safe_div(b, "b_stage").alias("comp_share"),
            F.col("b_n").alias("comp_steps"), (b - a).alias("diff"), X.ratio(a, b).alias("ratio")))
    return m.select(F.inline(F.array(*rows)))


def compare_summary(**sheets: DataFrame) -> DataFrame:
    """Counts and sums of improvements and risks of several compare frames (``diff_*`` in ``diff_total``)."""
    out = None
    for name, df in sheets.items():
        d = F.col("diff_total")
        one = df.agg(F.lit(name).alias("sheet"), F.count_if(d < 0).alias("improvements"), F.count_if(d > 0).alias("risks"),
                     F.coalesce(F.sum(d), F.lit(0)).cast("double").alias("net_diff"))
        out = one if out is None else out.unionByName(one)
    return out


def module_compare(stat: DataFrame, detail: DataFrame, top_n: int = 10) -> DataFrame:
    """Detail rows of the modules with the largest totals, each with its module's rank."""
    top = stat.where("row_kind = 'total'").orderBy(F.desc("diff_total"), "module").limit(top_n)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("diff_total"), "module")    # at most top_n rows
    ranked = top.select("module", F.row_number().over(w).cast("long").alias("module_rank"), "diff_total")
    return detail.join(ranked.drop("diff_total"), "module")


def degraded_with_stack(rows: DataFrame, top_n: int = 5, order: Sequence[str] = ("module_rank", "seq")) -> DataFrame:
    """The first slower module rows that have a call stack on either side."""
    has = (F.coalesce(F.trim("base_call_stack"), F.lit("")) != "") | (F.coalesce(F.trim("comp_call_stack"), F.lit("")) != "")
    return rows.where((F.col("diff_self_time") > 0) & has).orderBy(*order).limit(top_n)
