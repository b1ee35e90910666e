"""Rule sets as data, compiled to columns over one wide metric row per trace.

Rules and cases are small driver-side files; each becomes one expression, and all of them are evaluated in a single
projection followed by ``inline``.  There is no join between traces and rules.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators.events import K

RESOURCES = Path(__file__).resolve().parent.parent / "resources"
ATTRIBUTIONS = ("CPU_SCHED", "DATA_LOADER", "MEMCPY", "LAUNCH_GAP", "IO_WAIT", "RUNTIME_BLOCK", "OTHER")
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CATEGORY_ORDER = ("host_npu", "cpu", "sched", "memory", "io", "runtime")

# Temporal pattern -> the series it inspects.
PATTERN_SERIES = {
    "runqueue_spike_during_npu_idle": "runqueue", "sched_latency_spike": "sched_latency",
    "cpu_util_imbalance": "cpu_util", "h2d_memcpy_blocking": "h2d_bandwidth", "d2h_memcpy_blocking": "d2h_bandwidth",
    "launch_gap_pattern": "launch_gap", "io_wait_blocking": "io_wait", "sync_wait_pattern": "sync_wait",
    "ctx_switch_burst": "ctx_switch", "cpu_balance_drift": "cpu_balance",
}
# Metric weights of the case distance.
CASE_WEIGHTS = {"cpu_util_avg": 1.0, "runqueue_avg": 1.0, "ctx_switch_rate": 0.5, "sched_latency_avg_us": 0.5,
                "h2d_bandwidth_mbs": 0.8, "launch_avg_gap_us": 0.8, "correlation_score": 1.0}
# Metric -> (limit, bad side).
EVIDENCE_LIMITS = {
    "cpu_util_avg": (90.0, "high"), "cpu_util_max": (95.0, "high"), "cpu_idle_avg": (50.0, "high"),
    "runqueue_avg": (4.0, "high"), "runqueue_max": (16.0, "high"), "ctx_switch_rate": (30000.0, "high"),
    "sched_latency_avg_us": (5000.0, "high"), "sched_latency_p99_us": (10000.0, "high"),
    "sched_latency_max_us": (50000.0, "high"), "cpu_balance_score": (0.5, "low"),
    "h2d_bandwidth_mbs": (500.0, "low"), "d2h_bandwidth_mbs": (500.0, "low"),
    "memcpy_total_us": (500000.0, "high"), "launch_avg_gap_us": (500.0, "high"),
}


def load(name: str, *extra_files: str) -> list[dict]:
    """Shipped rules or cases plus user files; the first definition of an id wins, incomplete rules are dropped."""
    seen: dict[str, dict] = {}
    for path in [RESOURCES / f"{name}.json", *map(Path, extra_files)]:
        for item in json.loads(path.read_text(encoding="utf-8")):
            key = item.get("rule_id") or item.get("case_id")
            if key and item.get("severity") and item.get("diagnosis"):
                seen.setdefault(key, item)
    return list(seen.values())


def widen(long: DataFrame, metrics: Sequence[str], K: Sequence[str] = K, name: str = "metric", value: str = "value",
          prefix: str = "") -> DataFrame:
    """Long (metric, value) rows to one row per key, for the named metrics only."""
    return long.groupBy(*K).agg(*[F.max(F.when(F.col(name) == m, F.col(value))).alias(prefix + m) for m in metrics])


def feature_row(scalars: DataFrame, attribution: DataFrame, correlation: DataFrame, K: Sequence[str] = K,
                spikes: DataFrame | None = None) -> DataFrame:
    """Wide scalars joined with ``attr_*`` shares, ``correlation_score`` and ``spike_*`` flags."""
    K = list(K)
    out = scalars.join(widen(attribution, ATTRIBUTIONS, K, "attribution", "ratio", "attr_"), K, "left")
    out = out.join(correlation.select(*K, F.col("score").alias("correlation_score")), K, "left")
    if spikes is not None:
        series = sorted(set(PATTERN_SERIES.values()))
        out = out.join(widen(spikes, series, K, "metric", "spike", "spike_"), K, "left")
    return out


def _has(df_columns: Sequence[str], name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df_columns else F.lit(None).cast(kind)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_col(columns: Sequence[str], name: str, kind: str = "DOUBLE") -> str:
    return f"CAST(`{name}` AS {kind})" if name in columns else f"CAST(NULL AS {kind})"


def _inline(rows: Sequence[str]) -> Column:
    """One generator over all rules.  The rows are SQL text, so a rule set reaches the optimizer in one parse."""
    return F.expr(f"inline(array({', '.join(rows)}))")


def _head(rule: dict) -> str:
    return (f"{_text(rule['rule_id'])} AS rule_id, {_text(rule['category'])} AS category, {_text(rule['severity'])} AS severity, "
            f"{_text(rule['diagnosis'])} AS diagnosis")


def weighted_rules(features: DataFrame, rules: Sequence[dict] | None = None, K: Sequence[str] = K,
                   default_threshold: float = 0.6, strict: bool = False) -> DataFrame:
    """Weighted evidence per (trace, rule): hit weight over known weight.

    A missing scalar takes its weight out of the total; temporal and correlation weights always count.  Weights are added
    as whole thousandths, so a score exactly on its threshold is matched.  ``strict`` never fires temporal patterns.
    """
    rules = load("rules_weighted") if rules is None else rules
    cols = features.columns
    ops = {"gt": "{} > {}", "lt": "{} < {}", "ge": "{} >= {}", "le": "{} <= {}", "eq": "abs({} - {}) < 1e-9D"}
    attr = {a: f"coalesce({_sql_col(cols, 'attr_' + a)}, 0D)" for a in ATTRIBUTIONS}
    seen = " OR ".join(f"{_sql_col(cols, 'attr_' + a)} IS NOT NULL" for a in ATTRIBUTIONS)
    special = {"attribution_sum": f"CASE WHEN {seen} THEN {' + '.join(attr.values())} END"}

    rows = []
    for r in rules:
        total, hit = [], []

        def count(weight: float, known: str, fired: str) -> None:
            w = round(weight * 1000)
            if w > 0:
                total.append(f"IF({known}, {w}, 0)")
                hit.append(f"IF(coalesce({fired}, false), {w}, 0)")

        for key, op, value, w in r.get("scalars", []):
            if op in ops:
                v = special.get(key) or _sql_col(cols, key)
                limit = f"coalesce({_sql_col(cols, 'cpu_cores')}, 0D)" if value == "auto" else f"{float(value)!r}D"
                count(w, f"({v}) IS NOT NULL", ops[op].format(f"({v})", limit))
        for pattern, w in r.get("temporal", []):
            spike = _sql_col(cols, f"spike_{PATTERN_SERIES.get(pattern, pattern)}", "BOOLEAN")
            count(w, "true", "false" if strict else spike)
        for name, min_ratio, w in r.get("correlation", []):
            count(w, "true", f"{attr.get(name, '0D')} >= {float(min_ratio)!r}D")
        t, h = (f"({' + '.join(x) or '0'})" for x in (total, hit))
        limit = round(r.get("threshold", default_threshold) * 1000)
        rows.append(f"struct({_head(r)}, CASE WHEN {t} > 0 THEN try_divide(CAST({h} AS DOUBLE), CAST({t} AS DOUBLE)) ELSE 0D END "
                    f"AS confidence, {h} * 1000 >= {t} * {limit} AND ({t} > 0 OR {limit} <= 0) AS matched)")
    return features.select(*K, _inline(rows)).select(
        *K, "rule_id", "category", "severity", "confidence", "matched", "diagnosis")


# ---------------------------------------------------------------- boolean trees

def _truth(cols: Sequence[str], cond, scale: dict[str, float]) -> str:
    """SQL text of a condition tree; anything unknown is false."""
    if isinstance(cond, dict):
        if "not" in cond:
            return f"NOT {_truth(cols, cond['not'], scale)}"
        word = "and" if "and" in cond else "or"
        return "(" + f" {word} ".join(_truth(cols, c, scale) for c in cond[word]) + ")"
    metric, op, value = cond
    have = _sql_col(cols, metric)
    if op in ("in", "not_in"):
        return f"coalesce({have} {'NOT IN' if op == 'not_in' else 'IN'} ({', '.join(repr(v) for v in value)}), false)"
    if op not in (">", ">=", "<", "<=", "==", "!="):
        return "false"
    limit = _operand(cols, value)
    if metric in scale:
        limit = f"{limit} * {scale[metric]!r}D"
    return f"coalesce({have} {op} {limit}, false)"


def _operand(cols: Sequence[str], value) -> str:
    return _sql_col(cols, value["ref"]) if isinstance(value, dict) else f"{float(value)!r}D"


def _margins(cols: Sequence[str], cond) -> list[str]:
    """Relative distances to the simple thresholds of a tree; ``not`` branches have none."""
    if isinstance(cond, dict):
        return [m for k in ("and", "or") for c in cond.get(k, []) for m in _margins(cols, c)]
    metric, op, value = cond
    have, limit = _sql_col(cols, metric), _operand(cols, value)
    if op not in (">", ">=", "<", "<="):
        return []
    gap = f"{limit} - {have}" if op in (">", ">=") else f"{have} - {limit}"
    return [f"CASE WHEN {have} IS NOT NULL AND {limit} <> 0 THEN greatest(try_divide({gap}, {limit}), 0D) END"]


def _margin(cols: Sequence[str], cond) -> str:
    parts = _margins(cols, cond)
    return f"least({', '.join(parts)})" if len(parts) > 1 else (parts[0] if parts else "CAST(NULL AS DOUBLE)")


def _applies(rule: dict, workload: str) -> bool:
    if workload in rule.get("exclude", []):
        return False
    match = rule.get("match", "all")
    return match == "all" or workload == "unknown" or workload == match


def _for_workload(rule: dict, adjust: bool):
    """Condition and threshold factors of a rule; ``adjust_to`` replaces a simple threshold."""
    cond, scale = rule["condition"], rule.get("adjust", {}) if adjust else {}
    if adjust and isinstance(cond, list) and cond[0] in rule.get("adjust_to", {}):
        cond = [cond[0], cond[1], rule["adjust_to"][cond[0]]]
    return cond, scale


def boolean_rules(metrics: DataFrame, rules: Sequence[dict] | None = None, K: Sequence[str] = K,
                  workload: str = "unknown", adjust: bool = False) -> DataFrame:
    """Per (trace, rule): whether its tree holds, its near-miss margin and the evidence as JSON.

    A missing metric makes a simple condition false.  ``adjust`` applies the rules' workload factors to their thresholds.
    """
    rules = load("rules_boolean") if rules is None else rules
    cols = metrics.columns
    rows = []
    for r in rules:
        if not _applies(r, workload):
            continue
        names = [n for n in dict.fromkeys([*r.get("evidence", []), "cpu_count"]) if n in cols]
        shown = f"to_json(struct({', '.join(f'`{n}`' for n in names)}))" if names else "'{}'"
        cond, scale = _for_workload(r, adjust)
        rows.append(f"struct({_head(r)}, {_truth(cols, cond, scale)} AS matched, CAST({_margin(cols, cond)} AS DOUBLE) AS margin, "
                    f"{shown} AS evidence_json)")
    return metrics.select(*K, _inline(rows)).select(
        *K, "rule_id", "category", "severity", "matched", "margin", "evidence_json", "diagnosis")


def advice(evaluated: DataFrame, K: Sequence[str] = K, table: Sequence[dict] | None = None) -> DataFrame:
    """(rule_id, position, suggestion, hint) of the rules that hold, in the order the rule lists them."""
    if table is None:
        table = json.loads((RESOURCES / "rules_advice.json").read_text(encoding="utf-8"))
    texts = F.create_map(*[F.lit(x) for r in table for x in (r["rule_id"], r["suggestions"])])
    hints = F.create_map(*[F.lit(x) for r in table for x in (r["rule_id"], r.get("hint"))])
    hit = evaluated.where("matched")
    return hit.select(*K, "rule_id", hints[F.col("rule_id")].alias("hint"), F.posexplode(texts[F.col("rule_id")]).alias("position", "suggestion"))


def near_misses(evaluated: DataFrame, within: float = 0.1) -> DataFrame:
    return evaluated.where(~F.col("matched") & (F.col("margin") < within))


def rule_evidence(metrics: DataFrame, rules: Sequence[dict] | None = None, K: Sequence[str] = K) -> DataFrame:
    """(rule_id, metric, value) for the non-null metrics each rule names."""
    rules = load("rules_boolean") if rules is None else rules
    cols = metrics.columns
    rows = [f"struct({_text(r['rule_id'])} AS rule_id, {_text(n)} AS metric, {_sql_col(cols, n)} AS value)"
            for r in rules for n in dict.fromkeys([*r.get("evidence", []), "cpu_count"]) if n in cols]
    return metrics.select(*K, _inline(rows)).where("value is not null")


def causal_patterns(metrics: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Trace-level cause of device idling from the metric record; the launch-gap cause only stands alone."""
    cols = metrics.columns
    v = {n: F.coalesce(_has(cols, n), F.lit(0.0)) for n in (
        "runqueue_pressure", "sched_latency_p99_ms", "io_wait_pct", "major_page_faults", "kernel_launch_gap_avg_ms")}
    idle = F.coalesce(_has(cols, "npu_idle_ratio"), F.lit(0.0)) >= 5
    a = idle & (v["runqueue_pressure"] > 1.0) & (v["sched_latency_p99_ms"] > 5)
    b = idle & (v["io_wait_pct"] > 5)
    c = idle & (v["major_page_faults"] > 0)
    d = idle & ~(a | b | c) & (v["kernel_launch_gap_avg_ms"] > 1)
    order = (("CPU_SCHED_CONTENTION", a, 0.85), ("IO_BLOCK", b, 0.78), ("MEMORY_PRESSURE", c, 0.72),
             ("KERNEL_LAUNCH_GAP", d, 0.60))
    return metrics.select(
        *K, (a | b | c | d).alias("correlation_found"),
        reduce(lambda x, y: x + y, [F.when(t, 1).otherwise(0) for _, t, _ in order]).cast("long").alias("n_patterns"),
        X.first_match(*[(t, n) for n, t, _ in order]).alias("primary_bottleneck"),
        X.first_match(*[(t, p) for _, t, p in order]).alias("confidence"))


# ---------------------------------------------------------------- diagnosis

def severity_rollup(matched: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Overall severity from the matched rules of each key."""
    sev = F.upper("severity")
    m = F.col("matched")
    has = matched.groupBy(*K).agg(
        F.bool_or(m & (sev == "CRITICAL")).alias("_c"), F.bool_or(m & (sev == "HIGH")).alias("_h"),
        F.bool_or(m & (sev == "HIGH") & (F.col("confidence") > 0.7)).alias("_hc"),
        F.bool_or(m & (sev == "MEDIUM")).alias("_m"), F.count_if(m).alias("n_matched"))
    return has.select(*K, "n_matched", X.first_match(
        (F.col("_c"), "CRITICAL"), (F.col("_hc"), "HIGH"), (F.col("_h"), "MEDIUM"), (F.col("_m"), "LOW"),
        default="NONE").alias("severity"))


def threshold_evidence(features: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """Metrics beyond their normal side, a correlation above 0.6, attribution shares of 0.2 and more."""
    cols = features.columns
    rows = []

    def add(metric: str, value: Column, limit: float, bad: Column) -> None:
        rows.append(F.struct(F.lit(metric).alias("metric"), value.alias("value"), F.lit(float(limit)).alias("threshold"),
                             F.coalesce(bad, F.lit(False)).alias("_bad")))

    for m, (limit, side) in EVIDENCE_LIMITS.items():
        v = _has(cols, m)
        add(m, v, limit, v > limit if side == "high" else v < limit)
    add("correlation_score", _has(cols, "correlation_score"), 0.6, _has(cols, "correlation_score") > 0.6)
    for a in ATTRIBUTIONS:
        v = _has(cols, f"attr_{a}")
        add(f"attribution_{a}", v, 0.2, v >= 0.2)
    return features.select(*K, F.inline(F.array(*rows))).where("_bad").drop("_bad")


def merge_suggestions(matched: DataFrame, rules: Sequence[dict] | None = None, K: Sequence[str] = K) -> DataFrame:
    """Suggestions of the matched rules, one row per text (the first rule in rule order wins), by priority."""
    rules = load("rules_weighted") if rules is None else rules
    order = {r["rule_id"]: i for i, r in enumerate(rules)}
    table = {
        r["rule_id"]: F.array(*[F.struct(F.lit(t).alias("text"), F.lit(int(p)).alias("priority"))
                                for t, p in [(s + [99])[:2] for s in r.get("suggestions", [])]])
        for r in rules if r.get("suggestions")}
    pick = X.first_match(*[(F.col("rule_id") == k, v) for k, v in table.items()])
    rows = matched.where("matched").withColumn("_s", F.explode(pick)).select(
        *K, "_s.*", "rule_id", X.lookup(F.col("rule_id"), order).alias("_o"))
    best = rows.groupBy(*K, "text").agg(F.min_by(F.struct("priority", "rule_id"), "_o").alias("_b"))
    return best.select(*K, "text", F.col("_b.priority").cast("long").alias("priority"), F.col("_b.rule_id").alias("rule_id"))


def case_hint(diagnosis: Column, cases: Sequence[dict] | None = None) -> Column:
    """Suggestion of the first case whose diagnosis is inside the text, else of the first keyword found."""
    cases = load("cases") if cases is None else cases
    low = F.lower(diagnosis)
    exact = [(low.contains(c["diagnosis"].lower()), c["suggestion"]) for c in cases]
    words = [(low.contains(k), c["suggestion"]) for c in cases for k in c.get("keywords", [])]
    return X.first_match(*exact, *words)


def diagnose(evaluated: DataFrame, features: DataFrame, K: Sequence[str] = K) -> DataFrame:
    """One verdict per trace: severity, primary diagnosis (highest confidence), counts and a case hint."""
    K = list(K)
    best = F.max_by(F.when(F.col("matched"), F.col("diagnosis")),
                    F.when(F.col("matched"), F.struct(F.col("confidence"), F.col("rule_id"))))
    rolled = severity_rollup(evaluated, K).join(evaluated.groupBy(*K).agg(best.alias("_primary")), K)
    n_ev = threshold_evidence(features, K).groupBy(*K).agg(F.count(F.lit(1)).alias("_ev"))
    out = rolled.join(features.select(*K, "correlation_score"), K, "left").join(n_ev, K, "left")
    corr = F.coalesce("correlation_score", F.lit(0.0))
    calm = (F.col("n_matched") == 0) & (corr < 0.3)
    primary = F.when(calm, "no clear host-side problem").when(
        F.col("n_matched") == 0, "host and device correlate but no rule matched").otherwise(F.col("_primary"))
    return out.select(
        *K, "severity", (F.col("severity") != "NONE").alias("has_issue"), primary.alias("primary_diagnosis"),
        F.greatest(F.col("n_matched") - 1, F.lit(0)).alias("n_secondary"),
        (F.coalesce("_ev", F.lit(0)) + F.col("n_matched")).alias("n_evidence"),
        F.when(~calm, case_hint(primary)).alias("case_hint"))


def case_knn(features: DataFrame, cases: Sequence[dict] | None = None, K: Sequence[str] = K, top_k_cases: int = 3) -> DataFrame:
    """Closest library cases per trace by weighted, normalised L1 distance; similarity 1/(1+d).

    Every case is one expression, so the library rides in the projection and no join is needed.
    """
    cases = load("cases") if cases is None else cases
    cols = features.columns
    rows = []
    for i, c in enumerate(cases):
        terms = []
        for m, w in CASE_WEIGHTS.items():
            # a correlation score kept outside the scalars counts as a missing scalar here
            have = "0D" if m == "correlation_score" else f"coalesce({_sql_col(cols, m)}, 0D)"
            want = float(c["features"].get(m, 0.0))
            terms.append(f"{w}D * abs({have} - {want}D) / greatest(abs({have}), {max(abs(want), 1.0)}D)")
        for a in ATTRIBUTIONS:
            terms.append(f"abs(coalesce({_sql_col(cols, 'attr_' + a)}, 0D) - {float(c['attribution'].get(a, 0.0))}D)")
        terms.append(f"abs(coalesce({_sql_col(cols, 'correlation_score')}, 0D) - {float(c['features'].get('correlation_score', 0.0))}D)")
        rows.append(f"struct({' + '.join(terms)} AS distance, {i} AS _i, {_text(c['case_id'])} AS case_id)")
    ranked = F.expr(f"slice(array_sort(array({', '.join(rows)})), 1, {int(top_k_cases)})")
    out = features.select(*K, F.posexplode(ranked).alias("_p", "_c"))
    return out.select(*K, F.col("_c.case_id").alias("case_id"), F.col("_c.distance").alias("distance"),
                      (1 / (1 + F.col("_c.distance"))).alias("similarity"), (F.col("_p") + 1).cast("long").alias("rank"))


# Which cause explains which symptom.
CAUSED_BY = {"HN001": ("HN004", "HN005", "HN006"), "HN003": ("HN004",), "CPU003": ("CPU001",), "IO001": ("IO002",),
             "NUMA001": ("NUMA002",), "RT001": ("IO002",)}


def order_rules(matched: DataFrame, K: Sequence[str] = K, caused_by: dict[str, Sequence[str]] = CAUSED_BY) -> DataFrame:
    """Report order (severity, category, id) with the explaining rule named; explained rules stay."""
    m = matched.where("matched")
    sev = X.lookup(F.upper("severity"), {s: i for i, s in enumerate(SEVERITY_ORDER)}, len(SEVERITY_ORDER))
    cat = X.lookup(F.col("category"), {c: i for i, c in enumerate(CATEGORY_ORDER)}, len(CATEGORY_ORDER))
    causes = sorted({c for v in caused_by.values() for c in v})
    on_key = Window.partitionBy(*K)      # at most one row per rule
    flags = {c: F.bool_or(F.col("rule_id") == c).over(on_key) for c in causes}
    why = X.first_match(*[((F.col("rule_id") == s) & flags[c], c) for s, cs in caused_by.items() for c in cs])
    rank = F.row_number().over(on_key.orderBy(sev, cat, "rule_id"))
    return m.withColumns({"position": rank.cast("long"), "caused_by": why})


# Healthy and warning ranges per metric: (metric, test for healthy, test for warning).
def health_bands(features: DataFrame, K: Sequence[str] = K) -> DataFrame:
    cols = features.columns
    cores = F.greatest(F.coalesce(_has(cols, "cpu_cores"), F.lit(1.0)), F.lit(1.0))
    bands = {
        "device_utilization": (lambda v: v > 0.85, lambda v: v >= 0.70),
        "cpu_util_avg": (lambda v: (v >= 40) & (v <= 70), lambda v: (v >= 20) & (v <= 85)),
        "runqueue_avg": (lambda v: v < cores, lambda v: v <= 2 * cores),
        "sched_latency_avg_us": (lambda v: v < 1000, lambda v: v <= 5000),
        "correlation_score": (lambda v: v < 0.3, lambda v: v <= 0.6),
        "top_gap_us": (lambda v: v < 1000, lambda v: v <= 10000),
    }
    rows = [F.struct(F.lit(m).alias("metric"), _has(cols, m).alias("value"),
                     F.when(ok(_has(cols, m)), "healthy").when(warn(_has(cols, m)), "warning").otherwise("danger").alias("band"))
            for m, (ok, warn) in bands.items()]
    return features.select(*K, F.inline(F.array(*rows))).where("value is not null")
