"""Rule family over per-user metric records.  Oracle texts are generated from the same rule data in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from perfloom.functions import exprs as X
from perfloom.operators import rules as RU
from perfloom.plans.registry import query, tidy
from perfloom.plans.views import _METRICS, _RECORD, view

WEIGHTED, BOOLEAN, CASES = RU.load("rules_weighted"), RU.load("rules_boolean"), RU.load("cases")
_MV = {e.rsplit(" AS ", 1)[1] for e in _METRICS}
_REC = {e.rsplit(" AS ", 1)[1] for e in _RECORD}


def _values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _weighted_sql() -> str:
    attr_cols = [f"attr_{a}" for a in RU.ATTRIBUTIONS]
    conds, temporal, corr = [], [], []
    for r in WEIGHTED:
        for key, op, value, w in r["scalars"]:
            conds.append((r["rule_id"], key, op, None if value == "auto" else float(value), int(round(w * 1000))))
        for p, w in r["temporal"]:
            temporal.append((r["rule_id"], "spike_" + RU.PATTERN_SERIES.get(p, p), int(round(w * 1000))))
        for a, m, w in r["correlation"]:
            corr.append((r["rule_id"], "attr_" + a, float(m), int(round(w * 1000))))
    scalar_cols = sorted({c[1] for c in conds} & _MV)
    spike_cols = sorted(c for c in _MV if c.startswith("spike_"))
    longs = " UNION ALL ".join(f"SELECT trace_id, '{c}' AS metric, {c} AS value FROM mv" for c in scalar_cols + attr_cols)
    total = " + ".join(f"coalesce({c}, 0)" for c in attr_cols)
    sp = " UNION ALL ".join(f"SELECT trace_id, '{c}' AS metric, {c} AS fired FROM mv" for c in spike_cols)
    return f"""
, lg AS ({longs} UNION ALL SELECT trace_id, 'attribution_sum', {total} FROM mv), sp AS ({sp}),
rule(rule_id, severity, category, diagnosis, threshold) AS (VALUES {_values([(r['rule_id'], r['severity'], r['category'], r['diagnosis'], int(round(r['threshold'] * 1000))) for r in WEIGHTED])}),
sc(rule_id, metric, op, value, w) AS (VALUES {_values(conds)}), te(rule_id, metric, w) AS (VALUES {_values(temporal)}), co(rule_id, metric, lim, w) AS (VALUES {_values(corr)}),
ev AS (SELECT lg.trace_id, rule_id, w, CASE WHEN CASE op WHEN 'gt' THEN lg.value > coalesce(sc.value, cpu_cores) ELSE lg.value < sc.value END THEN w ELSE 0 END AS hit
   FROM sc JOIN lg USING (metric) JOIN mv ON mv.trace_id = lg.trace_id WHERE lg.value IS NOT NULL
 UNION ALL SELECT mv.trace_id, rule_id, w, CASE WHEN fired THEN w ELSE 0 END FROM mv CROSS JOIN te LEFT JOIN sp ON sp.trace_id = mv.trace_id AND sp.metric = te.metric
 UNION ALL SELECT lg.trace_id, rule_id, w, CASE WHEN coalesce(lg.value, 0) >= lim THEN w ELSE 0 END FROM co JOIN lg USING (metric)),
wr AS (SELECT trace_id, rule_id, sum(hit) / sum(w) AS confidence, sum(hit) * 1000 >= sum(w) * any_value(threshold) AS matched, any_value(severity) AS severity,
  any_value(category) AS category, any_value(diagnosis) AS diagnosis FROM ev JOIN rule USING (rule_id) GROUP BY 1, 2)"""


_WR = _weighted_sql()


def mv(s, d):
    return view(s, d, "mv")


def rec(s, d):
    return view(s, d, "rec")


@query("weighted_rules", "mv", _WR + " SELECT trace_id, rule_id, category, severity, round(confidence, 4) AS confidence, matched FROM wr")
def weighted_rules(s, d):
    return tidy(RU.weighted_rules(mv(s, d)).drop("diagnosis"), 4)


def _sql_operand(v):
    return (v["ref"] if v["ref"] in _REC else "NULL") if isinstance(v, dict) else str(v)


def _sql_tree(c) -> str:
    if isinstance(c, dict):
        word = "and" if "and" in c else "or"
        return "(" + f" {word.upper()} ".join(_sql_tree(x) for x in c[word]) + ")"
    m = c[0] if c[0] in _REC else "CAST(NULL AS DOUBLE)"
    return f"coalesce({m} {c[1]} {_sql_operand(c[2])}, false)"


def _sql_leaves(c) -> list:
    return [x for k in c.values() for y in k for x in _sql_leaves(y)] if isinstance(c, dict) else [c]


def _sql_margin(c) -> str:
    parts = []
    for m, op, v in _sql_leaves(c):
        if m in _REC and not (isinstance(v, dict) and v["ref"] not in _REC):
            lim = _sql_operand(v)
            gap = f"({lim} - {m})" if op.startswith(">") else f"({m} - {lim})"
            parts.append(f"CASE WHEN {m} IS NOT NULL AND {lim} <> 0 THEN greatest({gap} / CAST({lim} AS DOUBLE), 0) END")
    return f"least({', '.join(parts)})" if len(parts) > 1 else (parts[0] if parts else "CAST(NULL AS DOUBLE)")


_BR = ", br AS (" + " UNION ALL ".join(
    f"SELECT trace_id, '{r['rule_id']}' AS rule_id, '{r['category']}' AS category, '{r['severity']}' AS severity, {_sql_tree(r['condition'])} AS matched, "
    f"CAST({_sql_margin(r['condition'])} AS DOUBLE) AS margin FROM rec" for r in BOOLEAN) + ")"


@query("boolean_rules", "rec", _BR + " SELECT trace_id, rule_id, category, severity, matched FROM br")
def boolean_rules(s, d):
    return RU.boolean_rules(rec(s, d)).select("trace_id", "rule_id", "category", "severity", "matched")


# Written out: how many suggestions each rule has, and whether it has a hint.
_ADVICE = """, ad(rule_id, n, hinted) AS (VALUES ('CPU001', 4, true), ('CPU002', 3, true), ('CPU003', 4, false), ('CPU004', 4, true), ('CPU005', 3, false),
 ('HN001', 5, true), ('HN002', 4, false), ('HN003', 5, false), ('HN004', 5, true), ('HN005', 5, true), ('HN006', 5, true), ('HN007', 5, false), ('HN008', 4, false), ('IO001', 5, true), ('IO002', 5, false), ('IO003', 4, false), ('IO004', 3, false), ('MEM001', 5, true), ('MEM002', 4, false), ('MEM003', 4, false), ('MEM004', 4, false),
 ('NUMA001', 4, true), ('NUMA002', 4, false), ('NUMA003', 2, false), ('RT001', 4, true), ('RT002', 6, true), ('RT003', 4, false), ('RT004', 4, true), ('SCHED001', 4, true), ('SCHED002', 3, false), ('SCHED003', 4, false), ('SCHED004', 3, false), ('SCHED005', 3, false))"""


@query("rule_advice", "rec", _BR + _ADVICE + " SELECT trace_id, rule_id, unnest(range(n)) AS position, hinted FROM br JOIN ad USING (rule_id) WHERE matched")
def rule_advice(s, d):
    rows = RU.advice(RU.boolean_rules(rec(s, d)))
    return rows.select("trace_id", "rule_id", F.col("position").cast("long").alias("position"), F.col("hint").isNotNull().alias("hinted"))


@query("rule_margin", "rec", _BR + " SELECT trace_id, rule_id, round(margin, 6) AS margin FROM br WHERE NOT matched AND margin < 0.1")
def rule_margin(s, d):
    return tidy(RU.near_misses(RU.boolean_rules(rec(s, d))).select("trace_id", "rule_id", "margin"))


@query("rule_context", "rec", _BR + " SELECT rule_id, count(*) AS n, count(*) FILTER (matched) AS hits FROM br WHERE rule_id NOT IN ('SCHED001', 'SCHED003') GROUP BY 1")
def rule_context(s, d):
    out = RU.boolean_rules(rec(s, d), workload="inference_single_stream")
    return out.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("hits"))


_EV = ", e AS (" + " UNION ALL ".join(
    f"SELECT trace_id, '{r['rule_id']}' AS rule_id, '{n}' AS metric, {n} AS value FROM rec"
    for r in BOOLEAN for n in dict.fromkeys([*r["evidence"], "cpu_count"]) if n in _REC) + ")"


@query("rule_evidence", "rec", _EV + " SELECT * FROM e WHERE value IS NOT NULL")
def rule_evidence(s, d):
    return RU.rule_evidence(rec(s, d))


@query("causal_patterns", "rec", """
, p AS (SELECT trace_id, 'CPU_SCHED_CONTENTION' AS p, 0.85 AS c FROM rec WHERE npu_idle_ratio >= 5 AND runqueue_pressure > 1 AND sched_latency_p99_ms > 5
 UNION ALL SELECT trace_id, 'IO_BLOCK', 0.78 FROM rec WHERE npu_idle_ratio >= 5 AND io_wait_pct > 5 UNION ALL SELECT trace_id, 'MEMORY_PRESSURE', 0.72 FROM rec WHERE npu_idle_ratio >= 5 AND major_page_faults > 0),
q AS (SELECT * FROM p UNION ALL SELECT trace_id, 'KERNEL_LAUNCH_GAP', 0.60 FROM rec WHERE npu_idle_ratio >= 5 AND kernel_launch_gap_avg_ms > 1 AND trace_id NOT IN (SELECT trace_id FROM p))
SELECT rec.trace_id, count(q.p) > 0 AS correlation_found, count(q.p) AS n_patterns, arg_max(q.p, q.c) AS primary_bottleneck, CAST(max(q.c) AS DOUBLE) AS confidence FROM rec LEFT JOIN q USING (trace_id) GROUP BY 1""")
def causal_patterns(s, d):
    return RU.causal_patterns(rec(s, d))


_SEV = """
, sv AS (SELECT trace_id, count(*) FILTER (matched) AS n_matched, CASE WHEN bool_or(matched AND severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(matched AND severity = 'HIGH' AND confidence > 0.7) THEN 'HIGH'
 WHEN bool_or(matched AND severity = 'HIGH') THEN 'MEDIUM' WHEN bool_or(matched AND severity = 'MEDIUM') THEN 'LOW' ELSE 'NONE' END AS severity FROM wr GROUP BY 1)"""


@query("severity_rollup", "mv", _WR + _SEV + " SELECT * FROM sv")
def severity_rollup(s, d):
    return RU.severity_rollup(RU.weighted_rules(mv(s, d)))


_TE = """
, ev2 AS (""" + " UNION ALL ".join(
    f"SELECT trace_id, '{m}' AS metric, {m} AS value, CAST({lim} AS DOUBLE) AS threshold FROM mv WHERE {m} {'>' if side == 'high' else '<'} {lim}"
    for m, (lim, side) in RU.EVIDENCE_LIMITS.items()) + """
 UNION ALL SELECT trace_id, 'correlation_score', correlation_score, 0.6 FROM mv WHERE correlation_score > 0.6 UNION ALL """ + " UNION ALL ".join(
    f"SELECT trace_id, 'attribution_{a}', attr_{a}, 0.2 FROM mv WHERE attr_{a} >= CAST(0.2 AS DOUBLE)" for a in RU.ATTRIBUTIONS) + ")"


@query("threshold_evidence", "mv", _TE + " SELECT trace_id, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold FROM ev2")
def threshold_evidence(s, d):
    return tidy(RU.threshold_evidence(mv(s, d)))


_SUG = f"sg(rule_id, o, text, priority) AS (VALUES {_values([(r['rule_id'], i, t, p) for i, r in enumerate(WEIGHTED) for t, p in r['suggestions']])})"


@query("suggestion_merge", "mv", _WR + f", {_SUG}" + """
SELECT trace_id, text, arg_min(CAST(priority AS BIGINT), o) AS priority, arg_min(rule_id, o) AS rule_id FROM wr JOIN sg USING (rule_id) WHERE matched GROUP BY 1, 2""")
def suggestion_merge(s, d):
    return RU.merge_suggestions(RU.weighted_rules(mv(s, d)))


@query("diagnosis", "mv", _WR + _SEV + _TE + """
, pr AS (SELECT trace_id, arg_max(diagnosis, (confidence, rule_id)) AS p FROM wr WHERE matched GROUP BY 1), ne AS (SELECT trace_id, count(*) AS n FROM ev2 GROUP BY 1)
SELECT sv.trace_id, sv.severity, sv.severity <> 'NONE' AS has_issue,
 CASE WHEN n_matched = 0 AND correlation_score < 0.3 THEN 'no clear host-side problem' WHEN n_matched = 0 THEN 'host and device correlate but no rule matched' ELSE p END AS primary_diagnosis,
 greatest(n_matched - 1, 0) AS n_secondary, coalesce(ne.n, 0) + n_matched AS n_evidence FROM sv JOIN mv USING (trace_id) LEFT JOIN pr USING (trace_id) LEFT JOIN ne USING (trace_id)""")
def diagnosis(s, d):
    f = mv(s, d)
    return RU.diagnose(RU.weighted_rules(f), f).drop("case_hint")


def _knn_sql() -> str:
    parts = []
    for c in CASES:
        terms = []
        for m, w in RU.CASE_WEIGHTS.items():
            have = "CAST(0 AS DOUBLE)" if m == "correlation_score" else f"coalesce({m}, 0)"
            want = float(c["features"].get(m, 0))
            terms.append(f"{w} * abs({have} - {want}) / greatest(abs({have}), {max(abs(want), 1.0)})")
        terms += [f"abs(coalesce(attr_{a}, 0) - {float(c['attribution'].get(a, 0))})" for a in RU.ATTRIBUTIONS]
        terms.append(f"abs(correlation_score - {float(c['features']['correlation_score'])})")
        parts.append(f"SELECT trace_id, '{c['case_id']}' AS case_id, CAST({' + '.join(terms)} AS DOUBLE) AS distance FROM mv")
    return ", dd AS (" + " UNION ALL ".join(parts) + ")"


@query("case_knn", "mv", _knn_sql() + """
SELECT trace_id, case_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity, row_number() OVER (PARTITION BY trace_id ORDER BY distance, case_id) AS rank FROM dd QUALIFY rank <= 3""")
def case_knn(s, d):
    return tidy(RU.case_knn(mv(s, d)))


_RANK = "CASE {c} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(RU.SEVERITY_ORDER)) + " ELSE 9 END"
_CAT = "CASE {c} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(RU.CATEGORY_ORDER)) + " ELSE 9 END"
_CAUSE = f"cz(rule_id, cause, o) AS (VALUES {_values([(k, c, i) for k, v in RU.CAUSED_BY.items() for i, c in enumerate(v)])})"


@query("rule_order", "rec", _BR + f", {_CAUSE}, m AS (SELECT * FROM br WHERE matched)" + f"""
, w AS (SELECT m.trace_id, m.rule_id, arg_min(cz.cause, cz.o) AS caused_by FROM m JOIN cz USING (rule_id) JOIN m m2 ON m2.trace_id = m.trace_id AND m2.rule_id = cz.cause GROUP BY 1, 2)
SELECT m.trace_id, m.rule_id, row_number() OVER (PARTITION BY m.trace_id ORDER BY {_RANK.format(c='severity')}, {_CAT.format(c='category')}, m.rule_id) AS position, w.caused_by FROM m LEFT JOIN w ON w.trace_id = m.trace_id AND w.rule_id = m.rule_id""")
def rule_order(s, d):
    return RU.order_rules(RU.boolean_rules(rec(s, d))).select("trace_id", "rule_id", "position", "caused_by")


@query("health_bands", "mv", """
, h AS (SELECT trace_id, 'cpu_util_avg' AS metric, cpu_util_avg AS value, CASE WHEN cpu_util_avg BETWEEN 40 AND 70 THEN 'healthy' WHEN cpu_util_avg BETWEEN 20 AND 85 THEN 'warning' ELSE 'danger' END AS band FROM mv
UNION ALL SELECT trace_id, 'runqueue_avg', runqueue_avg, CASE WHEN runqueue_avg < cpu_cores THEN 'healthy' WHEN runqueue_avg <= 2 * cpu_cores THEN 'warning' ELSE 'danger' END FROM mv
UNION ALL SELECT trace_id, 'sched_latency_avg_us', sched_latency_avg_us, CASE WHEN sched_latency_avg_us < 1000 THEN 'healthy' WHEN sched_latency_avg_us <= 5000 THEN 'warning' ELSE 'danger' END FROM mv
UNION ALL SELECT trace_id, 'correlation_score', correlation_score, CASE WHEN correlation_score < CAST(0.3 AS DOUBLE) THEN 'healthy' WHEN correlation_score <= CAST(0.6 AS DOUBLE) THEN 'warning' ELSE 'danger' END FROM mv)
SELECT trace_id, metric, round(value, 6) AS value, band FROM h WHERE value IS NOT NULL""")
def health_bands(s, d):
    return tidy(RU.health_bands(mv(s, d)))


@query("scenario_tag", "ev_k", """
SELECT event_id, CASE WHEN k >= 16 THEN 'high_concurrency' ELSE 'low_concurrency' END || '+' || CASE WHEN v * 10 >= 65536 THEN 'long_sequence' ELSE 'short_sequence' END AS tag FROM ev_k""")
def scenario_tag(s, d):
    return view(s, d, "ev_k").select("event_id", X.scenario_tag("k", F.col("v") * 10).alias("tag"))
