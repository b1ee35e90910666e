"""The two end-to-end analyses as lazily composed frames over any number of traces at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from perfloom.operators import correlate as CO
from perfloom.operators import metrics as ME
from perfloom.operators import rules as RU
from perfloom.operators import timeline as TL
from perfloom.operators.events import K, typed_args


def analyze(ev: DataFrame, K: Sequence[str] = K, min_gap_us: int = 100, significant_us: int = 1000,
            max_offset_us: int | None = None, window_us: int = 1_000_000, strict: bool = False) -> dict[str, DataFrame]:
    """Events -> host metrics, idle gaps, attribution, correlation, weighted rules, verdict.

    Nothing runs until a frame is written.  Read ``ev`` from the event table rather than from raw text, so that each branch
    scans only the columns it needs.  Utilisation enters the rules in percent unless ``strict``.
    """
    ev = typed_args(ev)
    all_gaps = TL.gap_scan(ev, K, 1)
    gaps = all_gaps.where(f"gap_dur >= {max(min_gap_us, significant_us)}")
    attributed = CO.attribute_gaps(CO.gap_host_join(gaps, ev, K, max_offset_us), K)
    share = CO.attribution_share(attributed, K)
    corr = CO.host_device_corr(gaps, ev, K, window_us)
    scalars = ME.host_scalars(ev, K, window_us, percent=not strict)
    spikes = None if strict else ME.series_spikes(ev, K, window_us)
    features = RU.feature_row(scalars, share, corr, K, spikes)
    evaluated = RU.weighted_rules(features, K=K, strict=strict)
    pareto = TL.pareto(all_gaps.where(f"gap_dur >= {min_gap_us}"), K, "gap_dur", ties=["gap_start", "device_id", "stream_id"])
    return {
        "scalars": scalars, "gap_stats": TL.gap_stats(ev, all_gaps, K, significant_us), "gaps": gaps,
        "pareto_gaps": pareto, "top_gaps": pareto.where("rank <= 20"),
        "gap_histogram": TL.gap_histogram(all_gaps, K), "attributed_gaps": attributed, "attribution": share, "correlation": corr,
        "critical_path": CO.critical_path(gaps, ev, K, max_offset_us=max_offset_us), "hot_functions": TL.hot_functions(ev, K),
        "features": features, "rules": evaluated, "diagnosis": RU.diagnose(evaluated, features, K),
        "suggestions": RU.merge_suggestions(evaluated, K=K), "similar_cases": RU.case_knn(features, K=K),
        "evidence": RU.threshold_evidence(features, K),
    }


def analyze_lines(ev: DataFrame, K: Sequence[str] = K, window_us: int = 100_000, cpu_count: int = 1,
                  workload: str = "unknown") -> dict[str, DataFrame]:
    """Kernel line events -> metric record -> boolean rules, near misses and trace-level causes."""
    ev = typed_args(ev)
    record = ME.metric_record(ev, K, window_us, cpu_count)
    evaluated = RU.boolean_rules(record, K=K, workload=workload)
    return {
        "windows": TL.window_summary(ev, K, window_us), "record": record, "rules": evaluated,
        "ordered": RU.order_rules(evaluated, K), "near_misses": RU.near_misses(evaluated),
        "evidence": RU.rule_evidence(record, K=K), "advice": RU.advice(evaluated, K), "causes": RU.causal_patterns(record, K),
    }
