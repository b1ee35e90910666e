"""Streaming operators over the event table read as a file stream; checked against the batch answer in SQL."""

from __future__ import annotations

from perfloom import streaming as SM
from perfloom.operators import logs as LG
from perfloom.plans.profile_queries import _LM
from perfloom.plans.registry import query, tidy
from perfloom.plans.trace_queries import _GAPS, _LAT, _SUMMARY, HOUR
from perfloom.plans.views import VIEWS
from perfloom.shared import shared_dir as new_folder


def _stream(s, d, name, timed=False):
    table, where, exprs = VIEWS[name]
    # a glob, as the file stream source takes a plain path for a folder; it matches the file or a folder of that name
    path = f"{d}/{table[:-1]}[{table[-1]}].parquet"
    rows = s.read.parquet(f"{d}/{table}.parquet")
    raw = SM.tail_parquet(s, path, rows.schema)
    if timed:
        raw = SM.closed(raw, rows, "event_type")
    return raw.where(where).selectExpr(*[e.format(us="unix_micros(CAST(ts AS TIMESTAMP))") if "{us}" in e else e for e in exprs])


def _timed(s, d, name):
    return SM.with_event_time(_stream(s, d, name, timed=True), "1 hour")


def _drain(stream, name):
    return SM.drain(stream, name, new_folder(stream.sparkSession))


@query("stream_window_summary", "lt", f"""
SELECT trace_id, ts // {HOUR} * {HOUR} AS window_start, {_SUMMARY} FROM lt GROUP BY 1, 2""")
def stream_window_summary(s, d):
    return _drain(SM.tumbling_summary(_timed(s, d, "lt"), window_us=HOUR), "stream_window_summary")


@query("stream_sliding_util", "tv", f"""
, w AS (SELECT trace_id, cpu, dur, unnest([ts // {HOUR // 2} * {HOUR // 2}, ts // {HOUR // 2} * {HOUR // 2} - {HOUR // 2}]) AS window_start FROM tv WHERE dur > 0 AND cpu >= 0)
SELECT trace_id, cpu, window_start, round(sum(dur) / {HOUR}.0 * 100, 6) AS util_pct FROM w GROUP BY 1, 2, 3""")
def stream_sliding_util(s, d):
    return tidy(_drain(SM.sliding_util(_timed(s, d, "tv"), window_us=HOUR, slide_us=HOUR // 2), "stream_sliding_util"))


@query("stream_gap_scan", "tv", _GAPS + " SELECT * FROM g WHERE gap_dur >= 100")
def stream_gap_scan(s, d):
    return _drain(SM.gap_scan(_timed(s, d, "tv")), "stream_gap_scan")


@query("stream_sched_latency", "tv", _LAT + " SELECT * FROM la")
def stream_sched_latency(s, d):
    return _drain(SM.sched_latency(_timed(s, d, "tv")), "stream_sched_latency")


@query("stream_log_metrics", "lg", _LM + " SELECT * FROM lm")
def stream_log_metrics(s, d):
    return _drain(LG.line_metrics(_stream(s, d, "lg")), "stream_log_metrics")
