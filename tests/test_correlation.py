"""Correlation of host and device shares where a share is the same in all windows."""

import math

import numpy as np
import pytest

from perfloom.operators import correlate as CO

GAPS = "trace_id string, gap_start long, gap_dur long"
EVENTS = "trace_id string, seq long, ts long, dur long, device_id long, stream_id long, cat string, name string, pid long, tid long, ph string"


def _frames(spark, busy, idle, w=1000):
    ev = [("t", i, i * w, b, -1, -1, "cpu_function", "f", 1, 1, "X") for i, b in enumerate(busy)]
    ev.append(("t", len(busy), len(busy) * w, 0, 0, 0, "npu_kernel", "k", 1, 1, "X"))
    return spark.createDataFrame([("t", i * w, d) for i, d in enumerate(idle)], GAPS), spark.createDataFrame(ev, EVENTS)


@pytest.mark.parametrize("flat", [0.0, math.nan])
def test_flat_share_has_the_named_score(spark, flat):
    gaps, ev = _frames(spark, [100, 300, 200, 700], [5000] * 4)  # over a window each, so 1.0
    row = CO.host_device_corr(gaps, ev, ["trace_id"], 1000, flat).first()
    assert row.n_windows == 4 and (math.isnan(row.score) if math.isnan(flat) else row.score == flat)


def test_small_spread_is_no_flat_share(spark):
    w = 10**9
    busy, idle = [w // 2, w // 2 + 1, w // 2, w // 2 + 1], [w // 3, w // 3 + 2, w // 3, w // 3 + 1]
    row = CO.host_device_corr(*_frames(spark, busy, idle, w), ["trace_id"], w, math.nan).first()
    want = np.corrcoef(np.array(busy) - w // 2, np.array(idle) - w // 3)[0, 1]
    assert row.score == pytest.approx(want, abs=1e-9)
