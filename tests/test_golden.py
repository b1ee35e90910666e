import pytest

from perfloom.operators import correlate as CO
from perfloom.operators import events as EV
from perfloom.operators import metrics as ME
from perfloom.operators import rules as RU
from perfloom.operators import timeline as TL
from perfloom.sources import read
from tests import golden


@pytest.fixture(scope="module")
def ev(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("golden")
    golden.write(d / "synthetic.json")
    return EV.typed_args(read(spark, "chrome", str(d))).cache()


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_events(ev):
    # 3 names and 10 rows in each of 6 rounds
    assert ev.count() == 63
    meta = one(EV.trace_metadata(ev))
    assert (meta.event_count, meta.cpu_cores, meta.ts_min) == (63, 2, golden.START)
    names = {(r.kind, r.id, r.name) for r in EV.trace_names(ev).collect()}
    assert ("process", 77, "trainer") in names and ("thread", 8, "t8") in names


def test_gaps(ev):
    # per round: copy in to 20.0 ms, kernels 21.0-27.0-29.5, copy out 32.0-33.0, next copy in at 56.0
    gaps = TL.gap_scan(ev, min_gap_us=100)
    durs = sorted(r.gap_dur for r in gaps.collect())
    assert durs == [1000] * 6 + [2500] * 6 + [23000] * 5
    st = one(TL.gap_stats(ev, gaps))
    assert (st.total_gap_us, st.total_kernel_us, st.gap_count, st.significant_count) == (136_000, 6 * 13_500, 17, 17)
    assert st.utilization == pytest.approx(81 / 217, abs=1e-6)
    # 80 % of 136 ms are 108.8 ms: the fifth of the 23 ms gaps crosses that
    assert TL.pareto(gaps, ["trace_id"], "gap_dur", ties=["gap_start"]).count() == 5
    hist = {r.label: r["count"] for r in TL.gap_histogram(gaps).collect()}
    assert hist == {"<1ms": 0, "1-5ms": 12, "5-10ms": 0, "10-50ms": 5, "50-100ms": 0, ">100ms": 0}


def test_host_metrics(ev):
    # core 0 runs 4-9 ms and from 14 ms to 4 ms of the next round, and is idle 9-14 ms
    util = {r.cpu: r for r in TL.cpu_util(ev).collect()}
    assert (util[0].running_us, util[0].idle_us) == (6 * 5_000 + 5 * 30_000, 6 * 5_000)
    assert util[0].util == pytest.approx(180 / 210, abs=1e-6)
    assert [r.latency_us for r in TL.sched_latency(ev).collect()] == [3_000] * 6
    launch = one(ME.launch_stats(ev))
    assert (launch.launch_count, launch.launch_avg_gap_us) == (6, 40_000.0)
    bw = one(ME.copy_bandwidth(ev))
    assert (bw.h2d_bandwidth_mbs, bw.d2h_bandwidth_mbs, bw.memcpy_total_us) == (750.0, 200.0, 30_000)
    rq = one(TL.timeline(ev, "runqueue"))
    assert (rq.ts, rq.value) == (golden.START, 12.0)


def _features(ev, spikes=None):
    gaps = TL.gap_scan(ev, min_gap_us=1000)
    att = CO.attribute_gaps(CO.gap_host_join(gaps, ev))
    share = CO.attribution_share(att)
    return att, share, RU.feature_row(ME.host_scalars(ev), share, CO.host_device_corr(gaps, ev), spikes=spikes)


def test_attribution_and_rules(ev):
    att, share, features = _features(ev)
    got = {r.attribution: r.ratio for r in share.collect()}
    assert got == {"DATA_LOADER": pytest.approx(115 / 136), "LAUNCH_GAP": pytest.approx(6 / 136), "OTHER": pytest.approx(15 / 136)}
    # fetch 12 of 23 ms, launch 0.6 of 1 ms, nothing starts around the gap before copy out
    conf = {r.attribution: round(r.confidence, 4) for r in att.collect()}
    assert conf == {"DATA_LOADER": 0.5217, "LAUNCH_GAP": 0.6, "OTHER": 0.0}
    row = one(features)
    assert row.correlation_score == 0.0
    evaluated = RU.weighted_rules(features, strict=True)
    out = {r.rule_id: r for r in evaluated.collect()}
    assert len(out) == 11 and all(0 <= r.confidence <= 1 for r in out.values())
    verdict = one(RU.diagnose(evaluated, features))
    matched = [r for r in out.values() if r.matched]
    assert verdict.has_issue == bool(matched) and verdict.n_secondary == max(0, len(matched) - 1)


def test_critical_path(ev):
    gaps = TL.gap_scan(ev, min_gap_us=1000)
    rows = CO.critical_path(gaps, ev, n=5).orderBy("gap_rank").collect()
    assert [r.gap_dur for r in rows] == [23000] * 5
    assert rows[0].host_events[0].host_name == "DataLoader.fetch"
