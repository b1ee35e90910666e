import pytest

from perfloom import workflows as WF
from perfloom.plans.trace_queries import HOUR, MIN_GAP, OFFSET, SIGNIFICANT, lt, tv
from perfloom.sources import read
from tests import golden

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("wf")
    golden.write(d / "synthetic.json")
    return WF.analyze(read(spark, "chrome", str(d)))


def test_golden_verdict(out):
    v = out["diagnosis"].collect()[0]
    assert v.has_issue and v.severity in ("MEDIUM", "HIGH", "CRITICAL")
    matched = {r.rule_id for r in out["rules"].collect() if r.matched}
    assert matched == {"HN002"}  # the loader covers 85 % of idle time
    assert out["top_gaps"].count() == 5
    assert out["similar_cases"].count() == 3 and out["critical_path"].count() == 5


@pytest.mark.parametrize("name", ["gap_stats", "gap_histogram", "hot_functions", "suggestions", "evidence", "correlation"])
def test_parts_have_rows(out, name):
    assert out[name].count() > 0


def test_many_traces(spark):
    got = WF.analyze(tv(spark, SF), min_gap_us=MIN_GAP, significant_us=SIGNIFICANT, max_offset_us=OFFSET, window_us=HOUR)
    assert got["diagnosis"].count() == 3
    assert got["rules"].count() == 33


def test_line_traces(spark):
    got = WF.analyze_lines(lt(spark, SF), window_us=HOUR, cpu_count=4)
    assert got["record"].count() == 3 and got["rules"].count() == 99
    hit = {r.rule_id for r in got["rules"].collect() if r.matched}
    assert "MEM001" in hit and "HN001" not in hit
    assert got["causes"].count() == 3 and got["ordered"].count() > 0
