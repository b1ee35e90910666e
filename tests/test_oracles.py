"""Every registered query against its oracle text on the smallest tables, and on the split path for ordered ones."""

import pytest

import __spark_entry__ as E
from perfloom.operators import sequence
from perfloom.plans import QUERIES
from tests.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
ORDERED = ("systematic_sample be_pairing gap_scan gap_scan_exact gap_stats gap_pareto npu_idle cpu_util sched_latency nearest_rank_pct "
           "sched_latency_stats thread_states cpu_migration step_timeline downsample anchored_windows io_latency loader_share "
           "ffill_melt cpu_util_idle metric_transpose nearest_lookup bucket_lookup triage_stats").split()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    assert name in E.oracle_sql()
    assert compare(df, con, E.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ORDERED)
def test_split_path_matches_oracle(spark, con, name, monkeypatch):
    monkeypatch.setattr(sequence, "SPLIT_ROWS", 40)
    assert compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name]) is None


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "gap_dur" in df.columns
