"""Registered queries against their SQL at the smallest scale (tests/oracle_check.py runs all)."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
PICKED = """jsd tau_b question_score run_score sample_distribution config_id parse_provider qset_hash leaderboard question_summary
concordance contamination_risk ensemble_blend demographic_eval split_sps v_perq v_reagg v_schema validate bca_estimates paired_deltas kripp_alpha_ordinal
curve_real_expected convergence_n src_wave_json src_microdata core_sample s_intake""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    assert compare(df.collect(), df.columns, res.fetchall(), [d[0] for d in res.description]) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
