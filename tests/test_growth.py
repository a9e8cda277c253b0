"""Plans that must not grow: rows spread by question once, documents read once, no score that nobody asked for."""

import datetime as dt
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pollmirror.plans import q_quality, q_rollups, q_sources
from pollmirror.plans.bridge import Survey
from pollmirror.sources import surveys as V
from pollmirror.streaming.common import settings


@pytest.fixture()
def survey(spark, tmp_path):
    types = ["ECONOMY BRASS", "STANDARD", "PROMO", "LARGE"]
    write = lambda rows, name: spark.createDataFrame(rows).write.parquet(f"{tmp_path}/{name}.parquet")
    write([Row(p_partkey=i, p_type=types[i % 4], p_name=f"name {i}", p_brand="Brand#2", p_size=4 + i) for i in range(1, 9)], "part")
    write([Row(c_custkey=i, c_mktsegment=["BUILDING", "MACHINERY", "FURNITURE"][i % 3], c_nationkey=i % 2) for i in range(1, 7)], "customer")
    write([Row(o_orderkey=i, o_custkey=1 + i % 6) for i in range(1, 31)], "orders")
    write(
        [
            Row(
                l_orderkey=1 + i % 33, l_partkey=1 + i % 9, l_linenumber=1 + i % 3, l_returnflag="ANR"[i % 3], l_linestatus="FO"[i % 2], l_discount=0.1 if i % 7 == 0 else 0.0,
                l_tax=0.08 if i % 11 == 0 else 0.02, l_quantity=float(1 + i % 20), l_shipdate=dt.datetime(1996 + i % 3, 1 + i % 12, 3),
            )
            for i in range(400)
        ],
        "lineitem",
    )
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxPlanStringLength": "1000000", "spark.sql.debug.maxToStringFields": "100"}
    with settings(spark, conf):
        yield Survey(spark, str(tmp_path))
    spark.catalog.clearCache()


def physical(d):
    return d._jdf.queryExecution().executedPlan().toString()


def logical(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def spreads(d):
    return len(re.findall(r"Exchange hashpartitioning", physical(d)))


def test_answers_are_spread_by_question_once(survey):
    assert spreads(survey.questions) == 2  # answers and parts
    assert spreads(survey.distributions) == 6  # the same for samples and for questions, then their cells


def test_grouped_answers_stay_spread_by_question(survey):
    # orders and customers, their rows and the answers by order, then answers and parts by question
    assert spreads(q_sources.wave_files(survey)) == spreads(survey.grouped) == 6
    orders = survey.table("orders").select(F.col("o_orderkey").alias("sample_no"))
    assert survey.grouped.count() == survey.base.join(orders, "sample_no").count() > 0


@pytest.mark.parametrize("name", ["wave", "group"])
def test_documents_are_parsed_once(survey, name):
    files = q_sources.wave_files(survey)
    d = V.wave_questions(files, q_sources.wave_info(survey)) if name == "wave" else V.group_distributions(V.wave_counts(files))
    assert logical(d).count("from_json(MapType(StringType,DoubleType") == 1
    sums = {}
    by = ["wave_dir", "key"] if name == "wave" else ["attribute", "key", "group"]
    for r in d.collect():
        k = tuple(r[c] for c in by)
        sums[k] = sums.get(k, 0) + r["p"]
    assert sums and all(abs(x - 1) < 1e-9 for x in sums.values())


def test_parts_are_not_copied_to_every_task_for_the_years(survey):
    plan = physical(q_sources.wave_info(survey))
    assert "BroadcastNestedLoopJoin BuildRight" in plan


def test_group_scores_leave_out_the_scores_of_the_run(survey):
    plan = logical(q_rollups.subgroup_cv(survey))
    assert "SIGNUM" not in plan and "InMemoryRelation" not in plan


def test_checks_of_raw_answers_keep_no_scores(survey):
    plan = logical(q_quality.v_graduate(survey))
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", plan)
    assert kept and not any("tau#" in k or "jsd#" in k for k in kept)
    assert "Relation [l_orderkey" not in plan  # the runs come from the cells


def test_shares_leave_out_rows_without_a_group(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), (None, "x", 1.0), ("b", "x", 0.0)], "k string, o string, n double")
    assert {tuple(r) for r in V.shares(rows, ["k"], "n").collect()} == {("a", "x", 0.25), ("a", "y", 0.75)}
    assert {tuple(r) for r in V.renormalise(rows.withColumnRenamed("n", "p"), ["k"]).collect()} == {("a", "x", 0.25), ("a", "y", 0.75), ("b", "x", 0.0)}
