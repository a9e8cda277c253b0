"""Queries over tables of a few own rows: whole inputs, whole outputs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import types as T

from pollmirror.operators.pairs import pair_jsd
from pollmirror.plans import registry
from pollmirror.plans.bridge import Survey

registry.load_all()
QUESTIONS, YEARS = 12, (1995, 1996, 1997, 1998, 1999)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Twelve questions answered in five years by three segments of customers."""
    root = tmp_path_factory.mktemp("tables")
    kinds = ["ECONOMY", "STANDARD", "PROMO", "MEDIUM", "LARGE", "SMALL"]
    part = [(p, f"Name {p}", f"Brand#{p % 5 + 2}", kinds[p % 6], 4 + p) for p in range(1, QUESTIONS + 1)]
    lines, no = [], 0
    for p in range(1, QUESTIONS + 1):
        for y in YEARS:
            for i in range(3 + (p * y) % 4):
                no += 1
                lines.append((no, p, 1, i % 7 + 1, 10.0 + i, 100.0 + no, 0.1 if no % 11 == 0 else 0.02, 0.08 if no % 13 == 0 else 0.01, "ANR"[no * no % 3], "FO"[no % 2], dt.datetime(y, 5, 1 + i)))
    orders = [(n, n % 9 + 1, "O", dt.datetime(1995, 1, 1), "1-URGENT") for n in range(1, no + 1)]
    customers = [(c, c % 3, ["BUILDING", "MACHINERY", "FURNITURE"][c % 3]) for c in range(1, 10)]
    tables = {
        "part": (part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"),
        "customer": (customers, "c_custkey long, c_nationkey int, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def run(spark, folder, name):
    return registry.QUERIES[name](spark, folder)


def test_every_wave_is_read(spark, folder):
    rows = run(spark, folder, "src_wave_json_tech").collect()
    assert {r["wave_dir"] for r in rows} == {f"W{y}" for y in YEARS}
    assert len(rows) == run(spark, folder, "src_wave_json").count()
    assert "Tech_" not in registry.ORACLES["src_wave_json_tech"]


def test_drift_has_its_interval(spark, folder):
    (row,) = run(spark, folder, "temporal_drift_overall").collect()
    assert row["n_stems"] == QUESTIONS and row["n_pairs"] == 10 * QUESTIONS
    assert row["ci_low"] < row["mean_drift"] < row["ci_high"]


def test_run_scores_keep_no_texts_or_arrays(spark, folder):
    s = Survey.open(spark, folder)
    assert not any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in s.metrics.schema.fields)
    wide = {(r["run_id"], r["key"]): (r["jsd"], r["tau"], r["in_tok"]) for r in s.scored.collect()}
    assert wide == {(r["run_id"], r["key"]): (r["jsd"], r["tau"], r["in_tok"]) for r in s.metrics.collect()}


def test_pairs_of_a_group_are_gathered_not_joined(spark):
    rows = [("g" if i < 30 else "h", f"m{i:02d}", {"a": (i + 1.0) / 40, "b": (39.0 - i) / 40}) for i in range(36)] + [("g", None, {"a": 1.0})]
    d = spark.createDataFrame(rows, "g string, model string, dist map<string,double>")
    for cell_rows in (64, 4):
        pairs = pair_jsd(d, ["g"], "model", cell_rows=cell_rows)
        assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the sizes alone
        got = [(r["g"], r["model_a"], r["model_b"]) for r in pairs.collect()]
        want = [(g, a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a and b and a < b]
        assert sorted(got) == sorted(want)
