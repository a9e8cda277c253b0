import json
import os
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from pollmirror.streaming import common as C
from pollmirror.streaming import intake as I
from pollmirror.streaming import limits as L

START = datetime(2026, 1, 1)


def test_rate_limit_counts_accepted_rows_only(spark, tmp_path):
    times = [0, 10, 20, 30, 3_590, 3_605, 3_611, 7_300]
    rows = [(i, 1, START + timedelta(seconds=t)) for i, t in enumerate(times)] + [(100, 2, START)]
    spark.createDataFrame(rows, "id long, api_key long, submitted_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, api_key long, submitted_at timestamp").parquet(str(tmp_path / "in"))
    C.drain(L.rate_limit(stream, limit=3), str(tmp_path / "out"), str(tmp_path / "ck"), conf=L.STORE)
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept, want = [], {}
    for i, t in enumerate(times):
        kept = [k for k in kept if k >= t - 3600]
        want[i] = len(kept) < 3
        kept += [t] if want[i] else []
    assert got == {**want, 100: True}


def test_rate_limit_orders_a_key_over_all_its_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    times = rng.integers(0, 40_000, 25_000)
    rows = [(i, 1, START + timedelta(seconds=int(t))) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "id long, api_key long, submitted_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, api_key long, submitted_at timestamp").parquet(str(tmp_path / "in"))
    C.drain(L.rate_limit(stream), str(tmp_path / "out"), str(tmp_path / "ck"), conf=L.STORE)
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept, want = [], {}
    for t, i in sorted((int(t), i) for i, t in enumerate(times)):
        want[i] = sum(k >= t - 3600 for k in kept) < 60
        kept += [t] if want[i] else []
    assert got == want


def test_trailing_counts(spark):
    times = [0, 5, 3_599, 3_604, 3_606, 9_000]
    d = spark.createDataFrame([(i, 1, START + timedelta(seconds=t)) for i, t in enumerate(times)], "id long, api_key long, submitted_at timestamp")
    got = {r.id: r.recent for r in L.trailing_counts(d).collect()}
    assert got == {i: sum(t - 3600 <= u < t for u in times) for i, t in enumerate(times)}


def test_access_counts_wait_for_the_watermark(spark, tmp_path):
    rows = [(START + timedelta(hours=h), "d") for h in (1, 2, 25, 50)]
    spark.createDataFrame(rows, "ts timestamp, dataset string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, dataset string").parquet(str(tmp_path / "in"))
    C.drain(L.access_counts(stream, ["dataset"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def doc(**changes):
    d = {
        "benchmark": "survey", "config": {"dataset": "gss", "provider": "p"}, "aggregate": {"n_questions": 1, "composite_parity": 0.5},
        "per_question": [{"human_distribution": {"a": 0.5, "b": 0.5}, "model_distribution": [0.25, 0.75]}],
    }
    d.update(changes)
    return json.dumps(d)


DOCS = {
    "ok": (doc(), None), "list": ("[]", "body is not a JSON object"), "marker": (doc(benchmark="x"), "wrong benchmark marker"),
    "count": (doc(aggregate={"n_questions": 2}), "n_questions does not match per_question"),
    "range": (doc(aggregate={"n_questions": 1, "composite_parity": 1.5}), "composite_parity outside [0, 1]"),
    "sum": (doc(per_question=[{"human_distribution": {"a": 0.5, "b": 0.4}}]), "invalid distribution"),
    "negative": (doc(per_question=[{"model_distribution": {"a": -0.5, "b": 1.5}}]), "invalid distribution"),
    "text": (doc(per_question=[{"model_distribution": {"a": "x"}}]), "invalid distribution"),
    "row": (doc(per_question=[3]), "per_question entry is not an object"),
}


def test_intake_gate_and_idempotence(spark, tmp_path):
    rows = [(k, v[0]) for k, v in DOCS.items()]
    for part in ("a", "b"):
        spark.createDataFrame(rows, "run_id string, raw string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("run_id string, raw string").parquet(str(tmp_path / "in"))
        I.run_intake(stream, "survey", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out" / "rejected")).drop("batch").unionByName(spark.read.parquet(str(tmp_path / "out" / "accepted")).drop("batch"))
    assert {r.run_id: r.reason for r in got.collect()} == {k: v[1] for k, v in DOCS.items()}
    assert got.count() == len(DOCS)
    assert got.where(F.col("status") == "validating").first().model_name == "p"


def batches(spark, folder, groups, schema):
    """One file per group, read one per micro-batch in this order."""
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/src{i}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        (name,) = [n for n in os.listdir(f"{folder}/src{i}") if n.endswith(".parquet")]
        os.link(f"{folder}/src{i}/{name}", f"{folder}/in/{i:04}.parquet")
        os.utime(f"{folder}/in/{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_rate_limit_over_batches_equals_a_replay_with_late_rows(spark, tmp_path):
    rng = np.random.default_rng(12)
    groups, i = [], 0
    for b in range(8):
        rows = []
        for _ in range(120):
            t = b * 1500 + int(rng.integers(0, 1500)) - (int(rng.integers(0, 1500)) if rng.random() < 0.3 else 0)
            rows.append((i, int(rng.integers(0, 4)), START + timedelta(seconds=max(t, 0))))
            i += 1
        if b == 5:
            rows += [(10_000 + k, 1, START + timedelta(seconds=k)) for k in range(3)]  # hours late
        groups.append(rows)
    stream = batches(spark, str(tmp_path), groups, "id long, api_key long, submitted_at timestamp")
    C.drain(L.rate_limit(stream, 7, 1200, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"), conf=L.STORE)
    got = {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    held, want = defaultdict(list), {}
    for rows in groups:
        for id_, key, at in sorted((r for r in rows if r[0] < 10_000), key=lambda r: (r[2], r[0])):
            recent = [h for h in held[key] if at - timedelta(seconds=1200) <= h <= at]
            want[id_] = len(recent) < 7
            held[key] += [at] if want[id_] else []
    assert got == want and 0 < sum(want.values()) < len(want)


def test_rate_limit_forgets_keys_that_left_the_window(spark, tmp_path):
    groups = [[(b * 100 + k, b * 100 + k, START + timedelta(hours=3 * b)) for k in range(50)] for b in range(6)]
    stream = batches(spark, str(tmp_path), groups, "id long, api_key long, submitted_at timestamp")
    progress = C.drain(L.rate_limit(stream, delay="10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"), conf=L.STORE)
    rows = [op["numRowsTotal"] for p in map(lambda p: json.loads(p.json), progress) for op in p["stateOperators"]]
    assert max(rows) <= 2.5 * rows[0]  # two groups of keys at most, not six
    assert spark.read.parquet(str(tmp_path / "out")).where("allowed").count() == 300


def test_busy_windows_equal_counting(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), START + timedelta(seconds=int(rng.integers(0, 20_000)))) for i in range(400)]
    stream = batches(spark, str(tmp_path), [rows], "id long, api_key long, submitted_at timestamp")
    C.drain(L.busy_windows(stream, 20, 3600, 900, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.api_key, int((r.start - START).total_seconds())): (r.n, r.over) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    at = [(k, int((t - START).total_seconds())) for _, k, t in rows]
    last = max(t for _, t in at) - 600
    want = defaultdict(int)
    for k, t in at:
        for s in range(t // 900 * 900 - 2700, t + 1, 900):
            want[k, s] += 1
    assert got == {(k, s): (n, n > 20) for (k, s), n in want.items() if s + 3600 <= last}


def test_intake_state_is_flat_and_ids_are_taken_for_ever(spark, tmp_path):
    schema = "run_id string, raw string, at timestamp"
    groups = [[(f"r{b}-{i}", doc(), START + timedelta(days=3 * b)) for i in range(40)] for b in range(6)]
    groups[4] += [("r0-7", doc(), START + timedelta(days=12)), (None, doc(), START + timedelta(days=12)), (None, "[]", START + timedelta(days=12))]
    groups[5] += [("r5-1", "[]", START + timedelta(days=15)), ("r4-3", doc(), START + timedelta(days=15))]
    stream = batches(spark, str(tmp_path), groups, schema)
    progress = I.run_intake(stream, "survey", str(tmp_path / "out"), str(tmp_path / "ck"), arrival=F.col("at"))
    state = [op["numRowsTotal"] for p in map(lambda p: json.loads(p.json), progress) for op in p["stateOperators"] if op["numRowsTotal"]]
    assert len(state) >= 6 and max(state) <= 90  # two batches of ids at most
    accepted, rejected = (spark.read.parquet(str(tmp_path / "out" / n)) for n in ("accepted", "rejected"))
    ids = [r.run_id for r in accepted.collect()]
    assert ids.count("r0-7") == ids.count("r4-3") == 1 and ids.count(None) == 1
    assert [r.run_id for r in rejected.collect() if r.run_id is None] == [None]
    assert len(ids) + rejected.count() == 240 + 2
    assert spark.read.parquet(str(tmp_path / "out" / "taken")).count() == 240


def test_a_batch_run_again_leaves_the_same_rows(spark, tmp_path):
    taken = str(tmp_path / "taken")
    first = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3")], "run_id string, raw string")
    assert sorted(r.run_id for r in I.not_taken(first, 0, taken).collect()) == ["a", "b"]
    done = I.not_taken(first, 0, taken).select("run_id", "bucket", F.lit(0).cast("bigint").alias("batch"))
    done.write.partitionBy("bucket", "batch").parquet(taken)
    assert sorted(r.run_id for r in I.not_taken(first, 0, taken).collect()) == ["a", "b"]
    later = spark.createDataFrame([("a", "1"), ("c", "2")], "run_id string, raw string")
    assert [r.run_id for r in I.not_taken(later, 1, taken).collect()] == ["c"]
