"""Adversarial submissions: each must fire its own codes and the honest one none."""

import hashlib
import json
import math
import random

import pytest

from pollmirror.operators import quality as V
from pollmirror.operators import scoring as S
from pollmirror.sources import runs as RS
from pollmirror.sources import sinks as K

N = 120
OPTIONS = ["A", "B", "C", "D"]


def private(key):
    return int(hashlib.sha256(f"opinionsqa:{key}".encode()).hexdigest()[:8], 16) % 100 < 20


def norm(p):
    p = [max(x, 0.0) for x in p]
    return [x / sum(p) for x in p]


def human(i):
    r = random.Random(i)
    return norm([r.random() ** 2 + 0.02 for _ in OPTIONS])


def noisy(p, size, seed):
    r = random.Random(seed)
    return norm([x + r.uniform(-size, size) for x in p])


def jsd(p, q):
    s = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        s += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return s / 2


def tau(p, q):
    sign = lambda x: (x > 0) - (x < 0)
    c = pp = qq = 0
    for i in range(len(p)):
        for j in range(i):
            a, b = sign(p[i] - p[j]), sign(q[i] - q[j])
            c, pp, qq = c + a * b, pp + a * a, qq + b * b
    return c / math.sqrt(pp * qq) if pp * qq else 0.0


def document(model, keep=lambda k: True, version=1, raw=None, keys=None, **changes):
    rows = []
    for i in range(N):
        key = (keys or "Q{}").format(i)
        if not keep(key):
            continue
        h, m = human(i), model(i, human(i), key)
        rows.append({
            "key": key, "text": "t", "options": OPTIONS, "human_distribution": dict(zip(OPTIONS, h)), "model_distribution": dict(zip(OPTIONS, m)),
            "jsd": jsd(h, m), "kendall_tau": tau(h, m), "n_samples": 100, "model_refusal_rate": 0.0, "human_refusal_rate": 0.0,
        })
    mj, mt = (sum(r[c] for r in rows) / len(rows) for c in ("jsd", "kendall_tau"))
    names = [r["key"] for r in rows] if not keys else [f"Q{i}" for i in range(N)]
    doc = {
        "benchmark": "survey", "schema_version": version, "version": "1", "timestamp": "2026-01-01T00:00:00Z",
        "config": {"dataset": "opinionsqa", "provider": "x/model", "question_set_hash": hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()},
        "aggregate": {"mean_jsd": mj, "mean_kendall_tau": mt, "composite_parity": ((1 - mj) + (1 + mt) / 2) / 2, "n_questions": len(rows)},
        "scores": {"p_dist": 1 - mj, "p_rank": (1 + mt) / 2}, "per_question": rows,
    }
    if raw:
        doc["raw_responses"] = [{"key": r["key"], "raw_text": "answer", "selected_option": raw(r)} for r in rows]
    for path, value in changes.items():
        block, name = path.split("__")
        doc[block][name] = value
    return doc


def honest(i, h, k):
    return noisy(h, 0.25, i + 7)


top = lambda r: max(r["model_distribution"], key=r["model_distribution"].get)
low = lambda r: min(r["model_distribution"], key=r["model_distribution"].get)

DOCS = {
    "honest": document(honest, raw=top),
    "pure_copy": document(lambda i, h, k: h),
    "near_pure_copy": document(lambda i, h, k: noisy(h, 0.004, i)),
    "public_copy": document(lambda i, h, k: norm(list(reversed(h))) if private(k) else noisy(h, 0.004, i)),
    "constant_offset": document(lambda i, h, k: norm([x + 0.05 for x in h])),
    "bounds": document(honest, aggregate__mean_jsd=1.4),
    "lied": document(honest, aggregate__mean_jsd=0.0, aggregate__mean_kendall_tau=0.99, aggregate__composite_parity=0.99),
    "no_private": document(honest, keep=lambda k: not private(k)),
    "wrong_keys": document(honest, keys="OTHER{}"),
    "uniform": document(lambda i, h, k: [0.25] * 4),
    "desync": document(honest, version=2, raw=low),
}
MUST = {
    "pure_copy": ["ANOMALY_PERFECTION", "ANOMALY_CONSTANT_OFFSET"], "near_pure_copy": ["ANOMALY_PERFECTION"], "public_copy": ["HOLDOUT_DIVERGENCE", "ANOMALY_NEAR_COPY_PUBLIC"],
    "constant_offset": ["ANOMALY_CONSTANT_OFFSET"], "bounds": ["BOUNDS_RANGE"], "lied": ["AGG_MEAN_JSD", "AGG_MEAN_TAU", "AGG_COMPOSITE"],
    "no_private": ["HOLDOUT_MISSING_PRIVATE"], "wrong_keys": ["QSET_HASH"], "desync": ["RAW_RESPONSES_MODE"],
}


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    for name, doc in DOCS.items():
        (root / f"{name}.json").write_text(json.dumps(doc))
    (root / "broken.json").write_text("{ not json")
    (root / "foreign.json").write_text(json.dumps({"benchmark": "else"}))
    docs = RS.scan_runs(spark, str(root), "survey")
    runs, questions, raw = RS.runs_of(docs), RS.questions_of(docs), RS.raw_of(docs)
    hashes = S.question_set_hash(questions, ["run_id"]).select("run_id", "question_set_hash")
    issues = V.validate(runs, questions, raw, RS.scan_bronze(spark, str(root)), "survey", hashes, tier3=True).collect()
    return docs, questions, issues, str(root)


def codes(issues, run, severity=None):
    return {i.code for i in issues if i.run_id == run and (severity is None or i.severity == severity)}


def test_scan_keeps_only_our_documents(checked):
    docs, questions, _, _ = checked
    assert {r.run_id for r in docs.select("run_id").collect()} == set(DOCS)
    assert questions.where("run_id = 'honest'").count() == N


@pytest.mark.parametrize("run", sorted(MUST))
def test_attack_fires(checked, run):
    assert set(MUST[run]) <= codes(checked[2], run)


def test_honest_and_uniform_runs_have_no_errors(checked):
    assert codes(checked[2], "honest", "error") == set() and codes(checked[2], "uniform", "error") == set()


def test_schema_two_turns_desync_into_an_error(checked):
    assert "RAW_RESPONSES_MODE" in codes(checked[2], "desync", "error")


def test_broken_documents_are_schema_errors(checked):
    assert codes(checked[2], "broken") == {"SCHEMA_ROOT"}
    assert {"SCHEMA_BENCHMARK", "SCHEMA_MISSING"} <= codes(checked[2], "foreign")


def test_uniform_run_without_refusals_is_invalid(checked):
    got = {r.run_id: r.invalid for r in V.run_validity(checked[1]).collect()}
    assert got["uniform"] and not got["honest"]


def test_routed_sink(spark, tmp_path):
    d = spark.createDataFrame([("a", "gss", "full"), ("b", "subpop", "gated"), ("c", "pilot", "aggregates_only")], "run_id string, dataset string, tier string")
    K.write_routed(d, str(tmp_path / "pub"), str(tmp_path / "res"))
    assert [r.run_id for r in spark.read.json(str(tmp_path / "pub")).collect()] == ["a"]
    assert [r.run_id for r in spark.read.json(str(tmp_path / "res")).collect()] == ["b"]
