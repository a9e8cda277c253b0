"""Run documents of any size: written line by line, kept in parts, read part by part."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pollmirror.sources import runs as R
from pollmirror.sources import sinks as K

ROWS = [{"key": f'q"{i}}}]\\', "jsd": i / 64, "options": ["a,b", "]"], "human_distribution": {"{": 0.5}} for i in range(60)]
DOC = {"benchmark": "survey", "config": {"dataset": "d", "ensemble_sources": [{"file": "x"}, {"file": "y"}]}, "raw_responses": [], "per_question": ROWS, "scores": {"sps": 0.5}}


def cut(text: bytes, part_bytes: int, seed: int = 1) -> list[tuple[int, bytes]]:
    c, rng, out = R.Cutter(part_bytes), random.Random(seed), []
    while text:
        n = rng.randint(1, 40)
        out += c.feed(text[:n])
        text = text[n:]
    return [*out, *c.end()]


@pytest.mark.parametrize("indent", [None, 2])
def test_parts_hold_the_whole_document(indent):
    parts = cut(json.dumps(DOC, indent=indent).encode(), 300)
    assert [p for p, _ in parts] == [*range(1, len(parts)), 0] and len(parts) > 5
    assert max(len(t) for _, t in parts) < 700
    assert json.loads(parts[-1][1]) == DOC | {"per_question": []}
    assert [q for _, t in parts[:-1] for q in json.loads(t)["per_question"]] == ROWS


def valid(text: bytes) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@pytest.mark.parametrize("change", [lambda t: t[:-1], lambda t: t[:-40], lambda t: t.replace(b"}], \"scores", b"},], \"scores"), lambda t: t.replace(b"}, {\"key", b"},, {\"key", 1), lambda t: t + b"}", lambda t: t.replace(b"0.5", b"x", 1)])
def test_a_broken_document_has_a_broken_part(change):
    text = change(json.dumps(DOC).encode())
    for part_bytes in (1, 100, 300, 10**6):
        assert not all(valid(t) for _, t in cut(text, part_bytes))


def test_large_files_are_kept_in_parts_and_typed_the_same(spark, tmp_path, monkeypatch):
    whole = json.dumps(DOC, indent=1)
    texts = {"ok": whole, "line": json.dumps(DOC), "cut": whole[:-1], "tail": whole + "\n", "foreign": whole.replace("survey", "other"), "tiny": '{"benchmark": "survey"}'}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    found = {}
    for size in (1 << 20, 200):
        monkeypatch.setattr(R, "WHOLE_BYTES", size)
        R.write_bronze(spark, str(tmp_path / "in"), str(tmp_path / f"out{size}"), part_bytes=500)
        b = spark.read.parquet(str(tmp_path / f"out{size}"))
        assert b.where("part = 0").count() == len(texts) and (b.where("part > 0").count() > 20) == (size == 200)
        status = {r.run_id: r.status for r in R.bronze_status(b, "survey").collect()}
        assert status == {k: "corrupt" if k == "cut" else "foreign" if k == "foreign" else "ok" for k in texts}
        found[size] = sorted(R.bronze_runs(b, "survey").collect(), key=lambda r: r.run_id)
    assert found[200] == found[1 << 20] and [len(r.per_question or []) for r in found[200]] == [60, 60, 60, 0]


def test_documents_are_written_without_being_gathered(spark, tmp_path):
    runs = spark.createDataFrame([("a b", "survey", 1.5), ("none", "survey", 0.0), ("c", None, 2.5)], "run_id string, benchmark string, sps double")
    rows = [(r, f"k{i:03}", i / 8) for r in ("a b", "c") for i in range(50)]
    questions = spark.createDataFrame(rows, "run_id string, key string, jsd double").repartition(7)
    K.write_run_documents(runs, questions, str(tmp_path / "docs"), tail=F.when(F.col("run_id") == "c", "]").otherwise("]}"))
    texts = {p.parent.name: p.read_text() for p in (tmp_path / "docs").glob("*/*.txt")}
    want = [{"key": f"k{i:03}", "jsd": i / 8} for i in range(50)]
    assert set(texts) == {"run_id=a b", "run_id=c"}
    assert json.loads(texts["run_id=a b"]) == {"benchmark": "survey", "sps": 1.5, "per_question": want}
    assert not valid(texts["run_id=c"].encode()) and json.loads(texts["run_id=c"] + "}") == {"sps": 2.5, "per_question": want}
