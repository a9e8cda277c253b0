import json

import pytest
from pyspark.sql import functions as F

from pollmirror.functions import tables as T
from pollmirror.functions import text as X
from pollmirror.sources import runs as RS
from pollmirror.sources import surveys as V


def table(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), {})[r.option] = round(r.p, 9)
    return out


COUNTS = """question_id,question_text,{s},option,count
Q1,Do you?,2018,Yes,30
Q1,Do you?,2018,No,10
Q1,Do you?,2020,No,20
Q1,Do you?,2020,Maybe,0
Q1,Do you?,2020,,5
Q1,Do you?,2020,Yes,many
Q2,,2018,Yes,3
"""


@pytest.mark.parametrize("stratum", ["year", "country"])
def test_count_table(spark, tmp_path, stratum):
    path = tmp_path / "c.csv"
    path.write_text(COUNTS.format(s=stratum))
    raw = V.read_csv(spark, str(path), ["question_id", "question_text", stratum, "option", "count"])
    one = V.count_table(raw, stratum, "GSS_", "2018").collect()
    assert table(one, "key") == {("GSS_Q1",): {"Yes": 0.75, "No": 0.25}}
    both = V.count_table(raw, stratum, "GSS_").collect()
    assert table(both, "key") == {("GSS_Q1",): {"Yes": 0.5, "No": 0.5}}
    assert [r.option for r in sorted(both, key=lambda r: r.pos)] == ["Yes", "No"]


def test_lines_are_ordered_over_files(spark, tmp_path):
    for name, answers in (("part-2.csv", ["old"]), ("part-10.csv", ["new"] * 3000)):
        (tmp_path / name).write_text("respondent_id,option\n" + "".join(f"r,{a}{i}\n" for i, a in enumerate(answers)))
    raw = V.read_csv(spark, str(tmp_path), ["respondent_id", "option"])
    last = raw.groupBy("respondent_id").agg(F.max_by("option", "seq").alias("last"), F.min_by("option", "seq").alias("first")).first()
    assert (last["first"], last["last"]) == ("old0", "new2999")


def test_latest_wave_is_the_largest_number(spark):
    rows = [(w, "SEX", "K", "x", o, n) for w, o, n in (("W99", "a", 1.0), ("W100", "b", 1.0))]
    d = spark.createDataFrame(rows, "wave_dir string, attribute string, key string, `group` string, option string, n double")
    assert {r.wave_dir for r in V.group_distributions(d).collect()} == {"W100"}


def test_mistyped_fields_lose_no_document(spark, tmp_path):
    good = {"benchmark": "survey", "config": {"dataset": "d"}, "aggregate": {"n_questions": 5, "mean_jsd": 0.2}}
    texts = {
        "a": json.dumps(good),
        "b": json.dumps(good | {"aggregate": {"n_questions": "five", "mean_jsd": 0.2}, "scores": [1], "per_question": [{"key": "k", "jsd": "x"}, 3]}),
        "c": json.dumps(good | {"aggregate": {"n_questions": 5, "mean_jsd": float("nan")}}),
        "d": "[1]",
        "e": "no document",
        "f": "{}",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    docs = RS.scan_runs(spark, str(tmp_path), "survey")
    runs = {r.run_id: r for r in RS.runs_of(docs).collect()}
    assert set(runs) == {"a", "b", "c"} == {r.run_id for r in docs.select("run_id").collect()}
    assert [runs[k].n_questions for k in "abc"] == [5, None, 5] and runs["b"].mean_jsd == 0.2 and runs["b"].dataset == "d"
    assert runs["b"].sps is None


def test_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("question_id,option\nQ1,Yes\n")
    with pytest.raises(ValueError, match="count"):
        V.read_csv(spark, str(path), ["question_id", "count"])


def test_microdata(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(
        "respondent_id,year,question_id,option,subgroup_age_band\n1,2018,A,x,18-34\n1,2018,A,y,35-49\n1,2018,B,z,\n2,2018,A,,18-34\n2,2020,B,w,\n"
    )
    raw = V.read_csv(spark, str(path), ["respondent_id", "year", "question_id", "option"])
    rows = V.microdata(raw, "GSS_")
    got = {r.respondent_id: (r.responses, r.subgroup) for r in rows.collect()}
    assert got == {"1@2018": ({"GSS_A": "y", "GSS_B": "z"}, {"age_band": "18-34"}), "2@2020": ({"GSS_B": "w"}, {})}
    assert [r.respondent_id for r in V.microdata_for_question(raw, "A", "GSS_").collect()] == ["1@2018"]
    (one,) = V.microdata_for_question(raw, "GSS_A", "GSS_").collect()
    assert (one.responses, one.subgroup) == ({"GSS_A": "y", "GSS_B": "z"}, {"age_band": "18-34"})


@pytest.fixture
def waves(tmp_path):
    entry = {"MC_options": ["a", "b"], "question_text": "q", "x": {"a": 30.0, "b": 10.0}, "nan": {"a": 10.0, "b": 50.0}, "empty": {"a": 0.0, "b": 0.0}}
    for wave, files in {"W26": {"NONE": entry, "SEX": {"x": {"a": 1.0}}}, "W27": {"SEX": entry, "AGE": entry}}.items():
        d = tmp_path / wave
        d.mkdir()
        (d / "info.csv").write_text('key,question,references\nK1,"Text, one","[\'a\', \'b\']"\nK2,None,"a, b"\n')
        for attr, e in files.items():
            (d / f"{attr}_data.json").write_text(json.dumps({"K1": e, "note": "text"}))
    return str(tmp_path)


def test_wave_files(spark, waves):
    files, info = V.read_wave_files(spark, waves), V.read_wave_info(spark, waves)
    assert {(r.wave_dir, r.attribute) for r in V.preferred_files(files).collect()} == {("W26", "NONE"), ("W27", "AGE")}
    rows = V.wave_questions(files, info).collect()
    assert table(rows, "wave_dir", "key") == {(w, "K1"): {"a": 0.4, "b": 0.6} for w in ("W26", "W27")}
    assert {r.options[0] for r in rows} == {"a"} and {r.text for r in rows} == {"Text, one"}
    assert {r.key for r in V.wave_questions(files, info, key_prefix=True).collect()} == {"W26:K1", "W27:K1"}
    groups = V.group_distributions(V.wave_counts(files)).where("attribute = 'SEX'").collect()
    assert {(r.wave_dir, r.group) for r in groups} == {("W27", "x")}


def test_country_rows(spark):
    d = spark.createDataFrame([(0, "Q?", [0.0, 1.0], {"A": [0.2, 0.8], "B": [0.6, 0.4]})], "i int, text string, options array<double>, selections map<string,array<double>>")
    rows = V.country_questions(d).collect()
    assert {r.option: round(r.p, 9) for r in rows} == {"0.0": 0.4, "1.0": 0.6} and rows[0].key.startswith("GOQA_0_")
    assert {r.option: r.p for r in V.country_questions(d, "B").collect()} == {"0.0": 0.6, "1.0": 0.4}
    assert [r.country for r in V.available_countries(d).collect()] == ["A", "B"]


def test_subgroup_rows(spark):
    rows = [("K", "Sex", "m", ["a", "Refused"], [0.8], 0.2, 1), ("K", "Sex", "f", ["a", "Refused"], [0.6, 0.4], 0.0, 2), ("K", "Sex", "z", ["a", "b"], [1.0], 0.3, 3)]
    d = V.align_refusal(spark.createDataFrame(rows, "qkey string, attribute string, group string, options array<string>, responses array<double>, refusal_rate double, seq int"))
    assert {r.option: round(r.p, 9) for r in V.subgroup_questions(d).collect()} == {"a": 0.7, "Refused": 0.3}
    assert {r.group for r in V.subgroup_distributions(d, "SEX").collect()} == {"m", "f"}


def test_monthly(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("date,group,BETTER,Same\n2024-01,x,30,70\n2024-02,x,40,60\n2024-03,x,,60\n2024-04,x,bad,1\n2024-05,y,0,0\n")
    d = V.read_csv(spark, str(path), ["date"])
    assert {r.option: round(r.p, 9) for r in V.monthly(d, ["Better", "Same"], []).collect()} == {"Better": 0.35, "Same": 0.65}
    assert {r.group for r in V.monthly(d, ["Better", "Same"], ["group"]).collect()} == {"x"}
    assert V.monthly(d, ["Better", "Worse"], []).count() == 0


def test_proportions(spark):
    rows = [('"Nov 2021"', "v1", "Uses it", "isAdult", "0.4", "0.3", ""), ("D", "v2", "", "", "", "0.5", "1.2"), ("D", "isAdult", "", "", "0.5", "0.5", "0.5")]
    d = spark.createDataFrame(rows, "dataset string, variable string, description string, universe string, usProp string, sexMaleProp string, sexFemaleProp string")
    got = V.proportion_questions(d).collect()
    assert {(r.key, r.text, r.option): round(r.p, 9) for r in got} == {
        ("NTIA_Nov_2021_v1_isAdult", "Uses it (among adults)?", "Yes"): 0.4, ("NTIA_Nov_2021_v1_isAdult", "Uses it (among adults)?", "No"): 0.6,
    }
    assert {(r.key, r.group) for r in V.proportion_groups(d, "sex").collect()} == {("NTIA_Nov_2021_v1_isAdult", "Male"), ("NTIA_D_v2_all", "Male")}


def test_cached_questions_prune_by_dataset(spark, tmp_path):
    d = spark.createDataFrame([("gss", "K", "a", 1.0), ("wvs", "L", "b", 1.0)], "dataset string, key string, option string, p double")
    V.write_questions(d, str(tmp_path / "q"))
    got = V.cached_questions(spark, str(tmp_path / "q"), "gss")
    assert [r.key for r in got.collect()] == ["K"]
    assert "PartitionFilters: [isnotnull(dataset" in got._jdf.queryExecution().toString()


def test_bronze_keeps_every_document_and_types_the_own_ones(spark, tmp_path):
    texts = {
        "ok_20260102_030405": '{"benchmark": "survey", "config": {"dataset": "gss", "temperature": "hot"}, "scores": {"sps": 0.5}, "per_question": [{"key": "a", "jsd": 0.25}]}',
        "foreign": '{"benchmark": "other"}', "list": "[1]", "cut": '{"benchmark": "survey"',
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    (tmp_path / "in" / "notes.md").write_text("not a document")
    RS.write_bronze(spark, str(tmp_path / "in"), str(tmp_path / "bronze"))
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    status = {r.run_id: (r.status, r.raw, r.file_size) for r in RS.bronze_status(bronze, "survey").collect()}
    kinds = {"ok_20260102_030405": "ok", "foreign": "foreign", "list": "foreign", "cut": "corrupt"}
    assert status == {k: (kinds[k], t if kinds[k] == "corrupt" else None, len(t)) for k, t in texts.items()}
    (r,) = RS.bronze_runs(bronze, "survey").collect()
    assert (r.run_id, r.config.dataset, r.config.temperature, r.scores.sps, r.per_question[0].jsd) == ("ok_20260102_030405", "gss", None, 0.5, 0.25)
    (tmp_path / "tree" / "run_id=a b").mkdir(parents=True)
    (tmp_path / "tree" / "run_id=a b" / "part.json").write_text('{"benchmark": "survey"}')
    RS.write_bronze(spark, str(tmp_path / "tree"), str(tmp_path / "bronze2"))
    assert [r.run_id for r in spark.read.parquet(str(tmp_path / "bronze2")).collect()] == ["a b"]


def test_refreshing_one_dataset_leaves_the_others(spark, tmp_path):
    path, schema = str(tmp_path / "q"), "dataset string, key string, option string, p double"
    V.write_questions(spark.createDataFrame([("gss", "a", "x", 0.5), ("gss", "b", "x", 0.5), ("wvs", "a", "y", 1.0)], schema), path)
    V.write_questions(spark.createDataFrame([("gss", "a", "x", 0.75)], schema), path)
    got = sorted((r.dataset, r.key, r.p) for r in V.cached_questions(spark, path).collect())
    assert got == [("gss", "a", 0.75), ("wvs", "a", 1.0)]
    one = V.cached_questions(spark, path, "wvs")
    assert [r.key for r in one.collect()] == ["a"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "= wvs" in plan


def test_waves_by_name_pattern(spark):
    d = spark.createDataFrame([("W1",), ("Tech_W10",), ("Tech_W2",), ("TechxW3",), ("W.1",)], "wave_dir string")
    names = lambda glob: sorted(r.wave_dir for r in V.in_waves(d, glob).collect())
    assert names("*") == sorted(["W1", "Tech_W10", "Tech_W2", "TechxW3", "W.1"])
    assert names("Tech_W?") == ["Tech_W2"] and names("Tech_*") == ["Tech_W10", "Tech_W2"] and names("W.*") == ["W.1"]


def test_topic_by_automaton_equals_substring_search(spark):
    import numpy as np

    words = [w for ws in T.TOPICS.values() for w in ws]
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([*words, "zzz", "THE", "Qx", "İ"], int(rng.integers(1, 5)))).title()[int(rng.integers(0, 3)) :] for _ in range(500)] + [None, "", "x", "elec", "ELECTION"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    low = {r.i: r.low for r in d.selectExpr("i", "lower(text) AS low").collect()}
    want = {i: next((n for n, ws in T.TOPICS.items() if any(w in t for w in ws)), T.FALLBACK_TOPIC) if t else None for i, t in low.items()}
    assert {r.i: r.t for r in d.select("i", X.topic(F.col("text")).alias("t")).collect()} == want
    own = {"first": ["ab", "bc"], "second": ["ab", "cd"]}
    got = d.limit(1).select(X.topic(F.lit("XABX"), own).alias("a"), X.topic(F.lit("cd"), own).alias("b"), X.topic(F.lit("q"), own).alias("c")).first()
    assert tuple(got) == ("first", "second", T.FALLBACK_TOPIC)
