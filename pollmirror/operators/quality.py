"""Row-emitting checks of submitted runs: shape, bounds, recomputation and anomalies.

Every check returns ``issues(run_id, tier, code, severity, path)``. Run-level rules are
evaluated side by side on one row and exploded once; question-level rules are row-local;
only the statistics need a (map-side combined) aggregate per run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import tables as T
from ..functions import text as X
from ..streaming.common import shared_folder
from .scoring import score_pairs

TOP_KEYS = ["benchmark", "version", "config", "aggregate", "per_question"]
CONFIG_KEYS = ["dataset", "provider"]
AGGREGATE_KEYS = ["mean_jsd", "mean_kendall_tau", "composite_parity", "n_questions"]
QUESTION_KEYS = ["key", "human_distribution", "model_distribution", "jsd", "kendall_tau"]
REPRO_KEYS = ["seed", "model_revision_hash", "prompt_template_hash", "framework_version", "submitted_at"]
GRADUATED = ["RAW_RESPONSES_MISSING", "RAW_RESPONSES_MODE"]
CURRENT_SCHEMA = 2


def issue(cond: Column, code: str, path: Column | str, severity: str = "error") -> Column:
    p = F.lit(path) if isinstance(path, str) else path
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), p.alias("path")))


def emit(df: DataFrame, tier: int, issues: list[Column], keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return df.select(*keys, F.explode(F.array_compact(F.array(*issues))).alias("_i")).select(
        *keys, F.lit(tier).alias("tier"), "_i.code", "_i.severity", "_i.path"
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# --- tier 1: shape and plausibility -------------------------------------------------


def v_schema(bronze: DataFrame, marker: str) -> DataFrame:
    """Required keys and types on the raw text; absent, null and wrong type are told apart.

    ``bronze``: run_id, raw. The text is parsed once to VARIANT; nothing is inferred.
    """
    d = bronze.select("run_id", F.try_parse_json("raw").alias("v"))
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("NONE"))
    get = lambda v, p: F.try_variant_get(v, p, "variant")
    is_object = lambda v: kind(v).startswith("OBJECT")
    absent = lambda v, key: get(v, f"$.{key}").isNull()
    d = d.withColumn("ok", is_object(F.col("v")))
    v, ok = F.col("v"), F.col("ok")
    rules = [
        issue(~ok, "SCHEMA_ROOT", ""),
        issue(ok & ~F.try_variant_get(v, "$.benchmark", "string").eqNullSafe(F.lit(marker)), "SCHEMA_BENCHMARK", "benchmark"),
    ]
    rules += [issue(ok & absent(v, k), "SCHEMA_MISSING", k) for k in TOP_KEYS]
    for block, keys in (("config", CONFIG_KEYS), ("aggregate", AGGREGATE_KEYS)):
        b = get(v, f"$.{block}")
        real = b.isNotNull() & ~F.is_variant_null(b)
        rules.append(issue(ok & real & ~is_object(b), "SCHEMA_TYPE", block))
        rules += [
            issue(ok & is_object(b) & absent(v, f"{block}.{k}"), "SCHEMA_MISSING", f"{block}.{k}") for k in keys
        ]
    pq = get(v, "$.per_question")
    rules.append(
        issue(ok & pq.isNotNull() & ~F.is_variant_null(pq) & ~kind(pq).startswith("ARRAY"), "SCHEMA_TYPE", "per_question")
    )
    top = emit(d, 1, rules)
    rows = d.where(kind(pq).startswith("ARRAY")).select(
        "run_id", F.posexplode(F.try_variant_get(v, "$.per_question", "array<variant>")).alias("i", "q")
    )
    q = F.col("q")
    at = F.concat(F.lit("per_question["), F.col("i"), F.lit("]"))
    per_row = [issue(~is_object(q), "SCHEMA_TYPE", at)]
    per_row += [
        issue(is_object(q) & get(q, f"$.{k}").isNull(), "SCHEMA_MISSING", F.concat(at, F.lit(f".{k}"))) for k in QUESTION_KEYS
    ]
    return top.unionByName(emit(rows, 1, per_row))


def _outside(c: Column, lo: float, hi: float) -> Column:
    return c.isNotNull() & ~((c >= lo) & (c <= hi))


def v_bounds(runs: DataFrame) -> DataFrame:
    """Values outside their range. Columns a source lacks are skipped."""
    unit = [c for c in ("composite_parity", "mean_jsd", "median_jsd", "parse_failure_rate", "sps", "p_dist", "p_rank", "p_refuse", "p_sub", "p_cond") if c in runs.columns]
    rules = [issue(_outside(F.col(c), 0.0, 1.0), "BOUNDS_RANGE", c) for c in unit]
    rules.append(issue(_outside(F.col("mean_tau"), -1.0, 1.0), "BOUNDS_RANGE", "mean_kendall_tau"))
    rules.append(issue(F.col("n_questions") < 0, "BOUNDS_RANGE", "n_questions"))
    return emit(runs, 1, rules)


def v_dist(questions: DataFrame) -> DataFrame:
    """Negative weights and sums off 1, for either side of a question."""
    rules = []
    for side in ("p_human", "p_model"):
        s = D.total(F.col(side))
        at = F.concat(F.col("key"), F.lit("." + side))
        rules.append(issue(F.exists(side, lambda x: x < -T.DIST_SUM_TOL), "DIST_NEGATIVE", at))
        rules.append(issue(F.exists(side, lambda x: x.isNull() | F.isnan(x)), "DIST_TYPE", at))
        rules.append(issue((s > T.DIST_SUM_TOL) & (F.abs(s - 1.0) > T.DIST_SUM_TOL), "DIST_SUM", at))
    return emit(questions, 1, rules)


def v_qset(runs: DataFrame, hashes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Reported hash against the recomputed one, and against the dataset's canonical one."""
    d = runs.select("run_id", "dataset", F.col("question_set_hash").alias("_r")).join(hashes, "run_id")
    rules = [issue(F.col("_r").isNotNull() & (F.col("_r") != F.col("question_set_hash")), "QSET_HASH", "config.question_set_hash")]
    if expected is not None:
        d = d.join(expected.select("dataset", F.col("question_set_hash").alias("_e")), "dataset", "left")
        rules.append(issue(F.col("_e") != F.col("question_set_hash"), "QSET_HASH_DATASET", "per_question"))
    return emit(d, 1, rules)


def v_count(runs: DataFrame, questions: DataFrame) -> DataFrame:
    n = questions.groupBy("run_id").agg(F.count("*").alias("_n"))
    d = runs.join(n, "run_id", "left")
    return emit(d, 1, [issue(F.col("n_questions") != F.coalesce("_n", F.lit(0)), "COUNT_MISMATCH", "aggregate.n_questions")])


def split_sps(questions: DataFrame) -> DataFrame:
    """Two-component score on the public and the private half, their distance and counts."""
    d = questions.withColumn("_p", X.is_private(F.col("dataset"), F.col("key")))
    scored = F.col("jsd").isNotNull() & F.col("tau").isNotNull()
    pick = lambda c, side: F.avg(F.when(scored & side, F.col(c)))
    pub, priv = ~F.col("_p"), F.col("_p")
    agg = d.groupBy("run_id", "dataset").agg(
        F.count_if(pub).alias("n_public"), F.count_if(priv).alias("n_private"),
        D.parity(pick("jsd", pub), pick("tau", pub)).alias("_a"), D.parity(pick("jsd", priv), pick("tau", priv)).alias("_b"),
        pick("jsd", pub).alias("_ja"), pick("jsd", priv).alias("_jb"),
    )
    return (
        agg.withColumn("sps_public", F.when(F.col("_ja").isNotNull(), F.col("_a")))
        .withColumn("sps_private", F.when(F.col("_jb").isNotNull(), F.col("_b")))
        .withColumn("delta", F.abs(F.col("sps_public") - F.col("sps_private")))
        .withColumn("flagged", F.coalesce(F.col("delta") > T.SPLIT_DELTA, F.lit(False)))
        .drop("_a", "_b", "_ja", "_jb")
    )


def v_holdout(questions: DataFrame, min_rows: int = 25) -> DataFrame:
    """Missing or thin private half, and scores that differ between the halves."""
    d = split_sps(questions).withColumn("_pct", X.holdout_percent(F.col("dataset")))
    total = F.col("n_public") + F.col("n_private")
    d = d.where((F.col("_pct") > 0) & (total >= min_rows))
    side = F.greatest(F.lit(1), F.least("n_public", "n_private"))
    limit = F.greatest(F.lit(T.SPLIT_DELTA), F.lit(0.5) / F.sqrt(side))
    return emit(
        d, 1,
        [
            issue(F.col("n_private") == 0, "HOLDOUT_MISSING_PRIVATE", "per_question"),
            issue((F.col("n_private") > 0) & (F.col("n_private") / total < F.col("_pct") / 400.0), "HOLDOUT_COVERAGE", "per_question"),
            issue((F.col("n_private") > 0) & (F.col("delta") > limit), "HOLDOUT_DIVERGENCE", "aggregate", "warning"),
        ],
    )


# --- tier 2: recomputation ----------------------------------------------------------


def v_perq(questions: DataFrame) -> DataFrame:
    """Reported jsd and tau against their recomputation from the stored distributions."""
    d = questions.withColumnRenamed("jsd", "_j").withColumnRenamed("tau", "_t")
    d = score_pairs(d.where("_j IS NOT NULL AND _t IS NOT NULL"))
    return emit(
        d, 2,
        [
            issue(F.col("jsd").isNull() | F.col("tau").isNull(), "RECOMPUTE_ERROR", F.col("key")),
            issue(F.abs(F.col("jsd") - F.col("_j")) > T.METRIC_TOL, "PER_Q_JSD", F.concat("key", F.lit(".jsd"))),
            issue(F.abs(F.col("tau") - F.col("_t")) > T.METRIC_TOL, "PER_Q_TAU", F.concat("key", F.lit(".kendall_tau"))),
        ],
    )


def v_reagg(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Reported means, composite and sub-scores against the per-question values."""
    ok = F.col("model_refusal_rate").isNotNull() & F.col("human_refusal_rate").isNotNull()
    agg = questions.groupBy("run_id").agg(
        F.avg("jsd").alias("_j"), F.avg("tau").alias("_t"), F.count("jsd").alias("_nj"), F.count("tau").alias("_nt"),
        F.avg(F.when(ok, F.abs(F.col("model_refusal_rate") - F.col("human_refusal_rate")))).alias("_r"),
    ).where("_nj > 0 AND _nj = _nt")
    d = runs.join(agg, "run_id")
    dist, rank = F.lit(1.0) - F.col("_j"), (F.lit(1.0) + F.col("_t")) / 2.0
    refuse = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("_r")))
    two = (dist + rank) / 2.0
    three = F.when(F.col("_r").isNull(), two).otherwise((dist + rank + refuse) / 3.0)
    off = lambda c, x: F.abs(F.col(c) - x) > T.AGGREGATE_TOL
    rules = [
        issue(off("mean_jsd", F.col("_j")), "AGG_MEAN_JSD", "aggregate.mean_jsd"),
        issue(off("mean_tau", F.col("_t")), "AGG_MEAN_TAU", "aggregate.mean_kendall_tau"),
        issue(off("composite_parity", two) & off("composite_parity", three), "AGG_COMPOSITE", "aggregate.composite_parity"),
        issue(off("p_dist", dist), "SCORES_SUB", "scores.p_dist"),
        issue(off("p_rank", rank), "SCORES_SUB", "scores.p_rank"),
    ]
    return emit(d, 2, rules)


# --- tier 3: raw samples, metadata, anomalies ---------------------------------------


def v_raw(runs: DataFrame, questions: DataFrame, raw: DataFrame, max_len: int = 10_000) -> DataFrame:
    """Coverage, emptiness, length and agreement of the preserved raw answers.

    ``runs`` carries ``has_raw``; ``raw``: run_id, key, raw_text, selected_option.
    """
    n_q = questions.groupBy("run_id").agg(F.count("*").alias("_nq"))
    blank = F.coalesce(F.length(F.trim("raw_text")), F.lit(0)) == 0
    no_key = F.coalesce(F.length("key"), F.lit(0)) == 0
    usable = ~no_key & ~blank
    per_run = raw.groupBy("run_id").agg(
        F.count("*").alias("_nr"), F.count_if(usable).alias("_nu"),
        F.count_if(usable & (F.length("raw_text") <= 1)).alias("_short"),
        F.count_if(usable & (F.length("raw_text") >= max_len)).alias("_long"),
    )
    d = runs.select("run_id", "has_raw").join(n_q, "run_id").join(per_run, "run_id", "left").fillna(0, ["_nr", "_nu", "_short", "_long"])
    need = F.greatest(F.lit(1), F.ceil(F.col("_nq") * 0.1))
    w = "warning"
    run_rules = emit(
        d, 3,
        [
            issue(~F.col("has_raw"), "RAW_RESPONSES_MISSING", "raw_responses", w),
            issue(F.col("has_raw") & (F.col("_nr") < need), "RAW_RESPONSES_COVERAGE", "raw_responses", w),
            issue((F.col("_nu") > 0) & (F.col("_short") >= F.col("_nu") * 0.95), "RAW_RESPONSES_LENGTH_SHORT", "raw_responses", w),
            issue((F.col("_nu") > 0) & (F.col("_long") >= F.col("_nu") * 0.95), "RAW_RESPONSES_LENGTH_LONG", "raw_responses", w),
        ],
    )
    side = questions.select("run_id", "key", "options", "p_model", "n_samples")
    j = raw.join(side, ["run_id", "key"], "left")
    top = F.array_max("p_model")
    pos = F.array_position("options", F.col("selected_option")).cast("int")
    own = F.when(pos > 0, F.element_at("p_model", F.when(pos > 0, pos)))
    slack = F.when(F.col("n_samples") > 0, F.lit(1.0) / F.sqrt("n_samples")).otherwise(F.lit(0.25))
    known = usable & (F.size("options") > 0) & F.col("selected_option").isNotNull()
    row_rules = emit(
        j, 3,
        [
            issue(no_key, "RAW_RESPONSES_SHAPE", "raw_responses.key", w),
            issue(~no_key & blank, "RAW_RESPONSES_EMPTY", F.concat("key", F.lit(".raw_text")), w),
            issue(usable & (F.length("raw_text") > max_len), "RAW_RESPONSES_LENGTH", F.concat("key", F.lit(".raw_text")), w),
            issue(known & (own.isNull() | (top - own > slack + 1e-6)), "RAW_RESPONSES_MODE", F.concat("key", F.lit(".selected_option")), w),
        ],
    )
    return run_rules.unionByName(row_rules)


def v_graduate(issues: DataFrame, runs: DataFrame) -> DataFrame:
    """Two raw-answer codes become errors from the current schema version on."""
    d = issues.join(runs.select("run_id", F.coalesce("schema_version", F.lit(1)).alias("_v")), "run_id")
    up = F.col("code").isin(GRADUATED) & (F.col("_v") >= CURRENT_SCHEMA)
    return d.withColumn("severity", F.when(up, "error").otherwise(F.col("severity"))).drop("_v")


def v_repro(runs: DataFrame) -> DataFrame:
    """Reproducibility block present, its fields there and non-empty.

    ``runs``: run_id and ``reproducibility`` as VARIANT (NULL when absent).
    """
    r = F.col("reproducibility")
    none = r.isNull() | F.is_variant_null(r)
    obj = F.coalesce(F.schema_of_variant(r), F.lit("")).startswith("OBJECT")
    w = "warning"
    rules = [issue(none, "REPRO_MISSING", "reproducibility", w), issue(~none & ~obj, "REPRO_TYPE", "reproducibility", w)]
    for k in REPRO_KEYS:
        f = F.try_variant_get(r, f"$.{k}", "variant")
        at = f"reproducibility.{k}"
        rules.append(issue(obj & f.isNull(), "REPRO_FIELD_MISSING", at, w))
        kind = F.coalesce(F.schema_of_variant(f), F.lit(""))
        if k == "seed":
            numeric = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|VOID|BOOLEAN)")
            rules.append(issue(obj & f.isNotNull() & ~numeric, "REPRO_FIELD_TYPE", at, w))
        else:
            text = F.when(kind == "STRING", F.try_variant_get(r, f"$.{k}", "string"))
            empty = F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0
            rules.append(issue(obj & f.isNotNull() & empty, "REPRO_FIELD_EMPTY", at, w))
    return emit(runs, 3, rules)


def anomalies(questions: DataFrame) -> DataFrame:
    """Perfection, near copies of the public half and constant offsets, in one aggregate."""
    public = ~X.is_private(F.col("dataset"), F.col("key"))
    std = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    pub = F.when(public, F.col("jsd"))
    d = questions.groupBy("run_id", "dataset").agg(
        F.count("jsd").alias("n"), F.avg("jsd").alias("m"), std("jsd").alias("s"),
        F.count(pub).alias("np"), F.avg(pub).alias("mp"), std(pub).alias("sp"),
        F.count("tau").alias("nt"), F.count_if(F.col("tau") >= 1.0 - 1e-4).alias("perfect"),
    )
    perfect = (F.col("n") >= 5) & ((F.col("m") < 0.005) | (F.col("s") < 0.005))
    held = X.holdout_percent(F.col("dataset")) > 0
    return emit(
        d, 3,
        [
            issue(perfect & (F.col("n") >= 25), "ANOMALY_PERFECTION", "per_question"),
            issue(perfect & (F.col("n") < 25), "ANOMALY_PERFECTION", "per_question", "warning"),
            issue(held & (F.col("np") >= 50) & (F.col("mp") < 0.02) & (F.col("sp") < 0.03), "ANOMALY_NEAR_COPY_PUBLIC", "per_question"),
            issue((F.col("nt") >= 25) & (F.col("perfect") >= F.col("nt") * 0.95), "ANOMALY_CONSTANT_OFFSET", "per_question"),
        ],
    )


def a_no_refusal(questions: DataFrame) -> DataFrame:
    """Humans refuse on at least three questions, the model never does. Opt-in, as in ``validate``."""
    d = questions.groupBy("run_id").agg(
        F.count_if(F.col("human_refusal_rate") >= 0.05).alias("n"), F.max(F.coalesce("model_refusal_rate", F.lit(0.0))).alias("m")
    )
    return emit(d, 3, [issue((F.col("n") >= 3) & (F.col("m") <= 0), "ANOMALY_NO_REFUSAL", "per_question", "warning")])


def peer_deltas(questions: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean difference per run to the per-key mean of its same-family peers.

    The peers' mean follows from the family's sum less the run's own value, so no
    run x run rows are built: one aggregate per (dataset, family, key) and one join.
    """
    fam = runs.where(~F.col("provider").contains("baseline") & ~F.col("provider").startswith("ensemble/")).select(
        "run_id", F.lower(F.substring_index("provider", "/", -1)).alias("_fam")
    )
    d = questions.where("jsd IS NOT NULL").select("run_id", "dataset", "key", "jsd").join(fam, "run_id")
    by = ["dataset", "_fam", "key"]
    sums = d.groupBy(*by).agg(F.sum("jsd").alias("_s"), F.count("*").alias("_n"))
    j = d.join(sums, by).where("_n > 1")
    peer = (F.col("_s") - F.col("jsd")) / (F.col("_n") - 1)
    return j.groupBy("run_id").agg(F.avg(F.col("jsd") - peer).alias("mean_delta"), F.count("*").alias("n_shared"))


def a_peer_outlier(questions: DataFrame, runs: DataFrame) -> DataFrame:
    d = peer_deltas(questions, runs)
    return emit(
        d, 3,
        [issue((F.col("n_shared") >= 5) & (F.abs("mean_delta") >= 0.15), "ANOMALY_PEER_OUTLIER", "per_question", "warning")],
    )


def run_validity(questions: DataFrame) -> DataFrame:
    """Runs that are mostly uniform noise: n >= 10, uniform share >= 0.8, mean refusal <= 0.05."""
    flat = D.uniformity(F.col("p_model")) < 0.01
    d = questions.groupBy("run_id").agg(
        F.count("*").alias("n_questions"), F.count_if(flat).alias("n_uniform"), F.coalesce(F.avg("model_refusal_rate"), F.lit(0.0)).alias("refusal_rate")
    )
    share = F.col("n_uniform") / F.col("n_questions")
    return d.withColumn("uniform_fraction", share).withColumn(
        "invalid", (F.col("n_questions") >= 10) & (share >= 0.8) & (F.col("refusal_rate") <= 0.05)
    )


def integrity(entries: DataFrame, index: DataFrame, rollups: DataFrame, declared: DataFrame) -> DataFrame:
    """Cross-checks of published artifacts: ids present, references resolve, counts agree.

    ``entries``/``index``/``rollups`` carry config_id, ``index`` also tier, ``declared`` one
    n_configs row.
    """
    out = lambda df, code: df.select(F.col("config_id").alias("run_id"), F.lit(code).alias("code"))
    known = index.where("config_id IS NOT NULL").select("config_id").distinct()
    local = index.where((F.col("tier") == "full") & F.col("config_id").isNotNull()).select("config_id").distinct()
    n = known.agg(F.count("*").alias("_n"))
    return union(
        [
            out(entries.where("config_id IS NULL"), "ENTRY_WITHOUT_CONFIG"),
            out(index.where("config_id IS NULL"), "INDEX_WITHOUT_CONFIG"),
            out(entries.where("config_id IS NOT NULL").select("config_id").distinct().join(known, "config_id", "left_anti"), "ENTRY_NOT_IN_INDEX"),
            out(local.join(rollups, "config_id", "left_anti"), "ROLLUP_MISSING"),
            declared.crossJoin(F.broadcast(n)).where("n_configs <> _n").select(F.lit(None).cast("string").alias("run_id"), F.lit("N_CONFIGS").alias("code")),
        ]
    )


def validate(
    runs: DataFrame, questions: DataFrame, raw: DataFrame | None = None, bronze: DataFrame | None = None, marker: str = "",
    hashes: DataFrame | None = None, tier3: bool = False,
) -> DataFrame:
    """All checks as one issue table. A schema error ends a run's checks; tier 2 needs a clean tier 1."""
    schema = v_schema(bronze, marker) if bronze is not None else None
    if schema is not None:
        broken = schema.select("run_id").distinct()
        runs, questions = (d.join(broken, "run_id", "left_anti") for d in (runs, questions))
    tier1 = [v_bounds(runs), v_dist(questions), v_count(runs, questions), v_holdout(questions)]
    if hashes is not None:
        tier1.append(v_qset(runs, hashes))
    # one row per finding, a small table that three later steps read: written once, so nothing stays in memory
    found = union(tier1)
    folder = shared_folder(found.sparkSession, "findings")
    found.write.parquet(folder)
    first = found.sparkSession.read.schema(found.schema).parquet(folder)
    failed = first.where("severity = 'error'").select("run_id").distinct()
    clean = lambda d: d.join(failed, "run_id", "left_anti")
    parts = [first, v_perq(clean(questions)), v_reagg(clean(runs), clean(questions))]
    if schema is not None:
        parts.append(schema)
    if tier3:
        parts += [anomalies(questions), a_peer_outlier(questions, runs)]
        if raw is not None:
            parts.append(v_graduate(v_raw(runs, questions, raw), runs))
        if "reproducibility" in runs.columns:
            parts.append(v_repro(runs))
    return union(parts)
