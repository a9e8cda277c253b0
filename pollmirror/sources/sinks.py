"""Published artifacts: catalog, run documents, routing by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as X
from ..operators.rollups import route

INDEX_COLUMNS = [
    "run_id", "config_id", "framework", "base_provider", "model", "display_name", "dataset", "temperature", "template",
    "samples_per_question", "n_questions", "n_topics", "sps", "p_dist", "p_rank", "p_refuse", "mean_jsd", "mean_tau", "ts",
    "is_baseline", "is_ensemble",
]
ROUNDED = ["sps", "p_dist", "p_rank", "p_refuse", "mean_jsd", "mean_tau"]


def index_rows(runs: DataFrame) -> DataFrame:
    """The public catalog row of every run."""
    return runs.select(
        *[(D.clean_round(F.col(c)).alias(c) if c in ROUNDED else F.col(c)) for c in INDEX_COLUMNS if c in runs.columns]
    )


def run_documents(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """One nested document per run; its questions are gathered once per run by definition."""
    rows = questions.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("key", "options", "p_human", "p_model", "jsd", "tau", "parity"))).alias("per_question")
    )
    return runs.join(rows, "run_id").select("run_id", "dataset", run_scores().alias("scores"), "per_question")


def run_scores() -> Column:
    """The scores of a run as its document has them."""
    return F.struct(*[D.clean_round(F.col(c)).alias(c) for c in ("sps", "p_dist", "p_rank", "p_refuse")])


def write_run_documents(runs: DataFrame, questions: DataFrame, path: str, name: str = "per_question", tail: Column | None = None) -> None:
    """The JSON document of every run, a file in its own folder, written line by line in order of the keys.

    ``runs``: run_id and the members of the document; ``questions``: run_id and the members of an element of its array
    ``name``, key among them. A run without questions has no document. No task holds a document: its lines are sorted, which may
    spill, and streamed to the file. ``tail`` closes the document, from the columns of ``runs``.
    """
    own = [c for c in runs.columns if c != "run_id"]
    head = runs.join(questions.select("run_id").distinct(), "run_id", "left_semi").withColumn("_head", F.to_json(F.struct(*own)))
    start = F.concat(F.expr("left(_head, length(_head) - 1)"), F.when(F.length("_head") > 2, ",").otherwise(""), F.lit(f'"{name}":['))
    element = F.to_json(F.struct(*[c for c in questions.columns if c != "run_id"]))
    line = lambda d, place, key, value: d.select("run_id", F.lit(place).alias("_place"), key.alias("_key"), value.alias("value"))
    lines = line(head, 0, F.lit(""), start).unionByName(line(questions.join(runs.select("run_id"), "run_id", "left_semi"), 1, F.col("key"), element))
    lines = lines.unionByName(line(head, 2, F.lit(""), F.lit("]}") if tail is None else tail))
    # the number of a line tells the first element, which no comma precedes
    w = Window.partitionBy("run_id").orderBy("_place", "_key", "value")
    lines = lines.withColumn("_no", F.row_number().over(w))
    text = F.when((F.col("_place") == 1) & (F.col("_no") > 2), F.concat(F.lit(","), "value")).otherwise(F.col("value"))
    lines.select("run_id", text.alias("value")).write.partitionBy("run_id").text(path)


def write_routed(df: DataFrame, public: str, restricted: str, fmt: str = "json") -> None:
    """Write by tier: full to the public folder, gated to the restricted one, others nowhere."""
    routed = df.withColumn("_route", route(F.col("tier")))
    for name, path in (("public", public), ("restricted", restricted)):
        routed.where(F.col("_route") == name).drop("_route").write.mode("overwrite").partitionBy("dataset").format(fmt).save(path)


def routes_manifest(questions: DataFrame) -> DataFrame:
    """Sorted distinct safe keys per gated dataset, private ones left out."""
    d = questions.where((F.col("tier") == "gated") & ~X.is_private(F.col("dataset"), F.col("key")))
    return d.groupBy("dataset").agg(F.array_sort(F.collect_set(X.safe_key(F.col("key")))).alias("keys"))
