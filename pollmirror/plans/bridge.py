"""Survey views over the provided tables.

Every line item is one answer: the part is the question, the part type names the
dataset, the line number names the model run, flag and status form the option, a
discount of 10% stands for a refusal and a tax of 8% for an unparseable answer. All
rows of the tables are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provider as P
from ..functions import text as X
from ..operators import scoring as S

DATASETS = {
    "ECONOMY": "opinionsqa", "STANDARD": "gss", "PROMO": "subpop",
    "MEDIUM": "globalopinionqa", "LARGE": "ntia", "SMALL": "pilot (2024)",
}
# model, provider, temperature, template, samples per question
MODELS = [
    ("m1", "openrouter/anthropic/claude-haiku-4-5", None, None, 30),
    ("m2", "openrouter/anthropic/claude-haiku-4-5-20251001", None, None, 30),
    ("m3", "openrouter/openai/gpt-4o-mini t=0.85 tpl=current", 0.85, "prompts/current.md", 15),
    ("m4", "ensemble/3-model-blend", None, None, 30),
    ("m5", "random-baseline", None, None, 30),
    ("m6", "majority-baseline", None, None, 30),
    ("m7", "panel/openrouter/google/gemini-2.5-flash-lite t=0.7 tpl=v2", None, None, 5),
]
PRODUCTS = [
    ("panel/openrouter/google/gemini-2.5-flash-lite", "Panel (Flash Lite)", "product"),
    ("ensemble/3-model-blend", "Blend of 3", "product"),
]
PRODUCT_MODELS = [("Panel (Flash Lite)", "GPT-4o-mini"), ("Blend of 3", "Claude Haiku 4.5")]
PRICES = [
    ("openrouter/anthropic/claude-haiku-4-5", 1.0, 5.0),
    ("openrouter/anthropic/claude-haiku-4-5-20251001", 1.0, 5.0),
    ("openrouter/openai/gpt-4o-mini", 0.15, 0.6),
    ("panel/openrouter/google/gemini-2.5-flash-lite", 0.1, 0.4),
]
WAVES = {1995: 26, 1996: 32, 1997: 36, 1998: 49, 1999: 82}


class Survey:
    """Lazy survey tables for one data directory."""

    _open: dict[tuple[str, str, str], "Survey"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str) -> "Survey":
        """One set of views per application and folder, so persisted silver tables are shared."""
        key = (spark.sparkContext.applicationId, str(id(spark)), sf_dir)
        return cls._open.setdefault(key, cls(spark, sf_dir))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def small(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def part(self) -> DataFrame:
        names = F.create_map(*[F.lit(x) for kv in DATASETS.items() for x in kv])
        return self.table("part").select(
            F.concat(F.lit("P"), "p_partkey").alias("key"),
            "p_partkey",
            F.try_element_at(names, F.col("p_type")).alias("dataset"),
            F.concat(F.lit("ATP W"), "p_size").alias("survey"),
            "p_name",
            "p_brand",
            "p_size",
        )

    @cached_property
    def _answers(self) -> DataFrame:
        """One row per line item, with the human option and the model sample it stands for."""
        li = self.table("lineitem")
        code = F.concat("l_returnflag", "l_linestatus")
        taxed = F.col("l_tax") > 0
        return li.select(
            F.concat(F.lit("P"), "l_partkey").alias("key"),
            F.col("l_partkey").alias("p_partkey"),
            F.col("l_orderkey").alias("sample_no"),
            F.concat(F.lit("m"), "l_linenumber").alias("model"),
            F.when(F.col("l_discount") >= 0.1, "Refused").otherwise(code).alias("option"),
            F.when(F.col("l_tax") >= 0.08, "Other").otherwise(code).alias("selected_option"),
            (F.col("l_discount") >= 0.1).alias("refusal"),
            F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("Answer: "), code)).alias("raw_text"),
            F.when(taxed, F.col("l_quantity").cast("bigint")).alias("in_tok"),
            F.when(taxed, F.round(F.col("l_tax") * 100).cast("bigint")).alias("out_tok"),
            F.col("l_shipdate").alias("ts"),
        )

    def _asked(self, answers: DataFrame) -> DataFrame:
        """Answers with the dataset of their question.

        The join is on the text key that every later step groups and joins by, so rows that are
        spread by it once need not be spread again; it keeps a hash table of the parts of a
        partition, so the answers are not sorted for it.
        """
        parts = self.part.select("key", "dataset").hint("shuffle_hash")
        return answers.join(parts, "key").withColumn("run_id", F.concat_ws("_", "dataset", "model"))

    @cached_property
    def base(self) -> DataFrame:
        """One row per answer to a known question."""
        return self._asked(self._answers)

    @cached_property
    def questions(self) -> DataFrame:
        return S.question_distributions(self.base, ["dataset", "key"])

    @cached_property
    def distributions(self) -> DataFrame:
        return S.sample_distribution(self.base, self.questions)

    @cached_property
    def scored(self) -> DataFrame:
        """Every (run, question) cell with its scores and the model label.

        This is the silver table: the raw answers are aggregated once, and the cells, far
        fewer than the answers, spill to executor disk and are rebuilt if one is lost.
        """
        return self._cells.persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def _cells(self) -> DataFrame:
        return S.question_score(self.distributions).withColumn("model", F.substring_index("run_id", "_", -1))

    @cached_property
    def metrics(self) -> DataFrame:
        """The numbers of every (run, question) cell, without its texts and arrays: all that run scores need."""
        return self._cells.select(
            "run_id", "dataset", "key", "model", "jsd", "tau", "parity", "model_refusal_rate", "human_refusal_rate", "in_tok", "out_tok", "calls"
        ).persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def shares(self) -> DataFrame:
        """The model side of every (run, question) cell beside its numbers, without texts and counts."""
        return self._cells.select(
            "run_id", "dataset", "key", "model", "options", "p_human", "p_model", "jsd", "tau", "parity",
            "model_refusal_rate", "human_refusal_rate", "n_samples", "in_tok", "out_tok", "calls",
        ).persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def sides(self) -> DataFrame:
        """The model side of every (run, question) cell without any score, for queries that compare it with something else."""
        return self._cells.select("run_id", "dataset", "key", "model", "options", "p_model", "n_samples", "raw_text", "raw_option")

    @cached_property
    def samples(self) -> DataFrame:
        """``sides`` kept, for checks that read the raw answers more than once."""
        return self.sides.persist(StorageLevel.MEMORY_AND_DISK)

    @cached_property
    def models(self) -> DataFrame:
        return self.small(
            MODELS, "model string, provider string, temperature double, template string, samples_per_question int"
        )

    @cached_property
    def names(self) -> DataFrame:
        return P.default_names(self.spark, PRODUCTS)

    @cached_property
    def run_times(self) -> DataFrame:
        return self.base.groupBy("run_id").agg(F.max("ts").alias("ts"))

    @cached_property
    def runs(self) -> DataFrame:
        """One row per run: configuration, display name and scores."""
        return self.runs_of(self.metrics).persist(StorageLevel.MEMORY_AND_DISK)

    def runs_of(self, cells: DataFrame) -> DataFrame:
        """The runs of scored cells that a query keeps anyway, so that none is made twice."""
        scores = S.run_score(cells).withColumn("model", F.substring_index("run_id", "_", -1))
        usage = S.usage_rollup(cells)
        out = scores.join(usage, "run_id", "left").join(self.run_times, "run_id").join(self.models, "model")
        out = out.withColumnRenamed("model", "run_model")
        return P.with_display(out, self.names)

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(
            F.concat(F.lit("P"), "doc_id").alias("key"), "text"
        )

    @cached_property
    def topics(self) -> DataFrame:
        """Topic of every question, from its document or, where it has none, its own text."""
        d = self.part.select("key", "p_name").join(self.texts, "key", "left")
        return d.select("key", X.topic(F.coalesce("text", "p_name")).alias("topic"))

    @cached_property
    def grouped(self) -> DataFrame:
        """Answers with the market segment of the ordering customer."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("sample_no"), "o_custkey")
        customers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("group"), "c_nationkey"
        )
        people = orders.join(customers.hint("shuffle_hash"), "o_custkey")
        # the questions come last, so that the rows stay spread by key
        return self._asked(self._answers.join(people.hint("shuffle_hash"), "sample_no"))

    @cached_property
    def waves(self) -> DataFrame:
        """Question distributions per shipping year, keyed like a panel wave."""
        years = F.create_map(*[F.lit(x) for kv in WAVES.items() for x in kv])
        wave = F.coalesce(F.try_element_at(years, F.year("ts")), F.lit(99))
        d = self.base.withColumn("wave", wave)
        return S.question_distributions(d, ["dataset", "key", "wave"]).select(
            "dataset",
            F.concat("key", F.lit("_W"), "wave").alias("key"),
            F.concat(F.lit("ATP W"), "wave").alias("survey"),
            "options",
            "counts",
            "n",
            "p_human",
        )

    @cached_property
    def public(self) -> DataFrame:
        return self.scored.withColumn("is_private", X.is_private(F.col("dataset"), F.col("key")))
