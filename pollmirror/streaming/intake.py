"""Upload gate: shape, bounds, counts and distribution sums of submitted documents."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUM_TOLERANCE = 5e-3


def gate(docs: DataFrame, marker: str) -> DataFrame:
    """Add status, reason and the submission's metadata; the first failing rule names the reason.

    ``docs``: run_id, raw. Row-local, so the same function serves a batch and a stream.
    """
    d = docs.withColumn("v", F.try_parse_json("raw"))
    v = F.col("v")
    get = lambda p, t: F.try_variant_get(v, p, t)
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("NONE"))
    is_object = lambda p: kind(get(p, "variant")).startswith("OBJECT")
    n = get("$.aggregate.n_questions", "double")
    n_kind = kind(get("$.aggregate.n_questions", "variant"))
    n_ok = n_kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & (n >= 0)
    rows = F.try_variant_get(v, "$.per_question", "array<variant>")

    def outside(path: str, lo: float, hi: float) -> Column:
        x = get(path, "variant")
        value = F.when(kind(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), get(path, "double"))
        return x.isNotNull() & ~F.is_variant_null(x) & ~F.coalesce(value.between(lo, hi), F.lit(False))

    def bad_side(q: Column, side: str) -> Column:
        x = F.try_variant_get(q, f"$.{side}", "variant")
        k = kind(x)
        numbers = F.coalesce(
            F.when(k.startswith("OBJECT"), F.map_values(F.try_variant_get(x, "$", "map<string,variant>"))),
            F.when(k.startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>")),
        )
        real = F.forall(numbers, lambda y: F.coalesce(F.schema_of_variant(y), F.lit("")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"))
        p = F.transform(numbers, lambda y: F.try_variant_get(y, "$", "double"))
        s = F.aggregate(p, F.lit(0.0), lambda a, y: a + y)
        wrong = ~real | F.exists(p, lambda y: y < 0) | ((F.size(p) > 0) & (F.abs(s - 1.0) > SUM_TOLERANCE))
        return x.isNotNull() & F.coalesce(numbers.isNull() | wrong, F.lit(True))

    def any_row(test) -> Column:
        return F.coalesce(F.exists(rows, test), F.lit(False))

    rules: list[tuple[Column, str]] = [
        (~kind(v).startswith("OBJECT"), "body is not a JSON object"),
        (~get("$.benchmark", "string").eqNullSafe(F.lit(marker)), "wrong benchmark marker"),
        (~is_object("$.config"), "missing or invalid config"),
        (~is_object("$.aggregate"), "missing or invalid aggregate"),
        (~kind(get("$.per_question", "variant")).startswith("ARRAY"), "missing or invalid per_question"),
        (~F.coalesce(n_ok, F.lit(False)), "n_questions must be a non-negative number"),
        (n != F.size(rows), "n_questions does not match per_question"),
        (outside("$.aggregate.composite_parity", 0, 1), "composite_parity outside [0, 1]"),
        (outside("$.aggregate.mean_jsd", 0, 1), "mean_jsd outside [0, 1]"),
        (outside("$.aggregate.mean_tau", -1, 1), "mean_tau outside [-1, 1]"),
        (any_row(lambda q: ~F.coalesce(F.schema_of_variant(q), F.lit("")).startswith("OBJECT")), "per_question entry is not an object"),
        (any_row(lambda q: bad_side(q, "human_distribution") | bad_side(q, "model_distribution")), "invalid distribution"),
    ]
    reason = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))
    name = F.coalesce(F.nullif(get("$.config.model", "string"), F.lit("")), F.nullif(get("$.config.provider", "string"), F.lit("")))
    return (
        d.withColumn("reason", reason)
        .withColumn("status", F.when(F.col("reason").isNull(), "validating").otherwise("rejected"))
        .withColumn("model_name", name)
        .withColumn("dataset", get("$.config.dataset", "string"))
        .withColumn("n_questions", F.when(F.col("reason").isNull(), n.cast("bigint")))
        .drop("v", "raw")
    )


#: Hash buckets of the table of taken ids; a batch reads those that its own ids fall into.
BUCKETS = 64
TAKEN = "run_id string, bucket int, batch bigint"


def bucket_of(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def not_taken(batch: DataFrame, batch_id: int, taken: str) -> DataFrame:
    """Rows of a batch whose run id no earlier batch took, one per id.

    The table of taken ids is partitioned by bucket and batch: only the buckets of this batch's
    ids are read, and a batch that is run again does not see the ids it wrote itself.
    """
    spark = batch.sparkSession
    own = batch.dropDuplicates(["run_id"]).withColumn("bucket", bucket_of(F.col("run_id")))
    buckets = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most BUCKETS
    try:
        known = spark.read.schema(TAKEN).parquet(taken)
    except AnalysisException as exc:  # no batch has written yet
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return own
    known = known.where(F.col("bucket").isin(buckets) & (F.col("batch") < batch_id)).select("bucket", "run_id")
    return own.join(known, ["bucket", "run_id"], "left_anti")


def run_intake(docs: DataFrame, marker: str, out: str, checkpoint: str, arrival: Column | None = None, horizon: str = "1 day") -> list:
    """Gate a stream of documents into accepted and rejected tables; returns the progress of its batches.

    A run id is taken once, for ever, with state that does not grow: ids seen within ``horizon`` of
    their arrival are stream state and dropped there; older ones are found in the table of
    taken ids, which every batch anti-joins before it writes. Arrival is the time of the batch, or
    a column of times that never go back by more than the horizon. Every micro-batch overwrites its own
    partitions, so a batch replayed after a failure leaves the same tables; ``out`` and
    ``checkpoint`` belong together. Documents without an id are judged each, none is taken for another.
    """
    arrived = docs.select("run_id", "raw", (F.current_timestamp() if arrival is None else arrival).cast("timestamp").alias("arrival"))
    recent = arrived.where("run_id IS NOT NULL").withWatermark("arrival", horizon).dropDuplicatesWithinWatermark(["run_id"])
    unnamed = docs.where("run_id IS NULL").select("run_id", "raw")
    taken = f"{out}/taken"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        fresh = not_taken(batch.where("run_id IS NOT NULL"), batch_id, taken)
        rows = fresh.unionByName(batch.where("run_id IS NULL").withColumn("bucket", F.lit(None).cast("int"))).persist()
        try:
            gated = gate(rows.drop("bucket"), marker)
            for status, name in (("validating", "accepted"), ("rejected", "rejected")):
                gated.where(F.col("status") == status).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
            # ids last: a batch that failed half way has taken none
            ids = rows.where("run_id IS NOT NULL").select("run_id", "bucket", F.lit(batch_id).cast("bigint").alias("batch"))
            ids.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(taken)
        finally:
            rows.unpersist()
            batch.unpersist()

    stream = recent.drop("arrival").unionByName(unnamed)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)
