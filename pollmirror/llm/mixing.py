"""Mixing sources to target weights: repetition rates per source, then whole copies of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: A draw is the first three hex digits of md5(seed:id), so one of 4096 values.
BINS = 4096
SEED = "mix"


def _sized(docs: DataFrame, text: str, id_col: str, source: str, seed: str) -> DataFrame:
    """The caller's columns as one value, so that none can clash, and what the mix needs of them."""
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(f"`{id_col}`").alias("__id"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint").alias("__size"),
        F.conv(F.substring(draw, 1, 3), 16, 10).cast("int").alias("__draw"),
        F.col(f"`{source}`").isNull().alias("__null"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("__source"),
    )


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """Target, whole copies and draw threshold of every source, from one aggregate per source and draw.

    All sizes together are shared by weight; no source gets more than ``max_rate`` times its
    size, and what is over goes to the others by weight. That is the level L at which
    min(cap, weight * L) adds up to the total: a source is capped exactly if its cap per weight
    is at most the level that is left when all sources of smaller cap per weight are capped.

    ``floor(rate)`` copies are certain; one more comes if the document's draw is under the
    source's threshold, which is the fraction of the rate read on the realised draws: the
    draw up to which the words of the source come nearest to the fraction of its words.
    """
    keys = ["__null", "__source"]
    hist = written(sized.groupBy(*keys, "__draw").agg(F.sum("__size").alias("words")), "mix-draws")
    order = Window.orderBy("__null", "__source")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    sources = (
        hist.groupBy(*keys).agg(F.sum("words").alias("source_size"))
        .withColumn("rank", F.row_number().over(order))
        .withColumn("w", share.cast("bigint"))
        .withColumn("cap", F.col("source_size") * max_rate)
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(by_ratio), F.lit(0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("capped", F.col("ratio") <= F.col("left") / F.col("w_left"))
        .withColumn("w_free", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
        .withColumn("free", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("free") / F.col("w_free"))),
        )
        .withColumn(
            "rate",
            F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(0.0),
        )
        .withColumn("certain", F.floor("rate").cast("bigint"))
        .withColumn("need", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
        .select(*keys, "source_size", "target", "rate", "certain", "need")
    )
    run = Window.partitionBy(*keys).orderBy("__draw")
    steps = hist.withColumn("upto", F.sum("words").over(run)).select(*keys, (F.col("__draw") + 1).alias("cut"), "upto")
    steps = steps.unionByName(sources.select(*keys, F.lit(0).alias("cut"), F.lit(0).cast("bigint").alias("upto")))
    best = steps.join(sources, keys).groupBy(*keys).agg(
        F.min(F.struct(F.abs(F.col("upto") - F.col("need")).alias("off"), "cut")).getField("cut").alias("cut")
    )
    return sources.join(best, keys).select(*keys, "source_size", "target", "rate", "certain", "cut")


def with_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` as __row, with __id, __size, __source_size, __target and __copies (how often the mix takes it).

    A size is the number of words; a null or empty text has none, and its copies add no words. A
    null source is a source of its own and comes last. Every row counts by itself, repeated ones
    too; rows of one id share their draw. Draws depend on the id alone, so a rerun takes the same
    copies. An empty table gives no rows; columns of ``docs`` may have any name.
    """
    sized = _sized(docs, text, id_col, source, seed)
    rates = written(source_rates(sized), "mix-rates")
    rates = rates.select("__null", "__source", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "certain", "cut")
    out = join_small(sized, rates, ["__null", "__source"])
    copies = F.col("certain") + (F.col("__draw") < F.col("cut")).cast("bigint")
    return out.withColumn("__copies", copies)


def mix_report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document."""
    return with_copies(docs, text, id_col, source, seed).select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"),
    )


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    taken = with_copies(docs, text, id_col, source, seed).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")


def mix_sql(docs: str = "documents", seed: str = SEED) -> str:
    """The same mix in SQL; ``docs`` is any relation with doc_id, text and source."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INT) AS draw
  FROM {docs}),
by_draw AS (SELECT source, draw, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
src AS (SELECT source, sum(words)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM by_draw GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS w, source_size * {MAX_RATE} AS cap, sum(source_size) OVER ()::BIGINT AS total FROM src),
ratios AS (SELECT *, cap::DOUBLE / w AS ratio FROM weighed),
before AS (SELECT *,
    sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER p, 0)::BIGINT AS w_left, total - coalesce(sum(cap) OVER p, 0)::BIGINT AS rest
  FROM ratios WINDOW p AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (SELECT *, ratio <= rest::DOUBLE / w_left AS capped FROM before),
level AS (SELECT *, (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::BIGINT)::DOUBLE / sum(w) FILTER (NOT capped) OVER ()::BIGINT AS lvl FROM flagged),
aimed AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w * lvl END AS target FROM level),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MAX_RATE}.0::DOUBLE) ELSE 0.0 END AS rate FROM aimed),
needed AS (SELECT *, floor(rate)::BIGINT AS certain, greatest(target - floor(rate)::BIGINT * source_size, 0.0) AS need FROM rated),
steps AS (
  SELECT source, draw + 1 AS cut, sum(words) OVER (PARTITION BY source ORDER BY draw)::BIGINT AS upto FROM by_draw
  UNION ALL SELECT source, 0, 0 FROM needed),
best AS (
  SELECT n.source, arg_min(cut, (abs(upto - need), cut)) AS cut FROM steps s JOIN needed n ON s.source IS NOT DISTINCT FROM n.source GROUP BY n.source)
SELECT d.*, n.source_size, n.target, n.certain + (d.draw < b.cut)::BIGINT AS copies, d.size * (n.certain + (d.draw < b.cut)::BIGINT) AS taken
FROM sized d JOIN needed n ON d.source IS NOT DISTINCT FROM n.source JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""
