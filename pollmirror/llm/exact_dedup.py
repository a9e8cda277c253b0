"""Exact deduplication by skew-safe combining: local, then salted, then global, on full content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

SALTS = 16


def _groups(docs: DataFrame, text: str, id_col: str, salts: int, carry: list[str]) -> DataFrame:
    """One row per distinct text: digest, text, keep_id, group_size and, if asked, the winner's columns.

    The digest only routes rows; text is part of every grouping key, so equality is always that
    of the content. Each map task combines its own copies first, copies of one text are then
    merged per salt, and at most ``salts`` winners of a text meet in the last step.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        text_of(text).alias("__text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__row")] if carry else []),
    ).withColumns({
        "__digest": F.unhex(F.sha2("__text", 256)),
        "__salt": F.pmod(F.xxhash64("__id"), F.lit(salts)),
    })
    order = F.coalesce(F.col("__id"), F.lit(-(2**63)))

    def winner(size):
        row = [F.max_by("__row", order).alias("__row")] if carry else []
        return [F.max("__id").alias("__id"), size.alias("__n"), *row]

    salted = rows.groupBy("__digest", "__text", "__salt").agg(*winner(F.count(F.lit(1))))
    return salted.repartition("__digest").groupBy("__digest", "__text").agg(*winner(F.sum("__n")))


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """Every document with the one of its equals that stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when all their bytes
    are; a null text counts as empty. The largest doc_id of equal texts stays; a null id is the
    smallest. If a row is repeated with the same id and text, one of the repetitions stays. An
    empty table gives no rows; other columns are not read.

    The labels go back to the rows by digest. Two texts with one SHA-256 would stop the job
    with an error rather than be mixed up.
    """
    one = _groups(docs, text, id_col, salts, []).groupBy("__digest").agg(
        F.count(F.lit(1)).alias("__variants"), F.max("__id").alias("keep_id"), F.max("__n").alias("group_size")
    )
    one = one.select(
        "__digest",
        "keep_id",
        F.when(F.col("__variants") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("different texts share a SHA-256 digest")).cast("bigint"))
        .alias("group_size"),
    )
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text_of(text), 256)).alias("__digest"))
    nth = F.row_number().over(Window.partitionBy("__digest", "doc_id").orderBy("doc_id"))
    # dealt by digest and id after the join: so a hot digest is split in the join (skew handling may cut its
    # side, as nothing relies on where its rows lie) and its rows are spread by id for the numbering
    labelled = rows.join(one, "__digest").repartition("__digest", "doc_id")
    return labelled.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (nth == 1)).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, text: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    The winner's columns travel with the combining, so no text is joined again. A null text
    comes back as the empty one.
    """
    won = _groups(docs, text, id_col, salts, [c for c in docs.columns if c != text] or [id_col])
    return won.select(*[F.col("__text" if c == text else f"__row.`{c}`").alias(c) for c in docs.columns])


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AND row_number() OVER (PARTITION BY t, doc_id ORDER BY doc_id) = 1 AS kept,
  sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
