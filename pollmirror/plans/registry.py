"""Registry of named queries: a Spark callable and, where SQL can say it, its check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bridge import Survey
from .oracle import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles at the sink and widen integers, so both engines agree on types.

    The first, finer rounding settles exact ties that carry floating point noise.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(F.round(c.cast("double"), places + 6), places) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, body: str | None = None, doubles: str = "", ints: str = "", ctes: str = "", **extra: str):
    """Register a query; ``doubles`` are rounded and ``ints`` widened on the SQL side too."""

    def wrap(fn: Callable[[Survey], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(Survey.open(spark, sf_dir)))
        if body is not None:
            text = body.strip()
            swaps = [f"round(round({c}, 12), 6) + 0e0 AS {c}" for c in doubles.split()]
            swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            if swaps:
                text = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({text})"
            ORACLES[name] = sql(text, *ctes.split(), **extra)
        return fn

    return wrap


def load_all() -> None:
    from . import (  # noqa: F401
        q_inference,
        q_metrics,
        q_quality,
        q_rollups,
        q_sources,
        q_streams,
    )
