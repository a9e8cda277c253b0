"""Provider strings: model name, vendor, knobs, display name and configuration id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .text import template_name


def canonical_model(model: Column) -> Column:
    """Model name without a trailing version date (long form first, never both)."""
    long_form = F.regexp_replace(model, r"-\d{4}-\d{2}-\d{2}$", "")
    return F.when(long_form != model, long_form).otherwise(F.regexp_replace(model, r"-\d{8}$", ""))


def without_knobs(provider: Column) -> Column:
    """Provider path without ``t=``, ``tpl=`` and ``profile=`` suffixes."""
    out = provider
    for mark in (" t=", " tpl=", " profile="):
        out = F.substring_index(out, mark, 1)
    return F.trim(out)


def without_version_date(provider: Column) -> Column:
    """Same path with the date stripped from its last segment."""
    tail = F.substring_index(provider, "/", -1)
    return F.concat(
        F.substring(provider, F.lit(1), F.length(provider) - F.length(tail)), canonical_model(tail)
    )


def _vendor(name: Column) -> Column:
    out = name
    for alias, vendor in T.VENDOR_ALIASES.items():
        out = F.when(name == alias, vendor).otherwise(out)
    return out


def _vendor_of_model(model: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, vendor in reversed(T.MODEL_VENDORS):
        out = F.when(F.lower(model).startswith(prefix), vendor).otherwise(out)
    return out


def parse_provider(df: DataFrame, provider: str = "provider") -> DataFrame:
    """Add ``framework``, ``base_provider``, ``model`` and the ``knobs`` map."""
    tokens = F.split(F.trim(F.col(provider)), r"\s+")
    df = df.withColumn("_tokens", tokens).withColumn("_path", F.col("_tokens")[0])
    df = df.withColumn("_parts", F.split("_path", "/")).withColumn("_n", F.size("_parts"))
    first, last = F.col("_parts")[0], F.element_at("_parts", -1)
    before = F.try_element_at("_parts", F.lit(-2))
    single = F.col("_n") == 1
    framework = (
        F.when(F.col("_path") == "", "unknown")
        .when(single & F.col("_path").endswith("-baseline"), "baseline")
        .when(single | first.startswith("raw-") | (first == "openrouter"), "raw")
        .otherwise(first)
    )
    base = (
        F.when(single, None)
        .when(first.startswith("raw-"), _vendor(F.substring(first, 5, 1000)))
        .when(F.col("_n") == 2, _vendor_of_model(last))
        .otherwise(_vendor(before))
    )
    model = F.when(F.col("_path") == "", "unknown").otherwise(last)
    pairs = F.filter(
        F.slice("_tokens", F.lit(2), F.greatest(F.size("_tokens") - 1, F.lit(0))),
        lambda t: t.rlike(r"^[^=]+="),
    )
    names = F.array_distinct(F.transform(pairs, lambda t: F.substring_index(t, "=", 1)))
    knobs = F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda k: F.regexp_replace(
                F.element_at(F.filter(pairs, lambda t: F.substring_index(t, "=", 1) == k), -1),
                r"^[^=]+=", "",
            ),
        ),
    )
    return (
        df.withColumn("framework", framework)
        .withColumn("base_provider", base)
        .withColumn("model", model)
        .withColumn("knobs", knobs)
        .drop("_tokens", "_path", "_parts", "_n")
    )


def _json_text(x: Column) -> Column:
    """A JSON string literal, or null."""
    quoted = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def _slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9.\-]+", "-"), r"^-+|-+$", "")


def config_id(
    df: DataFrame,
    dataset: str = "dataset",
    temperature: str = "temperature",
    template: str = "template",
    samples: str = "samples_per_question",
    question_hash: str = "question_set_hash",
) -> DataFrame:
    """Add ``config_id``: a readable slug plus 8 hex digits over the canonical JSON.

    Needs the columns of :func:`parse_provider`. Explicit temperature and template win
    over the knobs parsed from the provider string; JSON keys are in sorted order.
    """
    knobs = F.col("knobs")
    t_knob = F.try_element_at(knobs, F.lit("t"))
    t_num = F.coalesce(F.col(temperature).cast("double"), t_knob.try_cast("double"))
    t_text = F.coalesce(t_num.cast("string"), t_knob)
    tpl = F.coalesce(template_name(F.col(template)), F.try_element_at(knobs, F.lit("tpl")))
    t_json = F.when(t_num.isNotNull(), t_num.cast("string")).otherwise(_json_text(t_knob))

    df = (
        df.withColumn("model", canonical_model(F.col("model")))
        .withColumn("_t", t_text)
        .withColumn("_tj", t_json)
        .withColumn("_tpl", tpl)
    )
    others = F.map_filter(knobs, lambda k, _: ~k.isin("t", "tpl"))
    entries = F.concat(
        F.transform(
            F.map_entries(others),
            lambda e: F.concat(_json_text(e["key"]), F.lit(":"), _json_text(e["value"])),
        ),
        F.when(F.col("_t").isNotNull(), F.array(F.concat(F.lit('"t":'), F.col("_tj")))).otherwise(
            F.array().cast("array<string>")
        ),
        F.when(F.col("_tpl").isNotNull(), F.array(F.concat(F.lit('"tpl":'), _json_text(F.col("_tpl"))))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    body = F.concat_ws(
        ",",
        F.concat(F.lit('"base_provider":'), _json_text(F.col("base_provider"))),
        F.when(F.col(dataset).isNotNull(), F.concat(F.lit('"dataset":'), _json_text(F.col(dataset)))),
        F.concat(F.lit('"framework":'), _json_text(F.col("framework"))),
        F.concat(F.lit('"knobs":{'), F.array_join(F.array_sort(entries), ","), F.lit("}")),
        F.concat(F.lit('"model":'), _json_text(F.col("model"))),
        F.when(
            F.col(question_hash).isNotNull(),
            F.concat(F.lit('"question_set_hash":'), _json_text(F.col(question_hash))),
        ),
        F.when(
            F.col(samples).isNotNull(),
            F.concat(F.lit('"samples_per_question":'), F.col(samples).cast("string")),
        ),
    )
    digest = F.substring(F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256), 1, 8)
    slug = F.concat_ws(
        "--",
        _slug(F.col("framework")),
        _slug(F.col("model")),
        F.concat(F.lit("t"), F.coalesce(F.col("_t"), F.lit("default"))),
        F.concat(F.lit("tpl"), F.coalesce(_slug(F.col("_tpl")), F.lit("current"))),
        digest,
    )
    return df.withColumn("config_id", slug).drop("_t", "_tj", "_tpl")


def with_display(df: DataFrame, names: DataFrame, provider: str = "provider") -> DataFrame:
    """Add ``display_name`` and ``family`` (raw / product / baseline).

    ``names(path, display_name, family)`` is looked up by the raw string, then without
    knobs, then without the version date; unknown paths keep their own string. Catalyst
    broadcasts the name table when its measured size allows it and shuffles it otherwise.
    """
    raw = F.col(provider)
    tries = [raw, without_knobs(raw), without_version_date(without_knobs(raw))]
    out = df
    for i, key in enumerate(tries):
        side = names.select(
            F.col("path").alias(f"_p{i}"), F.col("display_name").alias(f"_d{i}"), F.col("family").alias(f"_f{i}")
        )
        out = out.join(side, key == F.col(f"_p{i}"), "left")
    cols = range(len(tries))
    return (
        out.withColumn("display_name", F.coalesce(*[F.col(f"_d{i}") for i in cols], raw))
        .withColumn(
            "family",
            F.coalesce(
                *[F.col(f"_f{i}") for i in cols], F.when(raw.isin(T.BASELINES), "baseline"), F.lit("raw")
            ),
        )
        .drop(*[f"_{c}{i}" for c in "pdf" for i in cols])
    )


def default_names(spark, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """The fixed name table plus the caller's own products."""
    return spark.createDataFrame(
        T.MODEL_NAMES + list(extra or []), "path string, display_name string, family string"
    )
