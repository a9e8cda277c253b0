"""Text, key and hash expressions, JVM-side but for the topics' automaton."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


@lru_cache(maxsize=8)
def _automaton(words: tuple[tuple[str, int], ...]):
    """One automaton over all keywords, each with the place of its topic."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, rank in words:
        a.add_word(word, rank)
    a.make_automaton()
    return a


def topic(text: Column, taxonomy: dict[str, list[str]] | None = None) -> Column:
    """First topic with a keyword inside the lower-cased text, else the fallback; null for a null or empty text.

    Every text is read once by an automaton of all keywords, up to the first keyword of the first
    topic or its end; the whole text counts. A keyword of several topics is the first one's.
    """
    topics = taxonomy or T.TOPICS
    names = [*topics, T.FALLBACK_TOPIC]
    place: dict[str, int] = {}
    for rank, words in enumerate(topics.values()):
        for word in words:
            place.setdefault(word, rank)
    key = tuple(place.items())

    def first(low: pa.Array) -> pa.Array:
        a, out = _automaton(key), []
        for t in low.to_pylist():
            best = len(names) - 1
            for _, rank in a.iter(t or ""):
                if rank < best:
                    best = rank
                    if not best:
                        break
            out.append(names[best] if t else None)
        return pa.array(out, pa.string())

    return F.arrow_udf(first, "string")(F.lower(text))


def is_refusal_text(text: Column) -> Column:
    return text.rlike(r"(?i)\b(" + "|".join(re.escape(p).replace(r"\ ", " ") for p in T.REFUSAL_PHRASES) + r")\b")


def is_refusal_option(option: Column) -> Column:
    return option.rlike(T.REFUSAL_OPTION_PATTERN)


def wave_year(survey: Column) -> Column:
    """Fielding year of a label such as ``ATP W32``; 0 when unknown."""
    wave = F.regexp_extract(survey, r"^ATP W\s*(\d+)\s*$", 1)
    years = F.create_map(*[F.lit(x) for kv in T.WAVE_YEARS.items() for x in (str(kv[0]), kv[1])])
    return F.coalesce(F.try_element_at(years, F.regexp_replace(wave, "^0+", "")), F.lit(0))


def stem(key: Column) -> Column:
    """Question key without its last ``_W`` suffix, upper-cased; NULL when it has none."""
    return F.when(key.contains("_W"), F.upper(F.regexp_extract(key, r"(?s)^(.*)_W", 1)))


def base_dataset(dataset: Column) -> Column:
    """Dataset name without a filter suffix, e.g. ``gss (2018)`` -> ``gss``."""
    return F.trim(F.substring_index(dataset, " ", 1))


def holdout_percent(dataset: Column) -> Column:
    pairs = [F.lit(x) for kv in T.HOLDOUT_PERCENT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), base_dataset(dataset)), F.lit(0))


def hex_number(text: Column, digits: int = 8) -> Column:
    """Leading hex digits of sha256(text) as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")


def is_private(dataset: Column, key: Column) -> Column:
    """True when (dataset, key) falls into the private holdout."""
    bucket = hex_number(F.concat(base_dataset(dataset), F.lit(":"), key)) % 100
    return F.coalesce(bucket < holdout_percent(dataset), F.lit(False))


def verdict(raw: Column) -> Column:
    word = F.regexp_extract(F.upper(F.trim(raw)), r"\b(SUCCESS|MIXED|FAILURE)\b", 1)
    return F.when(word == "", "unparseable").otherwise(F.lower(word))


def safe_key(key: Column) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9_\-]", "_")


def excerpt(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > 160, F.concat(F.substring(t, 1, 157), F.lit("…"))).otherwise(t)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def run_timestamp(run_id: Column, fallback: Column | None = None) -> Column:
    """ISO time from a ``_YYYYMMDD_HHMMSS`` suffix, else the fallback."""
    pat = r"_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$"
    iso = F.concat(
        F.regexp_extract(run_id, pat, 1), F.lit("-"), F.regexp_extract(run_id, pat, 2),
        F.lit("-"), F.regexp_extract(run_id, pat, 3), F.lit("T"),
        F.regexp_extract(run_id, pat, 4), F.lit(":"), F.regexp_extract(run_id, pat, 5),
        F.lit(":"), F.regexp_extract(run_id, pat, 6), F.lit("Z"),
    )
    return F.when(run_id.rlike(pat), iso).otherwise(F.lit(None) if fallback is None else fallback)


def template_name(raw: Column) -> Column:
    """Template file name without folder and extension; NULL for blank."""
    is_path = raw.contains("/") | raw.endswith(".md")
    return F.when(raw.isNull() | (raw == ""), None).when(is_path, file_stem(raw)).otherwise(raw)


def uniform(*parts: Column) -> Column:
    """Counter-based uniform number in [0, 1): the same on every engine and partitioning."""
    return hex_number(F.concat_ws("|", *[p.cast("string") for p in parts])) / F.lit(4294967296.0)
