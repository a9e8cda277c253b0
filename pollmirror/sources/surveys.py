"""Survey sources: readers for their file layouts and the normalising steps.

Readers return raw rows with an ingest number ``seq`` where line order matters. The
normalising steps are plain joins and aggregates, so a source of any size is spread over
the cluster; the outputs are long rows (key, option, pos, p).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables as T

SKIPPED_SUBKEYS = ["MC_options", "question_text"]


# --- readers --------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, all columns as text, plus ``seq``; missing columns are an error.

    ``seq`` orders lines by file, then block of the file, then place in the block. Numbers in
    file names count as numbers, so part 2 comes before part 10.
    """
    d = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    file = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"(\d+)", "0" * 20 + "$1"), r"\d*(\d{20})", "$1")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    d = d.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in d.columns], place.alias("seq"))
    missing = [c for c in required if c not in d.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return d


def read_wave_files(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<wave dir>/<ATTRIBUTE>_data.json`` as (wave_dir, attribute, raw)."""
    d = spark.read.option("wholetext", True).option("pathGlobFilter", "*_data.json").option("recursiveFileLookup", True).text(root)
    path = F.col("_metadata.file_path")
    return d.select(
        F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("wave_dir"),
        F.regexp_extract(path, r"([^/]+)_data\.json$", 1).alias("attribute"),
        F.col("value").alias("raw"),
    )


def read_wave_info(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<wave dir>/info.csv`` as (wave_dir, key, question, references, ...)."""
    d = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("pathGlobFilter", "info.csv")
        .option("recursiveFileLookup", True).csv(root)
    )
    return d.withColumn("wave_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


# --- helpers --------------------------------------------------------------------------


def clean(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def shares(long: DataFrame, by: list[str], weight: str, carry: list[str] | None = None) -> DataFrame:
    """weight -> share per group as ``p``, for groups with a total above 0.

    A group is the options of a question, so its total is taken over it in place and ``long`` is made once.
    """
    d = long.dropna(subset=by).withColumn("_t", F.sum(weight).over(Window.partitionBy(*by))).where("_t > 0")
    return d.withColumn("p", F.col(weight) / F.col("_t")).select(*by, *[c for c in long.columns if c not in (*by, weight, "p")], "p")


def renormalise(long: DataFrame, by: list[str]) -> DataFrame:
    """Divide by the total of a group, the options of a question, only when it is off 1 by more than 0.01."""
    d = long.dropna(subset=by).withColumn("_t", F.sum("p").over(Window.partitionBy(*by)))
    off = (F.abs(F.col("_t") - 1.0) > 0.01) & (F.col("_t") > 0)
    d = d.withColumn("p", F.when(off, F.col("p") / F.col("_t")).otherwise(F.col("p")))
    return d.select(*by, *[c for c in long.columns if c not in by])


def parse_options(refs: Column) -> Column:
    """Option list from a bracketed, quoted list or from comma separated text."""
    quoted = F.transform(
        F.regexp_extract_all(refs, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""), 1),
        lambda x: F.substring(x, F.lit(2), F.length(x) - 2),
    )
    plain = F.filter(F.transform(F.split(refs, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(refs).startswith("["), quoted).otherwise(plain)


# --- count tables ---------------------------------------------------------------------


def count_table(raw: DataFrame, stratum: str, prefix: str, only: str | None = None) -> DataFrame:
    """question x stratum x option counts -> (key, text, option, pos, p), one stratum or their sum.

    Blank cells, counts that are no number and counts <= 0 are dropped, as are options
    without any count. ``pos`` is the order of an option's first line.
    """
    d = raw.select(
        clean("question_id").alias("q"), clean("question_text").alias("text"), clean(stratum).alias("s"),
        clean("option").alias("option"), clean("count").try_cast("double").alias("n"), "seq",
    ).where("q <> '' AND text <> '' AND s <> '' AND option <> '' AND n > 0")
    picked = F.lit(True) if only is None else F.col("s") == only
    per = d.groupBy("q", "option").agg(
        F.min("seq").alias("pos"), F.sum(F.when(picked, F.col("n")).otherwise(F.lit(0.0))).alias("n")
    )
    texts = d.groupBy("q").agg(F.min_by("text", "seq").alias("text"))
    out = shares(per.where("n > 0"), ["q"], "n").join(texts, "q")
    return out.select(F.concat(F.lit(prefix), "q").alias("key"), "text", "option", "pos", "p")


# --- microdata ------------------------------------------------------------------------


def microdata(raw: DataFrame, prefix: str, only_year: str | None = None) -> DataFrame:
    """Long answer lines -> one row per (respondent, year): last answer and first subgroup win."""
    groups = [c for c in raw.columns if c.startswith("subgroup_")]
    d = raw.select(
        clean("respondent_id").alias("rid"), clean("year").alias("year"), clean("question_id").alias("q"), clean("option").alias("option"),
        "seq", *[clean(c).alias(c) for c in groups],
    ).where("rid <> '' AND year <> '' AND q <> '' AND option <> ''")
    if only_year is not None:
        d = d.where(F.col("year") == only_year)
    first = F.min_by(F.struct(*groups), "seq") if groups else F.lit(None)
    answers = d.groupBy("rid", "year", "q").agg(F.max_by("option", "seq").alias("option"))
    people = d.groupBy("rid", "year").agg(first.alias("_g"))
    # a respondent's answers are bounded by the questionnaire
    maps = answers.groupBy("rid", "year").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(prefix), "q").alias("k"), F.col("option"))))).alias("responses")
    )
    out = maps.join(people, ["rid", "year"])
    if groups:
        pairs = F.filter(
            F.array(*[F.struct(F.lit(c[len("subgroup_"):]).alias("k"), F.col(f"_g.{c}").alias("v")) for c in groups]), lambda e: e["v"] != ""
        )
        out = out.withColumn("subgroup", F.map_from_entries(pairs))
    return out.select(
        F.concat_ws("@", "rid", "year").alias("respondent_id"), F.concat(F.lit(prefix.rstrip("_") + ":"), "year").alias("wave"),
        "responses", *(["subgroup"] if groups else []), "rid", "year",
    )


def microdata_for_question(raw: DataFrame, key: str, prefix: str, only_year: str | None = None) -> DataFrame:
    """Rows of the respondents who answered the question, asked for by its bare or prefixed id.

    The long lines are cut to those respondents before any row is built.
    """
    bare = key[len(prefix) :] if key.startswith(prefix) else key
    rid, year = clean("respondent_id").alias("_r"), clean("year").alias("_y")
    answered = raw.where((clean("question_id") == bare) & (clean("option") != "")).select(rid, year).distinct()
    kept = raw.join(answered, (clean("respondent_id") == F.col("_r")) & (clean("year") == F.col("_y")), "left_semi")
    return microdata(kept, prefix, only_year)


# --- wave files -----------------------------------------------------------------------


def wave_counts(files: DataFrame) -> DataFrame:
    """Nested wave files -> (wave_dir, attribute, key, group, option, n).

    Every file is exploded where it is read; entries that are no mapping (option lists,
    question text) fall out because they do not parse as one.
    """
    keys = files.select("wave_dir", "attribute", F.explode(F.from_json("raw", "map<string,string>")).alias("key", "_e"))
    groups = keys.select("wave_dir", "attribute", "key", F.explode(F.from_json("_e", "map<string,string>")).alias("group", "_c"))
    groups = groups.where(~F.col("group").isin(SKIPPED_SUBKEYS))
    return groups.select("wave_dir", "attribute", "key", "group", F.explode(F.from_json("_c", "map<string,double>")).alias("option", "n"))


def preferred_files(files: DataFrame) -> DataFrame:
    """Per wave the overall file, else the alphabetically first attribute."""
    choice = files.groupBy("wave_dir").agg(F.min(F.struct(F.col("attribute") != "NONE", "attribute")).getField("attribute").alias("attribute"))
    return files.join(choice, ["wave_dir", "attribute"], "left_semi")


def in_waves(files: DataFrame, glob: str) -> DataFrame:
    """Files of the wave folders that match a name pattern with * and ?."""
    pattern = re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".")
    return files.where(F.col("wave_dir").rlike(f"^{pattern}$"))


def wave_questions(files: DataFrame, info: DataFrame, key_prefix: bool = False, waves: str = "*") -> DataFrame:
    """Overall distributions of every wave whose folder matches ``waves``, all subgroups summed, for keys with metadata."""
    counts = wave_counts(preferred_files(in_waves(files, waves))).select("wave_dir", "key", "option", "n")
    # spread by question once: the sums, the totals and the metadata meet there
    counts = counts.repartition("wave_dir", "key").groupBy("wave_dir", "key", "option").agg(F.sum("n").alias("p"))
    dist = renormalise(counts, ["wave_dir", "key"])
    meta = info.where("key <> ''").select(
        "wave_dir", "key", F.coalesce("question", "key").alias("text"), parse_options(F.col("references")).alias("options")
    ).where(F.size("options") > 0)
    out = dist.join(meta, ["wave_dir", "key"])
    key = F.concat_ws(":", "wave_dir", "key") if key_prefix else F.col("key")
    return out.select("wave_dir", key.alias("key"), "text", "options", "option", (F.array_position("options", F.col("option")) - 1).alias("pos"), "p")


def group_distributions(counts: DataFrame, wave_order: str = "wave_dir") -> DataFrame:
    """Counts -> shares per (question, group); unnamed groups out, the latest wave's question wins.

    Waves are ordered by the number in their name, then by name.
    """
    # spread by question once: the totals of its groups and its latest wave are taken there
    d = counts.where("group <> 'nan'").repartition("attribute", "key")
    d = shares(d, ["attribute", "key", wave_order, "group"], "n")
    number = F.regexp_extract(F.col(wave_order).cast("string"), r"(\d+)", 1).try_cast("bigint")
    latest = F.max(F.struct(number.alias("number"), F.col(wave_order).alias("wave"))).over(Window.partitionBy("attribute", "key"))
    return d.withColumn("_l", latest).where(F.col(wave_order) == F.col("_l.wave")).drop("_l")


# --- probability tables ---------------------------------------------------------------


def country_questions(rows: DataFrame, country: str | None = None) -> DataFrame:
    """Per-country probabilities -> one country, or the unweighted mean over a question's countries.

    ``rows``: i, text, options, selections (country -> probabilities).
    """
    key = F.concat(F.lit("GOQA_"), "i", F.lit("_"), F.substring(F.sha2("text", 256), 1, 8))
    d = rows.where("text <> ''").withColumn("key", key).withColumn("_k", F.size("selections"))
    d = d.select("key", "text", "options", "_k", F.explode("selections").alias("country", "_p"))
    if country is not None:
        d = d.where(F.col("country") == country).withColumn("_k", F.lit(1))
    d = d.select("key", "text", "_k", "options", F.posexplode("_p").alias("pos", "x")).where(F.col("pos") < F.size("options"))
    d = d.withColumn("option", F.element_at("options", F.col("pos") + 1).cast("string"))
    mean = d.groupBy("key", "text", "_k", "option", "pos").agg(F.sum("x").alias("_s"))
    return renormalise(mean.withColumn("p", F.col("_s") / F.col("_k")).drop("_s", "_k"), ["key"])


def available_countries(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.map_keys("selections")).alias("country")).distinct().orderBy("country")


def align_refusal(rows: DataFrame) -> DataFrame:
    """Append the refusal rate where options end in a refusal and are one longer than the responses."""
    last = F.lower(F.element_at("options", -1))
    short = (F.size("options") == F.size("responses") + 1) & last.isin("refused", "dk/refused")
    return rows.withColumn("responses", F.when(short, F.concat("responses", F.array(F.coalesce("refusal_rate", F.lit(0.0))))).otherwise(F.col("responses")))


def subgroup_questions(rows: DataFrame) -> DataFrame:
    """Mean over the subgroup rows whose lengths match, normalised by the total."""
    d = rows.where(F.size("options") == F.size("responses")).select("qkey", "options", F.posexplode("responses").alias("pos", "x"))
    sums = d.groupBy("qkey", "pos").agg(F.sum("x").alias("n"), F.first(F.element_at("options", F.col("pos") + 1)).alias("option"))
    return shares(sums, ["qkey"], "n")


def subgroup_distributions(rows: DataFrame, attribute: str) -> DataFrame:
    """Group distributions of one attribute (any case); the last row of a (question, group) wins."""
    d = rows.where((F.upper("attribute") == attribute.upper()) & (F.size("options") == F.size("responses")))
    return d.groupBy("qkey", "group").agg(F.max_by(F.map_from_arrays("options", "responses"), "seq").alias("dist"))


# --- monthly tables -------------------------------------------------------------------


def monthly(raw: DataFrame, options: list[str], by: list[str]) -> DataFrame:
    """Wide month rows -> mean of the row-wise shares per option.

    Headers match in any case; a row with a missing or non-numeric option is left out whole.
    """
    names = {c.strip().lower(): c for c in raw.columns}
    absent = [o for o in options if o.strip().lower() not in names]
    cols = [F.lit(None).cast("double") if o in absent else F.trim(F.col(f"`{names[o.strip().lower()]}`").cast("string")).try_cast("double") for o in options]
    d = raw.select(*by, F.array(*cols).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    d = d.where(~F.exists("_v", lambda x: x.isNull()) & (total > 0)).withColumn("_t", total)
    means = d.groupBy(*by).agg(*[F.avg(F.col("_v")[i] / F.col("_t")).alias(f"_m{i}") for i in range(len(options))])
    pairs = F.array(*[F.struct(F.lit(o).alias("option"), F.lit(i).alias("pos"), F.col(f"_m{i}").alias("p")) for i, o in enumerate(options)])
    return means.select(*by, F.explode(pairs).alias("_z")).select(*by, "_z.option", "_z.pos", "_z.p").where("p IS NOT NULL")


# --- proportion tables ----------------------------------------------------------------


def _unquoted(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), '^"+|"+$', "")


def _proportion(c: str) -> Column:
    x = F.trim(F.col(c)).try_cast("double")
    return F.when(x.between(0.0, 1.0), x)


def _keyed(raw: DataFrame, only: str | None) -> DataFrame:
    d = raw.withColumn("_v", _unquoted("variable")).withColumn("_d", _unquoted("dataset")).withColumn("_u", _unquoted("universe"))
    d = d.where((F.col("_v") != "") & ~F.col("_v").isin(T.UNIVERSE_MARKERS))
    if only:
        d = d.where(F.col("_d") == only)
    universe = F.when(F.col("_u") == "", "all").otherwise(F.col("_u"))
    return d.withColumn("key", F.concat_ws("_", F.lit("NTIA"), F.regexp_replace("_d", " ", "_"), "_v", universe))


def _yes_no(p: Column) -> Column:
    return F.explode(F.array(F.struct(F.lit("Yes").alias("option"), p.alias("p")), F.struct(F.lit("No").alias("option"), (F.lit(1.0) - p).alias("p"))))


def proportion_questions(raw: DataFrame, only: str | None = None) -> DataFrame:
    """National proportion -> Yes / No; empty or impossible values are missing, not zero."""
    d = _keyed(raw, only).withColumn("_p", _proportion("usProp")).where("_p IS NOT NULL")
    phrase = F.try_element_at(F.create_map(*[F.lit(x) for kv in T.UNIVERSE_PHRASES.items() for x in kv]), F.col("_u"))
    base = F.trim(_unquoted("description"))
    base = F.when(base == "", "(no description)").otherwise(base)
    text = F.when(phrase.isNotNull(), F.concat(base, F.lit(" ("), phrase, F.lit(")?"))).otherwise(F.concat(base, F.lit("?")))
    return d.select("key", text.alias("text"), _yes_no(F.col("_p")).alias("_z")).select("key", "text", "_z.option", "_z.p")


def proportion_groups(raw: DataFrame, attribute: str, only: str | None = None, labels: dict | None = None) -> DataFrame:
    """``<prefix>Prop`` columns -> group rows of one attribute."""
    groups = (labels or T.PROPORTION_GROUPS)[attribute.upper()]
    present = [(f"{p}Prop", label) for p, label in groups if f"{p}Prop" in raw.columns]
    cells = F.array(*[F.struct(F.lit(label).alias("group"), _proportion(c).alias("p")) for c, label in present])
    d = _keyed(raw, only).select("key", F.explode(cells).alias("_g")).where("_g.p IS NOT NULL")
    return d.select("key", F.col("_g.group").alias("group"), _yes_no(F.col("_g.p")).alias("_z")).select("key", "group", "_z.option", "_z.p")


# --- silver ---------------------------------------------------------------------------


def write_questions(long: DataFrame, path: str) -> None:
    """The normalised question table, one partition per dataset.

    Only the datasets in ``long`` are written: one that is refreshed is replaced whole, the others stay as
    they are. Rows of a dataset are spread by question, so a large one is several files.
    """
    spread = long.repartition("dataset", F.pmod(F.xxhash64("key"), F.lit(16)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def cached_questions(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """The written table; of one dataset only its own partition is read."""
    d = spark.read.option("basePath", path).parquet(path)
    return d if dataset is None else d.where(F.col("dataset") == dataset)
