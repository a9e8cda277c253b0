"""Run documents: JSON folder -> bronze text, typed runs and question rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,call_count:bigint,source:string>"
RUN_SCHEMA = f"""
    benchmark string, schema_version int, version string, timestamp string,
    config struct<dataset:string,provider:string,prompt_template:string,question_set_hash:string,topic:string,topic_filter:string,
        samples_per_question:int,n_requested:int,n_evaluated:int,temperature:double,parse_failure_rate:double,
        ensemble_sources:array<struct<file:string,provider:string,weight:double>>>,
    scores struct<sps:double,p_dist:double,p_rank:double,p_refuse:double,p_sub:double,p_cond:double>,
    aggregate struct<mean_jsd:double,median_jsd:double,mean_kendall_tau:double,composite_parity:double,elapsed_seconds:double,
        n_questions:int,n_parse_failures:int,question_set_hash:string,per_metric_ci:map<string,array<double>>,token_usage:{USAGE}>,
    reproducibility struct<seed:int,model_revision_hash:string,prompt_template_hash:string,framework_version:string,submitted_at:string>,
    raw_responses array<struct<key:string,raw_text:string,selected_option:string>>,
    demographic_breakdown map<string,array<struct<attribute:string,`group`:string,p_dist:double,p_cond:double,n_questions:int>>>,
    temporal_breakdown map<string,struct<p_dist:double,p_rank:double,mean_jsd:double,n_questions:int>>,
    per_question array<struct<key:string,text:string,options:array<string>,human_distribution:map<string,double>,
        model_distribution:map<string,double>,jsd:double,kendall_tau:double,parity:double,n_samples:int,n_parse_failures:int,
        temporal_year:int,model_refusal_rate:double,human_refusal_rate:double,
        token_usage:struct<input_tokens:bigint,output_tokens:bigint,call_count:bigint>>>"""


def scan_runs(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """Typed documents of one folder; texts that are no JSON object and foreign documents are left out.

    Every field is read at its own type: one of another type is null, and the rest of its
    document stays, whichever columns are asked for.
    """
    text = F.col("raw")
    doc = F.try_parse_json(text)
    # literals such as NaN and repeated keys are read by the JSON functions alone
    typed = F.when(doc.isNotNull(), F.try_variant_get(doc, "$", f"struct<{RUN_SCHEMA}>")).otherwise(F.from_json(text, RUN_SCHEMA))
    d = scan_bronze(spark, path).select("run_id", typed.alias("d")).where(F.col("d.benchmark") == marker).select("d.*", "run_id")
    return d.withColumn("ts", X.run_timestamp(F.col("run_id"), F.col("timestamp")))


#: Bytes of text from which a document is kept in parts, and of about one part.
WHOLE_BYTES, PART_BYTES = 1 << 20, 1 << 17
_TOKEN = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[{}\[\],"]', re.DOTALL)


class Cutter:
    """Cuts the text of one JSON document, fed in pieces, at elements of the arrays that are its members.

    ``feed`` and ``end`` give (part, text): part 0, the last, is the document with its cut arrays empty; every other
    part is an object of one member with some elements of its array. Their texts hold all of the document's,
    and all are JSON just when the document is. Only the text of about one part and of part 0 is held.
    """

    def __init__(self, part_bytes: int = PART_BYTES):
        self.part_bytes, self.buf, self.kept, self.stack = part_bytes, bytearray(), bytearray(), bytearray()
        self.name, self.parts, self.cut, self.inside, self.at = b"", 0, False, False, 0

    def _part(self, text: bytes) -> tuple[int, bytes]:
        self.parts += 1
        closed = b"," if self.cut and not text.strip() else text  # nothing after a comma is no JSON
        self.cut = True
        return self.parts, b"{" + self.name + b":[" + closed + b"]}"

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        buf, stack = self.buf, self.stack
        buf += piece
        start, stop = 0, len(buf)  # of the text not yet given away, and of the text that was looked at
        for m in _TOKEN.finditer(buf, self.at):
            c = buf[m.start()]
            if c == 34:
                if m.end() - m.start() == 1:  # a text that goes on in the next piece
                    stop = m.start()
                    break
                if len(stack) == 1:
                    self.name = m.group()
            elif c in b"{[":
                stack.append(c)
                if not self.inside and stack == b"{[":
                    self.kept += buf[start : m.end()]
                    start, self.inside, self.cut = m.end(), True, False
            elif c == 44:
                if self.inside and len(stack) == 2 and m.start() - start >= self.part_bytes:
                    yield self._part(bytes(buf[start : m.start()]))
                    start = m.end()
            elif stack:
                if self.inside and len(stack) == 2:
                    if self.cut:
                        yield self._part(bytes(buf[start : m.start()]))
                    else:
                        self.kept += buf[start : m.start()]
                    start, self.inside = m.start(), False
                stack.pop()
        if not self.inside:
            self.kept += buf[start:stop]
            start = stop
        del buf[:start]
        self.at = stop - start

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.inside and self.cut:
            yield self._part(bytes(self.buf))
        else:
            self.kept += self.buf
        yield 0, bytes(self.kept)


def _large_documents(spark: SparkSession, path: str, glob: str, part_bytes: int) -> DataFrame:
    """The parts of large documents. Their texts are read between closing braces, put in order of the file by a sort
    that may spill, and cut by one task per file, which holds one part at a time."""
    d = spark.read.option("pathGlobFilter", glob).text(path, lineSep="}").where(F.col("_metadata.file_size") > WHOLE_BYTES)
    d = d.select(*_file_columns(d), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq"), F.col("value").cast("binary").alias("_text"))
    names = ["run_id", "file_size", "modified", "file"]
    schema = "run_id string, file_size bigint, modified timestamp, file string, part int, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, told, size, read = None, None, 0, 0

        def made(out) -> Iterator[pa.RecordBatch]:
            for part, text in out:
                yield pa.RecordBatch.from_arrays([*told, pa.array([part], pa.int32()), pa.array([text], pa.binary())], names=[*names, "part", "text"])

        def ended() -> Iterator[pa.RecordBatch]:
            if cutter is not None:
                if read < size:  # what lies behind the last brace is a row, if only an empty one at the end is not
                    yield from made(cutter.feed(b"}"))
                yield from made(cutter.end())

        for batch in batches:
            files = batch["file"].to_pylist()
            texts = batch["_text"].to_pylist()
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                if told is None or told[3][0].as_py() != files[first]:
                    yield from ended()
                    cutter, told, size, read = Cutter(part_bytes), [batch[c].slice(first, 1) for c in names], batch["file_size"][first].as_py(), 0
                    lead = b""
                else:
                    lead = b"}"
                piece = lead + b"}".join(texts[first:last])
                read += len(piece)
                yield from made(cutter.feed(piece))
                first = last
        yield from ended()

    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = d.repartition(n, "file").sortWithinPartitions("file", "_at", "_seq").drop("_at", "_seq")
    return ordered.mapInArrow(run, schema).withColumn("value", F.col("text").cast("string")).drop("text")


def _file_columns(d: DataFrame) -> list:
    run_id = F.col("run_id").cast("string") if "run_id" in d.columns else X.file_stem(F.col("_metadata.file_name"))
    return [run_id.alias("run_id"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file")]


def write_bronze(spark: SparkSession, path: str, out: str, glob: str = "*.json", part_bytes: int = PART_BYTES) -> None:
    """Documents of a folder tree, written once as VARIANT with their files' metadata.

    A document's run id is the ``run_id`` of its folder, else its file name. A text that is no JSON
    keeps its raw form, so nothing of the folder is lost; a file without a byte holds no document.
    A document of up to ``WHOLE_BYTES`` is one row, part 0. Of a larger one part 0 lacks the elements of its long
    arrays; they are in the rows of its other parts, in order, so that no task holds a large document.
    """
    d = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).where(F.col("_metadata.file_size") <= WHOLE_BYTES)
    small = d.select(*_file_columns(d), F.lit(0).alias("part"), "value")
    doc = F.try_parse_json("value")
    small.unionByName(_large_documents(spark, path, glob, part_bytes)).select(
        "run_id", "file_size", "modified", doc.alias("doc"), F.when(doc.isNull(), F.col("value")).alias("raw"), "part", "file",
    ).write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(out)


def bronze_status(bronze: DataFrame, marker: str) -> DataFrame:
    """Every document's status: ok, foreign (another benchmark or no object) or corrupt (no JSON in one of its parts)."""
    own = F.try_variant_get("doc", "$.benchmark", "string").eqNullSafe(F.lit(marker))
    broken = bronze.where("part > 0 AND doc IS NULL").select("file").distinct().withColumn("_broken", F.lit(True))
    d = bronze.where("part = 0").join(broken, "file", "left")
    return d.withColumn("status", F.when(F.col("doc").isNull() | F.col("_broken").isNotNull(), "corrupt").when(own, "ok").otherwise("foreign")).drop("_broken")


def bronze_parts(bronze: DataFrame) -> DataFrame:
    """The parts of every document that are JSON, each path read at its own type; a field of another type is null."""
    typed = F.try_variant_get("doc", "$", f"struct<{RUN_SCHEMA}>")
    return bronze.where("doc IS NOT NULL").select("file", "part", typed.alias("d")).select("file", "part", "d.*")


def bronze_runs(bronze: DataFrame, marker: str, gathered: bool = True) -> DataFrame:
    """Typed documents of the bronze table, each path read at its own type; a field of another type is null.

    The arrays of large documents are put together again, unless the caller takes them from ``bronze_parts`` and says so
    (``gathered``): a whole document is one value in one task.
    """
    typed = F.try_variant_get("doc", "$", f"struct<{RUN_SCHEMA}>")
    d = bronze_status(bronze, marker).where("status = 'ok'").select("run_id", "file", typed.alias("d")).select("d.*", "run_id", "file")
    if gathered:
        arrays = ["raw_responses", "per_question"]
        more = bronze_parts(bronze).where("part > 0").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("part", *arrays)), lambda a, b: a["part"] - b["part"]).alias("_more"))
        d = d.join(more, "file", "left")
        for c in arrays:
            rest = F.flatten(F.filter(F.col(f"_more.{c}"), lambda a: a.isNotNull()))
            d = d.withColumn(c, F.when(F.col("_more").isNotNull() & F.col(c).isNotNull(), F.concat(F.col(c), rest)).otherwise(F.col(c)))
        d = d.drop("_more", "file")
    return d.withColumn("ts", X.run_timestamp(F.col("run_id"), F.col("timestamp")))


def scan_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Whole text per file for the shape checks."""
    d = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return d.select(X.file_stem(F.col("_metadata.file_name")).alias("run_id"), F.col("value").alias("raw"))


def runs_of(docs: DataFrame) -> DataFrame:
    """Flat run rows in the column names the operators use."""
    return docs.select(
        "run_id", "ts", F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.coalesce("config.dataset", F.lit("unknown")).alias("dataset"), F.coalesce("config.provider", F.lit("unknown")).alias("provider"),
        F.col("config.prompt_template").alias("template"), "config.temperature", "config.samples_per_question",
        F.coalesce("config.topic_filter", "config.topic").alias("topic"), "config.parse_failure_rate", "config.ensemble_sources",
        F.coalesce("config.question_set_hash", "aggregate.question_set_hash").alias("question_set_hash"),
        "scores.sps", "scores.p_dist", "scores.p_rank", "scores.p_refuse", "scores.p_sub", "scores.p_cond",
        "aggregate.mean_jsd", "aggregate.median_jsd", F.col("aggregate.mean_kendall_tau").alias("mean_tau"), "aggregate.composite_parity",
        F.coalesce("config.n_evaluated", "aggregate.n_questions").alias("n_questions"),
        F.col("aggregate.token_usage.input_tokens").alias("input_tokens"), F.col("aggregate.token_usage.output_tokens").alias("output_tokens"),
        F.col("raw_responses").isNotNull().alias("has_raw"),
    )


def questions_of(docs: DataFrame) -> DataFrame:
    """Question rows with both sides laid out along the union of options, listed ones first."""
    from ..functions.distance import align

    q = docs.select("run_id", F.coalesce("config.dataset", F.lit("unknown")).alias("dataset"), F.explode("per_question").alias("q")).select("run_id", "dataset", "q.*")
    empty = F.create_map().cast("map<string,double>")
    h, m = F.coalesce("human_distribution", empty), F.coalesce("model_distribution", empty)
    listed = F.coalesce("options", F.array().cast("array<string>"))
    both = F.array_union(F.map_keys(h), F.map_keys(m))
    d = q.withColumn("options", F.array_union(F.array_intersect(listed, both), both))
    return (
        d.withColumn("p_human", align(F.col("options"), h)).withColumn("p_model", align(F.col("options"), m))
        .withColumnRenamed("kendall_tau", "tau").drop("human_distribution", "model_distribution")
    )


def raw_of(docs: DataFrame) -> DataFrame:
    return docs.select("run_id", F.explode("raw_responses").alias("r")).select("run_id", "r.*")


def stamp_version(df: DataFrame) -> DataFrame:
    """Documents without a schema version are version 1."""
    return df.withColumn("schema_version", F.coalesce("schema_version", F.lit(1)))
