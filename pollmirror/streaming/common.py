"""Shared helpers of the streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder; a temporary one only in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        return tempfile.mkdtemp(prefix=f"pollmirror-{name}-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int = 16) -> DataFrame:
    """One Parquet table of a folder as a file stream, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str] | None) -> Iterator[None]:
    """Session settings for as long as a stream is started and run; the old ones come back."""
    old = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> list:
    """Run a stream over everything available into a Parquet folder; returns the progress of its batches."""
    with settings(stream.sparkSession, conf):
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return list(query.recentProgress)
