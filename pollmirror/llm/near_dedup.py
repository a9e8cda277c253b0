"""Near-duplicate components with fast similarity sketches, banding and exact verification.

A sketch has ``BINS`` bins. In round i every element of a set is hashed to a bin with a value
that ranks by round first; a bin keeps its least value. Rounds go on until all bins are filled,
which large sets reach in about one round; from round ``BINS`` on each round fills one bin with
the least of all elements, so 2 * ``BINS`` rounds always do. Two sets agree in a bin with a
probability of their Jaccard similarity, closely concentrated over the bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix64, slices, text_of, word_hashes, written

#: 32 bands of 5 bins: a pair of similarity 0.8 is missed with probability 3e-6.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
WORDS, PERCENT = 4, 80
#: 64-bit words of a parity sketch.
PARITY = 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles.

    A text of fewer words has its whole word sequence as one; one without words the empty set.
    """
    words, counts = word_hashes([t.translate(LOWER) for t in texts])
    out, at = [], 0
    for n in counts.tolist():
        w = words[at : at + n]
        at += n
        width = min(k, n)
        h = np.full(max(n - width + 1, 0), width, np.uint64)
        for j in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[j : n - width + 1 + j])
        out.append(np.unique(h) if n else h[:0])
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per set; empty sets keep empty bins."""
    out = np.full((len(sets), bins), _EMPTY)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * bins):
        if not len(x):
            break
        h = mix64(x + np.uint64((i + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        place = ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + place, (np.uint64(i) << np.uint64(54)) | (mix64(h) >> np.uint64(10)))
        open_rows = (out == _EMPTY).any(axis=1)
        more = open_rows[owner]
        if not more.all():
            x, owner = x[more], owner[more]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, ROWS)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2])
    for j in range(ROWS):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key


def parities(sets: list[np.ndarray], words: int = PARITY) -> np.ndarray:
    """One row of ``words`` words per set: bit i is the parity of the elements hashed to i.

    Every element that only one of two sets has flips one bit, so their words never differ in
    more bits than the sets differ in elements.
    """
    x = mix64(np.concatenate(sets)) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros(len(sets) * words, np.uint64)
    at = owner * words + ((x >> np.uint64(6)) % np.uint64(words)).astype(np.int64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (x & np.uint64(63)))
    return out.reshape(len(sets), words)


def parity_table(texts: DataFrame, k: int) -> DataFrame:
    """cls, its band keys and parity words w0, w1, ... of every row (doc_id, t)."""
    names = [f"w{i}" for i in range(PARITY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(raw):
                sets = shingle_sets(raw[a:b], k)
                bits, keys = parities(sets).view(np.int64), band_keys(sketches(sets)).view(np.int64)
                bands = pa.array(list(keys), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), bands, *map(pa.array, bits.T.copy())], ["cls", "bands", *names])

    return texts.select("doc_id", "t").mapInArrow(run, "cls bigint, bands array<bigint>, " + ", ".join(f"{n} bigint" for n in names))


def sketch_table(docs: DataFrame, text: str, id_col: str, k: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit digest (d1, d2) of the shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], k)
                keys = band_keys(sketches(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([mix64(s).sum() for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum() for s in sets], np.uint64).view(np.int64)),
                        pa.array([row if len(s) else [] for row, s in zip(keys, sets)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "bands"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_of(text).alias("t"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, good = batch["a"].to_pylist(), batch["b"].to_pylist(), []
            last, left = None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, left = a[i], shingle_sets([batch["ta"][i].as_py().encode()], k)[0]
                right = shingle_sets([batch["tb"][i].as_py().encode()], k)[0]
                common = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every linked id: contraction by the least hashed neighbour, a few rounds.

    Each round hooks every node to the neighbour of least hash and keeps the edges between
    different hooks; a fixed part of the nodes goes in every round.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct(), "labels")
    while not edges.isEmpty():
        rank = F.struct(F.xxhash64(F.lit("hook"), "b"), F.col("b"))
        own = F.struct(F.xxhash64(F.lit("hook"), "a"), F.col("a"))
        hooks = edges.groupBy("a").agg(F.min(rank).getField("b").alias("p"), F.min(rank).alias("least"))
        hooks = written(hooks.select(F.col("a").alias("root"), F.when(F.col("least") < own, F.col("p")).otherwise(F.col("a")).alias("p")), "hooks")
        labels = written(labels.join(hooks, "root", "left").select("id", F.coalesce("p", "root").alias("root")), "labels")
        moved = edges.join(hooks.withColumnsRenamed({"root": "a", "p": "pa"}), "a").join(hooks.withColumnsRenamed({"root": "b", "p": "pb"}), "b")
        edges = written(moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges")
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents of equal shingle sets are one class. In every band bucket each class is first
    compared with the bucket's least one. Buckets that then lie in one component have nothing
    left to find; in the others every class outside the bucket's largest component is held
    against all classes of other components, by size and parity words, which never rule out a
    linked pair; the pairs left are confirmed on full sets. So no link is lost that shares a
    bucket, and a group of copies costs about one comparison per copy. Many texts that share
    buckets but are not linked still cost one parity test per pair and bucket.

    ``kept`` is doc_id = component_id, the least id reachable over links. A null or empty text,
    or one without words, has no shingles and is linked with nothing; a row with a null id is
    linked with nothing and kept, its component is null. Repeated rows get the same result. An
    empty table gives no rows.
    """
    table = written(sketch_table(docs, text, id_col, k), "sketches")
    sets = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("cls")), "classes")
    reps = sets.select("d1", "d2", "doc_id", "n_shingles", "bands").join(classes, ["d1", "d2"]).where("doc_id = cls")
    spread = reps.select("cls", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct()
    buckets = spread.groupBy("key").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(spread.join(buckets.select("key", "lead"), "key"), "members")
    ids = members.select(F.col("cls").alias("doc_id")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_of(text).alias("t"))
    texts = written(rows.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sizes alone rule the others out
    size = members.select(F.col("cls").alias("lead"), F.col("n").alias("n_lead")).distinct()
    star = members.where("cls <> lead").select("lead", "cls", "n").distinct().join(size, "lead").where(near(F.col("n"), F.col("n_lead")))
    star = written(star.select(F.col("lead").alias("a"), F.col("cls").alias("b")), "star")
    links = written(verified(star, texts, k, percent), "links")
    labels = components(links)

    inside = members.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
    parts = inside.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("key").agg(F.max(F.struct("m", "root")).getField("root").alias("top"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    mixed = written(inside.join(largest.select("key", "top"), "key"), "mixed")
    open_ids = mixed.select(F.col("cls").alias("doc_id")).distinct()
    signs = written(parity_table(texts.join(open_ids, "doc_id", "left_semi"), k), "parities")
    signed = mixed.join(signs, "cls").withColumn("out", F.col("root") != F.col("top")).drop("top")
    left = signed.where("out").select([F.col(c).alias(f"{c}_x") for c in signed.columns]).withColumnRenamed("key_x", "key")
    flips = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"w{i}_x"))) for i in range(PARITY)), F.lit(0))
    once = (~F.col("out") | (F.col("cls") > F.col("cls_x"))) & (F.array_min(F.array_intersect("bands", "bands_x")) == F.col("key"))
    apart = (F.col("root") != F.col("root_x")) & near(F.col("n"), F.col("n_x"))
    right = signed.withColumnRenamed("key", "key_y")
    cross = left.join(right, (F.col("key") == F.col("key_y")) & apart & ((100 + percent) * flips <= (100 - percent) * (F.col("n") + F.col("n_x"))) & once)
    cross = cross.select(F.least("cls_x", "cls").alias("a"), F.greatest("cls_x", "cls").alias("b")).join(star, ["a", "b"], "left_anti")
    cross = written(cross, "cross")
    if not cross.isEmpty():
        labels = components(written(links.union(verified(cross, texts, k, percent)), "links"))

    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    found = labels.join(least, "root").select(F.col("id").alias("cls"), "component")
    classes = classes.join(found, "cls", "left").select("d1", "d2", F.coalesce("component", "cls").alias("component"))
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = table.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def keep_one_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when one document of each component is kept.

    Of a component the rows of its smallest id stay; rows without words, and rows with a null id, are
    components of their own. The caller's columns travel as one value, so none can clash.
    """
    gone = near_duplicates(docs, text, id_col, k, percent).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
