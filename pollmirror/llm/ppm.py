"""Language-model scoring: prediction by partial matching over bytes, and a smoothed unigram base.

The trie holds, for contexts of 0 to ``ORDER`` bytes, how often each symbol followed in the
training texts. A symbol is coded at the longest context that knows it; every longer known
context costs an escape (method C: distinct symbols against occurrences), and symbols that a
longer context knew are excluded below. Statistics are fixed after training, so both the symbols
and the escape of a node depend on the node alone: the law of a position is that of its last
``ORDER`` + 1 symbols, and is worked out once for each distinct run of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, fold, mix64, slices, text_of, word_hashes, written

ORDER = 4
#: Symbols are bytes; 256 ends a text and fills the context before it.
EDGE, SYMBOLS, BITS = 256, 257, 9
#: Runs of symbols of at least this share of all positions are broadcast (at most 2,000,000); the others are joined.
RUN_SHARE = 5e-7
#: Words of at least this share of all tokens are broadcast (at most 500,000); the others are joined.
WORD_SHARE = 2e-6
END = np.uint64(0x0123456789ABCDEF)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
LN10 = np.log(10.0)


class Lookup:
    """Open-addressing map from 64-bit keys to row numbers, all steps vectorised."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.mask = np.uint64((1 << max(4, int(2 * len(keys) + 1).bit_length())) - 1)
        self.slots = np.full(int(self.mask) + 1, _FREE)
        self.rows = np.zeros(int(self.mask) + 1, np.int32)
        todo, at = np.arange(len(keys)), mix64(keys) & self.mask
        while len(todo):
            free = self.slots[at] == _FREE
            spot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.slots[spot], self.rows[spot] = keys[todo[put]], todo[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is unknown."""
        out = np.full(len(keys), -1, np.int32)
        todo, at = None, mix64(keys) & self.mask
        while True:
            held = self.slots[at]
            hit, more = held == keys, held != _FREE
            got = self.rows[at[hit]]
            if todo is None:
                out[hit] = got
                todo = np.flatnonzero(more & ~hit)
                keys, at = keys[todo], at[todo]
            else:
                out[todo[hit]] = got
                go = more & ~hit
                todo, keys, at = todo[go], keys[go], at[go]
            if not len(todo):
                return out
            at = (at + np.uint64(1)) & self.mask


def symbol_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every byte and end of the texts, and the text each is from."""
    pad = np.full(ORDER, EDGE, np.uint64)
    parts = []
    for t in texts:
        parts += [pad, np.frombuffer(t.translate(LOWER), np.uint8), pad[:1]]
    x = np.concatenate([p.astype(np.uint64) for p in parts]) if parts else pad[:0]
    sizes = np.array([len(t) + ORDER + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    key = x.copy()
    for j in range(1, ORDER + 1):
        key[j:] |= x[:-j] << np.uint64(BITS * j)
    real = np.ones(len(x), bool)
    for j in range(ORDER):
        real[np.cumsum(sizes) - sizes + j] = False
    return key[real], owner[real]


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (BITS * (order + 1))) - 1)


def laws(runs: DataFrame) -> DataFrame:
    """key and value, the log10 probability, of every run (key, n in the training texts, 0 or more).

    Every counted entry of the trie takes part. Tables of symbols and nodes of each order meet the
    runs in joins; those of the lowest orders, of at most 257 ** 2 rows, are broadcast.
    """
    at = lambda key, order: F.col(key).bitwiseAND(F.lit(int(_mask(order))))
    context = lambda key, order: F.shiftright(at(key, order), BITS)
    small = lambda df, holds: F.broadcast(df) if holds <= 2 else df
    symbols = {ORDER: written(runs.where("n > 0").select(F.col("key").alias("s"), F.col("n").alias("c")), "ppm-symbols")}
    for order in range(ORDER - 1, -1, -1):
        symbols[order] = written(symbols[order + 1].groupBy(at("s", order).alias("s")).agg(F.sum("c").alias("c")), "ppm-symbols")
    unseen = float(np.log(max(SYMBOLS - symbols[0].count(), 1)))
    nodes: dict[int, DataFrame] = {}
    for order in range(ORDER + 1):
        d = symbols[order]
        if order:
            below = symbols[order - 1].select(F.col("s").alias("sb"), F.col("c").alias("cb"))
            d = d.join(small(below, order), at("s", order - 1) == F.col("sb"))
        else:
            d = d.withColumn("cb", F.lit(0).cast("bigint"))
        d = d.groupBy(context("s", order).alias("x")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("cb").alias("covered"))
        all_, one = F.log(F.col("n") + F.col("d")), F.lit(0.0)
        ex, ex_escape = one, one
        if order:
            parent = nodes[order - 1].select(F.col("x").alias("xb"), F.col("n").alias("nb"), F.col("d").alias("db"))
            d = d.join(small(parent, order - 1), F.col("x").bitwiseAND(F.lit(int(_mask(order - 1)) >> BITS)) == F.col("xb"))
            rest = (F.col("db") - F.col("d")).cast("double")
            ex = F.log(F.greatest(F.col("nb") - F.col("covered") + rest, F.lit(1e-300)))
            ex_escape = F.when(rest > 0, F.log(F.greatest(rest, F.lit(1e-300))) - ex).otherwise(0.0)
        # denominator and escape here; the same one level down with exclusion
        nodes[order] = written(d.select("x", "n", "d", all_.alias("den"), (F.log("d") - all_).alias("esc"), ex.alias("ex"), ex_escape.alias("ex_esc")), "ppm-nodes")

    def with_node(df: DataFrame, order: int) -> DataFrame:
        node = nodes[order].select(F.col("x").alias(f"x{order}"), *[F.col(c).alias(f"{c}{order}") for c in ("den", "esc", "ex", "ex_esc")])
        return df.join(small(node, order), context("key", order) == F.col(f"x{order}"), "left")

    known = with_node(runs.where("n > 0"), ORDER).select("key", ((F.log("n") - F.col(f"den{ORDER}")) / LN10).alias("value"))
    other = with_node(runs.where("n = 0").select("key"), ORDER)
    null = F.lit(None).cast("double")
    given: tuple[Column, Column] = F.col(f"ex{ORDER}"), F.col(f"ex_esc{ORDER}")
    other = other.select("key", F.coalesce(F.col(f"esc{ORDER}"), F.lit(0.0)).alias("lp"), given[0].alias("gd"), given[1].alias("ge"), F.lit(False).alias("done"))
    for order in range(ORDER - 1, -1, -1):
        symbol = symbols[order].select(F.col("s").alias("s_"), F.col("c").alias("c_"))
        d = with_node(other.join(small(symbol, order + 1), at("key", order) == F.col("s_"), "left"), order)
        here = F.col(f"x{order}").isNotNull()
        den, esc = F.coalesce("gd", F.col(f"den{order}")), F.coalesce("ge", F.col(f"esc{order}"))
        step = F.when(F.col("done"), 0.0).when(F.col("c_").isNotNull(), F.log("c_") - den).when(here, esc).otherwise(0.0)
        other = d.select(
            "key", (F.col("lp") + step).alias("lp"), F.when(here, F.col(f"ex{order}")).otherwise(null).alias("gd"),
            F.when(here, F.col(f"ex_esc{order}")).otherwise(null).alias("ge"), (F.col("done") | F.col("c_").isNotNull()).alias("done"),
        )
    return known.unionByName(other.select("key", ((F.col("lp") - F.when(F.col("done"), 0.0).otherwise(unseen)) / LN10).alias("value")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(kind: int, held: bool, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        n, none = pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), none if held else n, n], ["kind", "key", "n", "uses"])

    for batch in batches:
        for held in (False, True):
            texts = batch.filter(pc.equal(batch["held_out"], held))["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(texts, 1 << 22):
                if not held:
                    words, _ = word_hashes([t.translate(LOWER) for t in texts[a:b]])
                    yield rows(0, held, *np.unique(np.append(words, np.full(b - a, END)), return_counts=True))
                yield rows(1, held, *np.unique(symbol_keys(texts[a:b])[0], return_counts=True))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = df.toArrow()
    return got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()


def _light(who: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each of ``n`` texts in turn, how often each comes, and where each text's end."""
    order = np.lexsort((keys, who))
    who, keys = who[order], keys[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(new)
    return keys[starts], np.diff(np.append(starts, len(who))), np.cumsum(np.bincount(who[starts], minlength=n))


def score_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Texts whose id has crc32 modulo 7 other than 2 train. Words and byte contexts of all of them
    are counted, and every counted entry is in the model. Words of a fixed share of all tokens and
    runs of symbols of a fixed share of all positions are broadcast; the others meet their values
    in a join, each in one row per text that has it. Words are compared by 64-bit hash.

    A null or empty text has one token, its end. Without training texts N and V are 0: all
    tokens are unknown, base_score and score use the uniform law. Repeated rows count each; a null
    id stays null (and trains as the empty id); an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(id_col, 7) == 2).alias("held_out"), text_of(text).alias("t"))
    counted = rows.select("held_out", "t").mapInArrow(_count, "kind int, key bigint, n bigint, uses bigint")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "ppm-counts")
    sizes = {r.kind: (r.v, r.n, r.uses) for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.sum("uses").alias("uses")).collect()}
    (v, n, _), positions = sizes.get(0, (0, 0, 0)), sizes.get(1, (0, 0, 0))[2]
    heavy_word, heavy_run = max(1, int(np.ceil(WORD_SHARE * n))), max(1, int(np.ceil(RUN_SHARE * positions)))
    words = counts.where("kind = 0").select("kind", "key", F.log10(F.col("n") + 1.0).alias("value"), (F.col("n") >= heavy_word).alias("heavy"))
    runs = counts.where("kind = 1").select("key", "n", (F.col("uses") >= heavy_run).alias("heavy"))
    valued = laws(runs.select("key", "n")).join(runs.select("key", "heavy"), "key")
    values = written(words.unionByName(valued.select(F.lit(1).alias("kind"), "key", "value", "heavy")), "ppm-values")
    tables = [_arrays(values.where((F.col("kind") == k) & F.col("heavy")).select("key", "value")) for k in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast([(Lookup(keys), value) for keys, value in tables])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, logs), (laws_of, law) = shared.value
        for batch in batches:
            texts = batch["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                hashes, sizes = word_hashes([t.translate(LOWER) for t in texts[a:b]])
                owner = np.append(np.repeat(np.arange(b - a), sizes), np.arange(b - a))
                hashes = np.append(hashes, np.full(b - a, END))
                row = known.find(hashes)
                hit = row >= 0
                base = np.bincount(owner[hit], weights=logs[row[hit]], minlength=b - a)
                seen = np.bincount(owner[hit], minlength=b - a)
                lists = []
                symbols, at = symbol_keys(texts[a:b])
                place = laws_of.find(symbols)
                held = place >= 0
                score = np.bincount(at[held], weights=law[place[held]], minlength=b - a)
                for who, keys in ((owner[~hit], hashes[~hit]), (at[~held], symbols[~held])):
                    keys, times, ends = _light(who, keys, b - a)
                    offsets = pa.array(np.append(0, ends).astype(np.int32))
                    lists += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (keys.view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].slice(a, b - a) for c in ("rid", "doc_id", "held_out")],
                        pa.array((sizes + 1).astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base, pa.float64()), pa.array(score, pa.float64()), *lists,
                    ],
                    ["rid", "doc_id", "held_out", "n_tokens", "seen", "base", "score", "words", "times", "runs", "run_times"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, seen bigint, base double, score double, words array<bigint>, times array<bigint>, runs array<bigint>, run_times array<bigint>"
    scored = written(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(run, schema), "ppm-scored")
    pairs = lambda kind, keys, times: scored.select("rid", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("w")).select(
        "rid", F.lit(kind).alias("kind"), "w.key", "w.times"
    )
    light = pairs(0, "words", "times").unionByName(pairs(1, "runs", "run_times"))
    found = light.join(values.where("NOT heavy").drop("heavy"), ["kind", "key"])
    is_word, product = F.col("kind") == 0, F.col("times") * F.col("value")
    found = found.groupBy("rid").agg(
        F.sum(F.when(is_word, F.col("times"))).alias("more"), F.sum(F.when(is_word, product)).alias("more_base"), F.sum(F.when(~is_word, product)).alias("more_score")
    )
    zero = F.lit(0).cast("bigint")
    return scored.select("rid", "doc_id", "held_out", "n_tokens", "seen", "base", "score").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("seen") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
