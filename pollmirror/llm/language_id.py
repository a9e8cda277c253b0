"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, fold, mix64, written

ORDERS = (2, 3, 4)
#: Expected number of labelled texts per language that the filters are learned from (the fit is on a sample).
FIT_DOCS = 1000
#: An n-gram belongs to a language if at least this many of its texts have it, and if it is at least so
#: frequent against the language where it is most frequent.
MIN_COUNT, MIN_SHARE = 3, 0.1
HASHES = 3
#: Slots per n-gram of the language that has most; a filter has 2^16 to 2^22 slots.
SLOTS_EACH, LEAST_BITS, MOST_BITS = 12, 16, 22
#: A text is in no learned language if fewer of its n-grams than this share are known to one.
MIN_SCORE = 0.3
UND = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _block(text: str, owner: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters with every run of non-letters of one text as one space, their texts, and which are new."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, np.uint32(32))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (owner[1:] != owner[:-1])
    return codes[keep], owner[keep], fresh[keep]


def _blocks(texts: list[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole texts, each with a space on either side; a text longer than ``size`` comes in pieces.

    A piece begins with the last characters of the one before it, which are not new there, so that
    n-grams across the cut are seen once.
    """
    buf: list[str] = []
    owner: list[int] = []
    total = 0

    def flush():
        who = np.repeat(np.array(owner), [len(p) + 2 for p in buf])
        return _block("".join(f" {p} " for p in buf), who, np.ones(len(who), bool))

    for i, t in enumerate(texts):
        t = (t or "").lower()
        if len(t) > size:
            held = " "
            for a in range(0, len(t), size):
                piece = held + t[a : a + size] + (" " if a + size >= len(t) else "")
                block = _block(piece, np.full(len(piece), i), np.arange(len(piece)) >= len(held))
                yield block
                held = block[0][-max(ORDERS) + 1 :].tobytes().decode("utf-32-le", "surrogatepass")
            continue
        buf.append(t)
        owner.append(i)
        total += len(t)
        if total >= size:
            yield flush()
            buf, owner, total = [], [], 0
    if buf:
        yield flush()


def ngrams(texts: list[str | None], size: int = BLOCK // 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit keys of the n-grams of all orders, and the index of the text each is from.

    N-grams run over one word and the spaces round it, so each has a letter and at most an
    outer space on each side. Those of a text do not depend on the texts beside it.
    """
    for codes, who, fresh in _blocks(texts, size):
        x = codes.astype(np.uint64)
        space = codes == 32
        for n in ORDERS:
            m = len(x) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n, np.uint64)
            good = (who[:m] == who[n - 1 :]) & fresh[n - 1 :]
            if n == 2:
                good &= ~(space[:m] & space[1:])
            for j in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + x[j : m + j]
                if 0 < j < n - 1:
                    good &= ~space[j : m + j]
            yield mix64(key[good]), who[:m][good]


@dataclass
class Filters:
    """``masks[slot]`` has bit l set where language l's filter has the slot; one read gives all languages."""

    languages: list[str]
    prior: list[int]
    masks: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray

    def slots(self, keys: np.ndarray) -> list[np.ndarray]:
        step = (keys >> np.uint64(40)) | np.uint64(1)
        mask = np.uint64(self.masks.shape[0] - 1)
        return [((keys + np.uint64(i) * step) & mask).astype(np.int64) for i in range(HASHES)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n_lang = len(self.languages)
        if not n_lang:
            return [UND] * len(texts), np.zeros(len(texts))
        hits, seen = np.zeros((len(texts), n_lang)), np.zeros(len(texts))
        for keys, who in ngrams(texts):
            found = [self.masks[s] for s in self.slots(keys)]
            found = found[0] & found[1] & found[2]
            seen += np.bincount(who, minlength=len(texts))
            for lang in range(n_lang):
                has = (found[:, lang // 64] >> np.uint64(lang % 64)) & np.uint64(1)
                hits[:, lang] += np.bincount(who, weights=has, minlength=len(texts))
        # of n n-grams, h hits are expected from t true ones and a share f of the others: h = t + f (n - t)
        true = np.clip((hits - seen[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
        rank = np.array(self.prior)
        best = np.lexsort((np.broadcast_to(-rank, true.shape), -true), axis=1)[:, 0]
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(seen, 1), 0, 1)
        return [self.languages[b] if s else UND for b, s in zip(best, seen)], np.where(seen > 0, score, 0)


def fit_filters(labelled: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> Filters:
    """Filters from rows with a text and a language; Spark counts n-grams and builds the slots.

    About ``fit_docs`` rows per language, chosen by hash of the id, are read, so the number of
    n-grams is bounded. The slots follow it: at most 32 MB per 64 languages.
    """
    rows = labelled.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.lit("fit"), F.col(f"`{id_col}`")).alias("h")
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], [], np.zeros((1 << LEAST_BITS, 1), np.uint64), np.zeros(0))
    cut = F.lit(False)
    for name in languages:
        cut = cut | ((F.col("lang") == name) & (F.pmod("h", F.lit(1 << 30)) < int(min(1.0, fit_docs / sizes[name]) * (1 << 30))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_of = np.array([languages.index(x) for x in batch["lang"].to_pylist()])
            # once per text, so that no long text speaks for its language alone
            found = [[keys for keys, _ in ngrams([t])] for t in batch["text"].to_pylist()]
            grams = [np.unique(np.concatenate([np.zeros(0, np.uint64), *f])) for f in found]
            lang_no = np.repeat(lang_of, [len(g) for g in grams]).astype(np.int32)
            keys = np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lang_no), pa.array(keys), pa.array(np.ones(len(keys), np.int64))], ["lang", "gram", "n"])

    counts = rows.where(cut).select("lang", "text").mapInArrow(count, "lang int, gram bigint, n bigint")
    totals = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    by_lang = totals.groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("found"))  # at most one entry per language
    weight = {r.lang: r.n for r in totals.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    all_n = F.array(*[F.lit(float(weight.get(i, 1))) for i in range(len(languages))])
    share = F.transform("found", lambda x: F.struct(x["lang"].alias("lang"), x["n"].alias("n"), (x["n"] / F.element_at(all_n, x["lang"] + 1)).alias("share")))
    members = (
        by_lang.select("gram", share.alias("found")).withColumn("most", F.array_max(F.transform("found", lambda x: x["share"])))
        .select("gram", "most", F.explode("found").alias("f"))
        .where((F.col("f.n") >= MIN_COUNT) & (F.col("f.share") >= MIN_SHARE * F.col("most")))
        .select("gram", F.col("f.lang").alias("lang"))
    )
    members = written(members, "language-members")
    largest = members.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits = min(max(int(np.ceil(np.log2(max(largest * SLOTS_EACH, 1)))), LEAST_BITS), MOST_BITS)
    words = (len(languages) + 63) // 64
    model = Filters(languages, [sizes[x] for x in languages], np.zeros((1 << bits, words), np.uint64), np.zeros(len(languages)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang_no = batch["lang"].to_numpy()
            for s in model.slots(batch["gram"].to_numpy().view(np.uint64)):
                bit = np.uint64(1) << (lang_no % 64).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((lang_no // 64).astype(np.int32)), pa.array(bit.view(np.int64))], ["slot", "word", "mask"])

    placed = members.mapInArrow(place, "slot bigint, word int, mask bigint").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    found = placed.toArrow()  # at most one row per slot and 64 languages
    model.masks[found["slot"].to_numpy(), found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    for i in range(len(languages)):
        fill = float(((model.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean())
        model.false_rate[i] = min(fill**HASHES, 0.99)
    return model


def predict_languages(docs: DataFrame, model: Filters, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    Each language scores the share of the text's n-grams that its filter holds, less the false
    positives expected from its fill; the largest decides, ties go to the language with more
    labelled rows, then the first by name. A null text, one without letters, or an empty model
    gives ``und`` and 0. Repeated rows count each; a null id stays null; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(id_col, 5) == 0).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                lang, score = m.predict(b["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Fit on the rows outside the held-out fifth, predict for all rows."""
    return predict_languages(docs, fit_filters(docs.where(fold(id_col, 5) != 0), text, lang, id_col), text, id_col)


def keep_languages(docs: DataFrame, model: Filters, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns.

    Rejected are null texts, texts without a letter, and texts of which fewer than ``MIN_SCORE`` of
    the n-grams are known to the language predicted. Repeated rows are judged each, very long texts
    whole; no column is added, so none can clash; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                lang, score = shared.value.predict(b.column(at).to_pylist())
                yield b.filter(pa.array([x != UND and s >= MIN_SCORE for x, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
