"""Document quality: a linear-chain conditional random field labels lines good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, mix64, slices, text_of

#: Expected number of labelled documents that the field is fitted on, chosen by hash of the id.
FIT_DOCS = 4000
STEPS, RATE, DECAY = 300, 0.1, 1e-3
CUT = 0.3

_KIND = np.zeros((256, 6), np.int64)  # letter, capital, digit, sentence mark, other mark, space
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)], 0] = 1
_KIND[65:91, 1] = 1
_KIND[48:58, 2] = 1
_KIND[[ord(c) for c in ".,;:'\"()-?"], 3] = 1
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"], 4] = 1
_KIND[[9, 10, 11, 12, 13, 32], 5] = 1
_POWER = mix64(np.arange(1, 257, dtype=np.uint64))
OWN = 9
FEATURES = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text.

    Own features are shares of letters, capitals, digits, sentence and other marks, word length,
    how often a word repeats the one before, whether the line is short, and whether it repeats an
    earlier line of the text; then the same of the line before and after, and a constant.
    """
    x = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.flatnonzero(x == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = (ends - starts).astype(float)
    counts = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(_KIND[x], axis=0)])
    c = (counts[ends] - counts[starts]).astype(float)
    doc_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    per = np.diff(np.searchsorted(ends, doc_end, "right"), prepend=0)
    gap = _KIND[x, 5] == 1
    first = ~gap & np.append(True, gap[:-1])
    at = np.flatnonzero(first)
    line_of = np.searchsorted(ends, at)
    # a word's hash: its bytes weighted by their place in the word, from one running sum
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(gap, 0, _POWER[x]), dtype=np.uint64)])
    word_end = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1
    word = run[word_end] - run[at]
    same = np.append(False, (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])) if len(word) else np.zeros(0, bool)
    words = np.bincount(line_of, minlength=len(ends)).astype(float)
    repeats = np.bincount(line_of, weights=same, minlength=len(ends))
    whole = run[ends] - run[starts]
    doc = np.repeat(np.arange(len(texts)), per)
    order = np.lexsort((np.arange(len(ends)), whole, doc))
    again = np.zeros(len(ends), bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    full, letters, w = np.maximum(size, 1), np.maximum(c[:, 0], 1), np.maximum(words, 1)
    own = np.stack(
        [c[:, 0] / full, c[:, 1] / letters, c[:, 2] / full, c[:, 3] / full, c[:, 4] / full, np.minimum(c[:, 0] / w, 30) / 10, repeats / w, size < 20, again], axis=1
    ).astype(float)
    edge = np.cumsum(per)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[edge - per], after[edge - 1] = own[edge - per], own[edge - 1]
    return np.hstack([own, before, after, np.ones((len(own), 1))]), size, per


@dataclass
class Field:
    """Weights of state good against bad, and of the four neighbour pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, features: np.ndarray, per: np.ndarray, want_pairs: bool = False):
        """P(good) of every line by forward-backward over each text, all texts a step at a time."""
        unary = np.stack([np.zeros(len(features)), features @ self.weights], axis=1)
        edge = np.append(0, np.cumsum(per))
        order = np.argsort(-per, kind="stable")
        starts, long = edge[:-1][order], per[order]
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[starts] = unary[starts]
        live = np.searchsorted(-long, -np.arange(1, long.max() + 1), "right") if len(long) else np.zeros(0, int)
        for t in range(1, int(long.max()) if len(long) else 0):
            i = starts[: live[t]] + t
            a = alpha[i - 1][:, :, None] + self.pairs[None]
            alpha[i] = np.logaddexp(a[:, 0], a[:, 1]) + unary[i]
        for t in range((int(long.max()) if len(long) else 0) - 2, -1, -1):
            i = starts[: live[t + 1]] + t
            b = (unary[i + 1] + beta[i + 1])[:, None, :] + self.pairs[None]
            beta[i] = np.logaddexp(b[:, :, 0], b[:, :, 1])
        both = alpha + beta
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        if not want_pairs:
            return good
        inner = np.ones(len(features), bool)
        inner[edge[:-1]] = False
        i = np.flatnonzero(inner)
        joint = alpha[i - 1][:, :, None] + self.pairs[None] + (unary[i] + beta[i])[:, None, :]
        joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(i), 4), axis=1)[:, None, None])
        return good, joint.sum(axis=0), i

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Mean of P(good) over the lines of each text, weighted by length."""
        features, size, per = line_features(texts)
        good = self.marginals(features, per)
        doc = np.repeat(np.arange(len(texts)), per)
        return np.bincount(doc, weights=good * (size + 1), minlength=len(texts)) / np.bincount(doc, weights=size + 1, minlength=len(texts))


def fit_field(labelled: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", fit_docs: int = FIT_DOCS) -> Field:
    """A field from documents with a 0/1 label, which every line of a document takes over.

    About ``fit_docs`` documents are read, chosen by hash of the id; the likelihood is maximised
    with momentum steps of fixed number. Without labels every text scores a half.
    """
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    rows = labelled.where(F.col(f"`{label}`").isin(0, 1))
    total = rows.count()
    if not total:
        return field
    keep = F.pmod(F.xxhash64(F.lit("fit"), F.col(f"`{id_col}`")), F.lit(1 << 30)) < int(min(1.0, fit_docs / total) * (1 << 30))
    rows = rows.where(keep).select(text_of(text).alias("t"), F.col(f"`{label}`").cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                features, _, per = line_features(texts[a:b])
                edge = np.append(0, np.cumsum(per))
                packed = [features[i:j].astype(np.float32).tobytes() for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch["y"].slice(a, b - a)], ["f", "y"])

    got = rows.mapInArrow(run, "f binary, y int").toArrow()
    docs = [np.frombuffer(f, np.float32).reshape(-1, FEATURES).astype(float) for f in got["f"].to_pylist()]
    if not docs:
        return field
    per, y = np.array([len(d) for d in docs]), got["y"].to_numpy()
    features, line_y = np.vstack(docs), np.repeat(y, per)
    # every document speaks with the same weight, however many lines it has
    share = np.repeat(1 / per, per) / len(docs)
    speed = [np.zeros(FEATURES), np.zeros((2, 2))]
    square = [np.zeros(FEATURES), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        good, joint, inner = field.marginals(features, per, want_pairs=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_y[inner - 1], line_y[inner]), 1)
        slopes = [features.T @ ((line_y - good) * share) - DECAY * field.weights, (seen - joint) / len(line_y) - DECAY * field.pairs]
        for value, slope, s, q in zip((field.weights, field.pairs), slopes, speed, square):
            s += 0.1 * (slope - s)
            q += 0.01 * (slope**2 - q)
            value += RATE * (s / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return field


def score_quality(docs: DataFrame, field: Field, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    A null or empty text is one empty line. Repeated rows count each, a null id stays null, an
    empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold(id_col, 5) == 0).alias("held_out"), text_of(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["t"].cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                score = field.score(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(score), pa.array((score >= CUT).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fit on the labelled rows outside the held-out fifth, score all rows."""
    marks = labels.where(fold(id_col, 5) != 0).select(F.col(f"`{id_col}`").alias("__id"), F.col("quality").alias("__quality"))
    keep = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    joined = keep.join(marks.where("__quality IS NOT NULL"), keep["doc_id"] == F.col("__id")).select("doc_id", "text", "__quality")
    return score_quality(docs, fit_field(joined, "text", "doc_id", "__quality"), text, id_col)
