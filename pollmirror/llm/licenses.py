"""License scan: fixed phrases, and fuzzy search for short notices with exact seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices that are also found with errors; one edit is allowed per ``PER_EDIT`` characters, and in
#: ``EDITS`` what is said there. "cc by" by itself is too short to be told from other words with an error.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
PER_EDIT = 8
EDITS = {"apache license": 2}
#: Words are runs of these bytes after A-Z is lowered; everything else separates.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def _all_best(pattern: regex.Pattern, block: bytes, a: int, b: int) -> Iterator[regex.Match]:
    """The best match between two places, then the best ones beside it; a best match skips what stands before it."""
    parts = [(a, b)]
    while parts:
        a, b = parts.pop()
        if m := pattern.search(block, a, b):
            yield m
            parts += [(a, m.start()), (m.end(), b)]


class Scanner:
    """Phrases, the seeds of the notices and their bounded-error patterns."""

    def __init__(self) -> None:
        self.exact = [(f" {p} ".encode(), label) for p, label in BASE.items()]
        self.fuzzy = []
        for phrase, label in NOTICES.items():
            text = phrase.encode()
            edits = EDITS.get(phrase, max(1, len(text) // PER_EDIT))
            # of edits + 1 pieces, at least one is untouched in any match
            marks = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            seeds = [(text[a:b], a) for a, b in zip(marks, marks[1:])]
            pattern = regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(text), edits))
            self.fuzzy.append((text, label, edits, seeds, pattern))

    def scan(self, block: bytes) -> list[tuple[int, int, str, float, bool]]:
        """(start, end, label, similarity, exact) in a block of words that single spaces part and surround."""
        out = []
        for phrase, label in self.exact:
            at = block.find(phrase)
            while at >= 0:
                out.append((at + 1, at + len(phrase) - 1, label, 1.0, True))
                at = block.find(phrase, at + len(phrase) - 1)
        for text, label, edits, seeds, pattern in self.fuzzy:
            windows = []
            for seed, offset in seeds:
                at = block.find(seed)
                while at >= 0:
                    windows.append((max(0, at - offset - edits - 1), at - offset + len(text) + edits + 1))
                    at = block.find(seed, at + 1)
            windows.sort()
            merged: list[list[int]] = []
            for a, b in windows:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                while a < b:  # texts are searched apart, whatever stands in the next one
                    line = block.find(b"\n", a, b)
                    end = b if line < 0 else line
                    for m in _all_best(pattern, block, a, end):
                        out.append((m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(text), False))
                    a = end + 1
        return out

    def scan_texts(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, str, float, bool]]]]:
        """Per text the number of words, and (first word, words, label, similarity, exact) of every find."""
        for a, b in slices(texts):
            x = np.frombuffer(b"".join([b"\n " + t.translate(_TO_WORDS) + b" " for t in texts[a:b]]) + b"\n", np.uint8)
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
            x = x[keep]
            block = x.tobytes()
            first = np.flatnonzero((x[1:] > 0x20) & (x[:-1] == 0x20)) + 1
            ends = np.flatnonzero(x == 0x0A)
            upto = np.searchsorted(first, ends)
            finds: list[list] = [[] for _ in range(b - a)]
            for start, end, label, like, exact in self.scan(block):
                i = int(np.searchsorted(ends, start, "right")) - 1
                w = np.searchsorted(first, [start, end])
                w0 = int(np.searchsorted(first, start, "right")) - 1 if not exact else int(w[0])
                finds[i].append((w0 - int(upto[i]), int(w[1]) - w0, label, like, exact))
            for i in range(b - a):
                yield int(upto[i + 1] - upto[i]), sorted(finds[i])


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<word:bigint,n:bigint,label:string,similarity:double,base:boolean>>"


def scan_licenses(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """License phrases and notices of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.
    Base finds are the places where a phrase's words stand consecutively; the method adds
    notices with up to one edit per 8 characters (two in "apache license") that begin and end at words. ``score`` is the
    best similarity (1 - edits / length), 0 without a find. A null or empty text has no words,
    null places and empty labels. Repeated rows count each, a null id stays null, an empty table
    gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text).alias("t"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}"
    span = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("similarity", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for n, finds in scanner().scan_texts(batch["t"].cast(pa.binary()).to_pylist()):
                base = [f for f in finds if f[4]]
                row = (
                    n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({f[2] for f in base})), ",".join(sorted({f[2] for f in finds})),
                    max((f[3] for f in finds), default=0.0),
                    [dict(zip(("word", "n", "label", "similarity", "base"), f)) for f in finds],
                )
                for c, v in zip(cols, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    return rows.mapInArrow(run, schema)
