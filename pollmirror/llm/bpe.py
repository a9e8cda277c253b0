"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two bytes that stand side by side in no vocabulary token are never merged, so between them is
a certain cut. Fragments between cuts are encoded independently and their ids concatenated.
Fragments are told apart by a hash, each distinct one is encoded once, and the ids of a block
are put together by array look-ups; what they spell is compared with the block's own bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, text_of

#: Distinct fragments that a worker remembers; beyond, the half that was met most often stays.
CACHE = 600_000
#: Bytes that are split at once, and bytes of new fragments that one call of the encoder gets.
BLOCK, CALL = 2 << 20, 1 << 15
_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The visible characters by which byte-level vocabularies write the 256 bytes.

    Visible Latin-1 characters stand for themselves; the others follow from U+0100 on.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Codec:
    """One vocabulary: its forced cuts, its encoder for fragments and its token bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_symbols()
        self.bytes: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.bytes |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        inside = np.zeros((256, 256), bool)
        for token in self.bytes.values():
            row = np.frombuffer(token, np.uint8)
            inside[row[:-1], row[1:]] = True
        # A cut must also leave the splitting into words as it is. That looks ahead of white
        # space only, and at fragment starts only an apostrophe can be read differently; so cuts
        # follow a character that is no white space and precede neither an apostrophe nor the
        # rest of a character.
        self.cuts = ~inside
        self.cuts[:0x21] = self.cuts[0x7F] = False
        self.cuts[:, 0x27] = False
        self.cuts[:, 0x80:0xC0] = False
        # spelling table: the bytes of every id, one after another
        spelled = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        # a byte that is merged with nothing parts the fragments of one call
        alone = {b[0]: i for i, b in self.bytes.items() if len(b) == 1}
        free = not (inside[0].any() or inside[:, 0].any())
        self.parting = alone.get(0) if free else None
        # what is known: sorted fragment keys, and for each the place and number of its ids
        self.keys = np.zeros(0, np.uint64)
        self.where, self.count, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def fragments(self, block: bytes) -> np.ndarray:
        """Offsets at which the bytes are certainly cut."""
        x = np.frombuffer(block, np.uint8)
        at = np.flatnonzero(self.cuts[x[:-1], x[1:]])
        # behind a character of several bytes: its first byte says that it is no white space
        last = x[at]
        two = x[np.maximum(at - 1, 0)]
        three = x[np.maximum(at - 2, 0)]
        solid = (last < 0x80) | ((two >= 0xC3) & (two < 0xE0)) | ((two & 0xC0 == 0x80) & (three >= 0xE4) & (three < 0xF0))
        return at[solid] + 1

    def _encode_new(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of fragments one after another, and for each fragment their place and number.

        Many go to the encoder at a time, parted by a byte that is merged with nothing.
        """
        encode = lambda texts: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # white space at the end looks ahead, an apostrophe in front looks back
        apart = [self.parting is None or 0 in p or p[0] == 0x27 or not 0x21 <= p[-1] < 0x7F for p in parts]
        single, order, made, counts = [i for i, x in enumerate(apart) if x], [], [], []
        together = [i for i, x in enumerate(apart) if not x]
        for a, b in slices([parts[i] for i in together], CALL):
            ids = encode([b"\0".join([parts[i] for i in together[a:b]]).decode()])[0]
            parting = ids == self.parting
            ends = np.flatnonzero(parting)
            if len(ends) != b - a - 1:
                single += together[a:b]
                continue
            order += together[a:b]
            made.append(ids[~parting])
            counts.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
        for a in range(0, len(single), 4096):
            some = encode([parts[i].decode() for i in single[a : a + 4096]])
            order += single[a : a + 4096]
            made += some
            counts.append(np.array([len(x) for x in some], np.int64))
        n = np.concatenate(counts)
        where, count = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        where[order], count[order] = np.cumsum(n) - n, n
        return np.concatenate(made), where, count

    def _forget(self) -> None:
        """Of too many fragments the half that was met most often stays, with its counts halved."""
        if len(self.keys) <= CACHE:
            return
        stay = np.sort(np.argpartition(-self.used, CACHE // 2)[: CACHE // 2])
        ids = self.ids[runs(self.where[stay], self.count[stay])]
        self.keys, self.count, self.used = self.keys[stay], self.count[stay], self.used[stay] // 2
        self.where, self.ids = np.cumsum(self.count) - self.count, ids

    def _encode_block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        block = b"".join(texts)
        x = np.frombuffer(block, np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        first = np.zeros(len(x) + 1, bool)
        first[self.fragments(block)] = True
        first[ends - sizes] = True
        starts = np.flatnonzero(first[:-1])
        lengths = np.diff(starts, append=len(x))
        powers = np.cumprod(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
        place = np.arange(len(x)) - np.repeat(starts, lengths)
        keys = np.add.reduceat(_KEY[x] * powers[place], starts)
        keys = mix64(keys ^ (lengths.astype(np.uint64) << np.uint64(40)))
        distinct, example, which, met = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inner = at < len(self.keys)
        new[inner] = self.keys[at[inner]] != distinct[inner]
        if new.any():
            a, n = starts[example[new]], lengths[example[new]]
            made, where, count = self._encode_new([block[i : i + j] for i, j in zip(a.tolist(), n.tolist())])
            where += len(self.ids)
            self.ids = np.concatenate([self.ids, made])
            into = at[new]
            self.keys, self.where, self.count = (np.insert(old, into, add) for old, add in ((self.keys, distinct[new]), (self.where, where), (self.count, count)))
            self.used = np.insert(self.used, into, 0)
            at = np.searchsorted(self.keys, distinct)
        self.used[at] += met
        entry = at[which]
        count = self.count[entry]
        ids = self.ids[runs(self.where[entry], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(starts, np.concatenate([[0], ends]))
        self._forget()
        return ids, np.diff(total[edge])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another; an unknown id has none."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.lengths))]
        return self.spelled[runs(self.offsets[ids], self.lengths[ids])]

    def encode(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Per text its ids, and the bytes that these ids spell."""
        for a, b in slices(texts, BLOCK):
            some = texts[a:b]
            if not any(some):
                yield from [(np.zeros(0, np.uint32), b"")] * len(some)
                continue
            ids, counts = self._encode_block(some)
            spelled = self.spell(ids).tobytes()
            same = spelled == b"".join(some)
            i = 0
            for text, n in zip(some, counts.tolist()):
                own = ids[i : i + n]
                i += n
                if same:
                    yield own, text
                    continue
                # two fragments of one key, or a vocabulary that does not spell every byte
                back = self.spell(own).tobytes()
                if back != text:
                    own = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                    back = self.spell(own).tobytes()
                yield own, back

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.spell(np.array(list(ids), np.int64)).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, once per worker process."""
    return Codec(path)


def bpe_encode(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    A null text counts as empty and has no ids. Repeated rows are encoded each, a null id stays
    null, an empty table gives no rows, other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x, _ in c.encode(batch["__text"].cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, ids: str = "ids", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every id list; null or empty ids give the empty text, unknown ids nothing."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(x or ()) for x in batch["__ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids}`").alias("__ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``bpe_encode`` and ``bpe_decode`` in one pass, as digests."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for own, back in c.encode(batch["__text"].cast(pa.binary()).to_pylist()):
                n.append(len(own))
                ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text).alias("__text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
