"""Hierarchical multi-length packing of tokenised documents into training sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_vocabulary
from .common import text_of

#: Context sizes of the tiers; the longest is the size that sequences are padded to.
WINDOWS = (2048, 1024, 512, 256)
#: Id that ends every document.
END = 1
#: Tokens that are packed together, and tokens of one training step.
BLOCK_TOKENS, STEP_TOKENS = 1 << 21, 1 << 17


@dataclass
class Piece:
    """``length`` ids of a document from ``start`` on, placed at ``offset`` of a sequence."""

    doc: int
    start: int
    length: int
    offset: int = 0


@dataclass
class Pool:
    """Pieces that wait for a place, by length; two bit sets say which lengths there are."""

    most: int
    by_length: dict[int, list[Piece]] = field(default_factory=dict)
    there: int = 0
    mirrored: int = 0

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.there |= 1 << piece.length
        self.mirrored |= 1 << (self.most - piece.length)

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.there &= ~(1 << length)
            self.mirrored &= ~(1 << (self.most - length))
        return piece

    def longest(self, limit: int) -> int:
        """The largest length of at most ``limit``; 0 if there is none."""
        return max((self.there & ((1 << (limit + 1)) - 1)).bit_length() - 1, 0)

    def pair(self, total: int) -> int:
        """The larger length of two pieces that fill ``total`` exactly; 0 if there are none."""
        both = self.there & (self.mirrored >> (self.most - total))
        larger = max(both.bit_length() - 1, 0)
        return 0 if 2 * larger == total and len(self.by_length[larger]) < 2 else larger

    def shortest_over(self, limit: int) -> int:
        """The smallest length above ``limit``; 0 if there is none."""
        over = self.there >> (limit + 1)
        return limit + 1 + (over & -over).bit_length() - 1 if over else 0

    def cut(self, length: int, at: int) -> Piece:
        """The first ``at`` ids of a piece of ``length``; the others stay."""
        piece = self.take(length)
        self.add(Piece(piece.doc, piece.start + at, piece.length - at))
        return Piece(piece.doc, piece.start, at)


def fill(pool: Pool, window: int, first: Piece) -> list[Piece]:
    """A window that begins with ``first``, its gap filled from the shorter tiers.

    Pieces that fill the gap exactly are taken first, one or two; then the longest that fits; a
    piece is cut only where no whole one fits. The window stays open if the pool runs out.
    """
    held, gap = [first], window - first.length
    while gap and pool.there:
        if pool.there >> gap & 1:
            piece = pool.take(gap)
        elif (larger := pool.pair(gap)) or (larger := pool.longest(gap)):
            piece = pool.take(larger)
        else:
            piece = pool.cut(pool.shortest_over(gap), gap)
        held.append(piece)
        gap -= piece.length
    return held


def pack(pool: Pool, windows: tuple[int, ...] = WINDOWS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full sequences, each with its window, and the pieces of the one window that stayed open.

    Every piece belongs to the tier of the smallest window that holds it. Tiers are packed from
    the longest down, so that a tier's gaps are filled before the shorter tiers pack their own.
    """
    full, open_ = [], []
    for at, window in enumerate(windows):
        least = windows[at + 1] if at + 1 < len(windows) else 0
        while (length := pool.longest(window)) > least:
            held = fill(pool, window, pool.take(length))
            if sum(p.length for p in held) == window:
                full.append((window, held))
            else:
                open_ = held  # the pool is empty
    return full, open_


def close(pieces: list[Piece], longest: int) -> list[tuple[int, list[Piece]]]:
    """The last pieces of a partition in sequences of falling powers of two, none of them padded."""
    out, size = [], longest
    left = sum(p.length for p in pieces)
    queue = list(reversed(pieces))
    while left:
        while size > left:
            size //= 2
        held, room = [], size
        while room:
            piece = queue.pop()
            if piece.length > room:
                queue.append(Piece(piece.doc, piece.start + room, piece.length - room))
                piece = Piece(piece.doc, piece.start, room)
            held.append(piece)
            room -= piece.length
        out.append((size, held))
        left -= size
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """A training step for every sequence.

    A step holds sequences of one window and at most ``step_tokens`` tokens. The sequences of a
    window are dealt to its steps back and forth by falling attention cost, the squared lengths of
    their pieces, so steps differ by one sequence at most and little in cost.
    """
    window = np.array([w for w, _ in sequences], np.int64)
    cost = np.array([sum(p.length**2 for p in held) for _, held in sequences], np.int64)
    step, used = np.zeros(len(sequences), np.int64), 0
    for w in sorted(set(window.tolist()), reverse=True):
        at = np.flatnonzero(window == w)
        at = at[np.argsort(-cost[at], kind="stable")]
        steps = -(-len(at) * w // max(step_tokens, w))
        round_, place = np.divmod(np.arange(len(at)), steps)
        step[at] = used + np.where(round_ % 2 == 0, place, steps - 1 - place)
        used += steps
    return step


def pack_documents(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, windows: tuple[int, ...] = WINDOWS, end: int = END, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset, window, step.

    Every document is encoded whole and followed by ``end``. Whole windows of long documents are
    sequences of their own; what is left goes to the tier of its size. A task packs its own
    documents, ``block_tokens`` at a time, and what no window could close moves on to its next
    block, so nothing is shuffled, tasks hold one block, and a lost task is redone alike. Only the
    end of a partition is left in short sequences, whose sizes are powers of two. ``windows`` are
    powers of two in falling order; sequence and step ids hold the partition in their upper bits.

    A null or empty text is a document of one token. Repeated rows and null ids are documents of
    their own; an empty table gives no rows; other columns are not read.
    """
    path = vocabulary or default_vocabulary()
    longest = windows[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = codec(path)
        base = TaskContext.get().partitionId() << 40
        sequences = steps = 0
        held: dict[int, tuple[object, np.ndarray]] = {}  # doc id and tokens of documents with waiting pieces
        left: list[Piece] = []

        def rows(full: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal sequences, steps
            step = step_groups(full)
            out: list[list] = [[] for _ in range(9)]
            for i, (window, pieces) in enumerate(full):
                offset = 0
                for p in pieces:
                    doc_id, ids = held[p.doc]
                    row = (doc_id, p.start, p.length, ids[p.start : p.start + p.length].tobytes(), len(ids), base + sequences + i, offset, window, base + steps + int(step[i]))
                    for column, value in zip(out, row):
                        column.append(value)
                    offset += p.length
            sequences += len(full)
            steps += int(step.max(initial=-1)) + 1
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

        def packed(new: dict[int, tuple[object, np.ndarray]]) -> pa.RecordBatch:
            nonlocal left
            held.update(new)
            pool, full = Pool(longest), []
            for p in left:
                pool.add(p)
            for doc, (_, ids) in new.items():
                rest = len(ids) % longest
                full += [(longest, [Piece(doc, a, longest)]) for a in range(0, len(ids) - rest, longest)]
                if rest:
                    pool.add(Piece(doc, len(ids) - rest, rest))
            more, left = pack(pool, windows)
            out = rows(full + more)
            waiting = {p.doc for p in left}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]
            return out

        new: dict[int, tuple[object, np.ndarray]] = {}
        tokens = number = 0
        for batch in batches:
            kind = batch["doc_id"].type
            texts = batch["__text"].cast(pa.binary()).to_pylist()
            for doc_id, (ids, _) in zip(batch["doc_id"].to_pylist(), c.encode(texts)):
                new[number] = (doc_id, np.append(ids, np.uint32(end)).astype("<u4"))
                tokens += len(ids) + 1
                number += 1
                if tokens >= block_tokens:
                    yield packed(new)
                    new, tokens = {}, 0
        if new:
            yield packed(new)
        if left:
            yield rows(close(left, longest))

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text).alias("__text"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step"]
    kind_sql = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(
        run, f"doc_id {kind_sql}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint, step bigint"
    )


def packing_digests(docs: DataFrame, **options) -> DataFrame:
    """``pack_documents`` with the crc32 of every piece's ids in place of the ids."""
    d = pack_documents(docs, **options)
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step")
