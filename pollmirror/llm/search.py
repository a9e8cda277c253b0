"""Ranked search of many items at once, with the terms that items share added up once.

Terms that stand in exactly the same items are one leaf. Leaves and nodes that several items
hold together are merged to nodes of a graph that all items share. Per document the leaves'
accumulators are filled from its postings, every node is the sum of its two parts, computed
once, and an item's score is the sum of the few nodes that it is made of.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents that are returned for an item.
TOP = 10
#: Items, and pairs of an item and a term, that are ranked in one pass over the documents (about; dealt by hash).
BLOCK_ITEMS, BLOCK_PAIRS = 4096, 500_000
#: Cells of the accumulator table that a task holds, and groups that partitions' lists meet in first.
CELLS, SALTS = 1 << 22, 32
#: Terms are runs of these bytes after A-Z is lowered; everything else separates.
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text in order."""
    return text.translate(_TO_TERMS).split()


@dataclass
class Sharing:
    """How the items of a block are made of shared parts.

    ``leaf`` numbers the leaf of every term; nodes follow the leaves, each the sum of the two
    earlier ones in ``parts``; ``made_of`` lists for every item the leaves and nodes that make it up.
    """

    leaf: dict[bytes, int]
    leaves: int
    parts: list[tuple[int, int]]
    items: list[int]
    made_of: list[list[int]]


def share(terms: dict[int, set[bytes]]) -> Sharing:
    """Leaves and shared nodes of items given by their terms.

    An item's parts are put in order by the number of items that hold them, the commonest first,
    so that shared sets stand together. Neighbours that two or more items hold become a node, the
    commonest first; this goes on until no two items share neighbours. A round costs the sum of the items'
    lengths, and every round shortens them.
    """
    items = sorted(terms)
    holders: dict[bytes, list[int]] = defaultdict(list)
    for i, item in enumerate(items):
        for term in terms[item]:
            holders[term].append(i)
    sets = {tuple(held): 0 for held in holders.values()}
    order = sorted(sets, key=lambda held: (-len(held), held))
    number = {held: n for n, held in enumerate(order)}
    made_of: list[list[int]] = [[] for _ in items]
    for n, held in enumerate(order):
        for i in held:
            made_of[i].append(n)
    parts: list[tuple[int, int]] = []
    while True:
        met = Counter(pair for made in made_of for pair in pairwise(made))
        # a part lies in one merged pair a round, so that rounds do not undo each other
        chosen: dict[tuple[int, int], int] = {}
        first, second = set(), set()
        for pair, n in sorted(met.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            if not {pair[0], pair[1]} & (first | second):
                chosen[pair] = len(order) + len(parts)
                parts.append(pair)
                first.add(pair[0])
                second.add(pair[1])
        if not chosen:
            break
        for i, made in enumerate(made_of):
            out, at = [], 0
            while at < len(made):
                node = chosen.get((made[at], made[at + 1])) if at + 1 < len(made) else None
                out.append(made[at] if node is None else node)
                at += 1 if node is None else 2
            made_of[i] = out
    return Sharing({t: number[tuple(held)] for t, held in holders.items()}, len(order), parts, items, made_of)


def accumulate(sharing: Sharing, leaf: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Scores, items by documents, from postings (leaf, document, value)."""
    cells = np.zeros((sharing.leaves + len(sharing.parts), docs), np.int64)
    np.add.at(cells, (leaf, doc), value)
    for n, (a, b) in enumerate(sharing.parts, sharing.leaves):
        np.add(cells[a], cells[b], out=cells[n])
    return np.stack([cells[made].sum(axis=0) for made in sharing.made_of]) if sharing.items else cells[:0]


def _item_terms(items: DataFrame, text: str, id_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t or b""))) for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("item_id IS NOT NULL")
    return rows.mapInArrow(run, "item_id bigint, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()


def _postings(docs: DataFrame, text: str, id_col: str, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms of the document), and number and occurrences of the wanted ones, for documents with a term."""
    wanted = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = wanted.value
        known = number.keys()
        for batch in batches:
            n, at, tf = [], [], []
            for t in batch["text"].cast(pa.binary()).to_pylist():
                words = terms_of(t or b"")
                counts = Counter(words)
                here = known & counts.keys()
                n.append(len(words))
                at.append([number[w] for w in here])
                tf.append([counts[w] for w in here])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tf"]
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tf array<bigint>").where("n > 0")


class _Best:
    """The best documents of every item so far: highest score first, equal scores by id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score, self.doc = ([np.zeros(0, np.int64)] * items for _ in range(2))
        self.none = [np.zeros(0, bool)] * items
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)):
            at = np.flatnonzero(scores[i] >= self.least[i])
            s, d, e = (np.concatenate(x) for x in ((self.score[i], scores[i, at]), (self.doc[i], doc[at]), (self.none[i], none[at])))
            order = np.lexsort((d, e, -s))[: self.top]
            self.score[i], self.doc[i], self.none[i] = s[order], d[order], e[order]
            if len(order) == self.top:
                self.least[i] = self.score[i][-1]


def _rank_block(docs: DataFrame, text: str, id_col: str, terms: dict[int, set[bytes]], top: int) -> DataFrame:
    spark = docs.sparkSession
    sharing = share(terms)
    words = sorted(sharing.leaf)
    postings = written(_postings(docs, text, id_col, words), "search-postings")
    total = postings.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    all_docs, all_terms = int(total.docs), int(total.terms or 1)
    df = np.zeros(len(words), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's terms
        df[r.t] = r.df
    weight = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    leaf = np.array([sharing.leaf[w] for w in words], np.int64)
    shared = spark.sparkContext.broadcast((sharing, leaf, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, leaf, weight = shared.value
        best = _Best(len(sharing.items), top)
        step = max(1, CELLS // max(1, sharing.leaves + len(sharing.parts)))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                n = some["n"].to_pylist()
                m = np.array([10 + 90 * x * all_docs // all_terms for x in n], np.int64)
                term = some["terms"].flatten().to_numpy()
                tf = some["tf"].flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), some["terms"].value_lengths().to_numpy())
                value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                none = some["doc_id"].is_null().to_numpy(zero_copy_only=False)
                best.add(accumulate(sharing, leaf[term], doc, value, len(n)), some["doc_id"].fill_null(0).to_numpy(), none)
        sizes = [len(s) for s in best.score]
        if sum(sizes):
            ids = pa.array(np.concatenate(best.doc), mask=np.concatenate(best.none))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(sharing.items, sizes), pa.int64()), ids, pa.array(np.concatenate(best.score))], ["item_id", "doc_id", "score"])

    lists = postings.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint").withColumn("salt", F.spark_partition_id() % SALTS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for every item its ``top`` documents of highest score above 0.

    A term of weight w = floor(1000 ln((2N+2)/(2df+1))) that stands tf times in a document adds
    w * ((10^9 tf) div (1000 tf + 8m)), m = 10 + (90nN) div L, once for each item that has it. Items
    are ranked in blocks of bounded size, dealt by hash; a block's terms and its sharing graph are
    what is broadcast, and each block is one pass over the documents. A task keeps ``top``
    documents of each item.

    Null and empty texts have no terms: such a document is in no list and not counted, such an
    item has no rows. An item with a null id has no rows; rows of one item id are one item with
    the terms of all. Repeated documents are ranked each; equal scores go by id, null ids last.
    Empty tables give no rows, other columns are not read.
    """
    spark = docs.sparkSession
    pairs = written(_item_terms(items, item_text, item_col), "search-items")
    size = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("item_id").alias("items")).first()
    blocks = max(-(-size["items"] // BLOCK_ITEMS), -(-size["pairs"] // BLOCK_PAIRS))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        terms: dict[int, set[bytes]] = defaultdict(set)
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():  # one block, of bounded size
            terms[r.item_id].add(bytes(r.term))
        if terms:
            out = out.unionByName(_rank_block(docs, text, id_col, dict(terms), top))
    return out


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS words FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM rows WHERE len(words) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
wanted AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS term FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL)),
tfs AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM rows) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), total),
added AS (SELECT r, term, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS v FROM tfs JOIN docs USING (r) JOIN weights USING (term), total),
scores AS (SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM wanted JOIN added USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= {TOP}
"""
