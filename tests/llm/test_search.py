"""Ranked search against brute force; sharing among items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pollmirror.llm import search

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n bigint, terms string, tf string, rank int, score bigint, item_id bigint"
ITEMS = "item_id bigint, text string, term string, pairs int, salt int"


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in set(b))
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        found = []
        for d, b in bags:
            tf, m = Counter(b), 10 + 90 * len(b) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in ws if tf[w])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def tables(seed=3, n=400):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(80)] + ["Élan", "éLAN", "x²", "don't", "A_B", "ÀB", "İ", "日本"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda k: " ".join(rng.choice(words, int(k), p=p / p.sum()))
    docs = [(i, text(rng.integers(1, 60))) for i in range(n)]
    docs += [(i + 1000, docs[7][1]) for i in range(15)] + [(5, docs[5][1]), (5, docs[5][1]), (None, docs[3][1]), (2000, None), (2001, ""), (2002, "!! --"), (2003, text(30_000))]
    items = [(i, text(rng.integers(1, 25))) for i in range(60)]
    items += [(100, docs[7][1]), (101, None), (102, ""), (103, "nowhere to be found"), (104, "w1 w2"), (104, "w3 w2"), (105, "w1 w2"), (None, "w1")]
    return docs, items


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    docs, items = tables()
    monkeypatch.setattr(search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(search, "CELLS", 2000)
    d = spark.createDataFrame([(i, t, 1, "a", "b", 2, 3, 4) for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], ITEMS)
    got = search.rank_documents(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in (DOCS, ITEMS))
    one_doc = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    one_item = spark.createDataFrame([(1, "b c")], "item_id bigint, text string")
    assert search.rank_documents(docs, items).collect() == search.rank_documents(one_doc, items).collect() == search.rank_documents(docs, one_item).collect() == []
    assert [tuple(r) for r in search.rank_documents(one_doc, one_item).collect()] == brute([(1, "a b")], [(1, "b c")])


def test_shared_sets_are_added_up_once():
    rng = np.random.default_rng(8)
    common = [f"c{i}".encode() for i in range(30)]
    items = {i: set(rng.choice(common, 20, replace=False)) | {f"own{i}-{j}".encode() for j in range(3)} for i in range(50)}
    s = search.share(items)
    spelled = [{t for t, n in s.leaf.items() if n == leaf} for leaf in range(s.leaves)]
    for a, b in s.parts:
        assert not spelled[a] & spelled[b]
        spelled.append(spelled[a] | spelled[b])
    holders = Counter()
    for item, made in zip(s.items, s.made_of):
        assert set().union(*[spelled[m] for m in made]) == items[item] and sum(len(spelled[m]) for m in made) == len(items[item])
        parts = set(made)
        for n in range(len(s.parts) - 1, -1, -1):
            if s.leaves + n in parts:
                parts |= set(s.parts[n])
        holders.update(parts)
    assert all(holders[s.leaves + n] >= 2 for n in range(len(s.parts)))  # every node is shared
    assert sum(map(len, s.made_of)) + len(s.parts) < 0.6 * sum(map(len, items.values()))
    leaf, doc, value = rng.integers(0, s.leaves, 500), rng.integers(0, 20, 500), rng.integers(0, 10**12, 500)
    got = search.accumulate(s, leaf, doc, value, 20)
    plain = np.zeros((s.leaves, 20), np.int64)
    np.add.at(plain, (leaf, doc), value)
    for row, item in zip(got, s.items):
        own = sorted({s.leaf[t] for t in items[item]})
        assert (row == plain[own].sum(axis=0)).all()


def test_no_items_share_nothing():
    s = search.share({})
    assert (s.leaves, s.parts, s.items) == (0, [], []) and search.share({4: {b"a", b"b"}}).parts == []
