"""Packing: every id once, gapless sequences, no padding, balanced steps."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from pollmirror.llm import bpe, packing

SCHEMA = "doc_id bigint, text string, length bigint, ids string, window string, __text string"


def rows(n=300, seed=5):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "gamma", "delta's", "é", "12", "\n", "the", "zzqx"]
    texts = [" ".join(rng.choice(words, int(min(rng.lognormal(4, 1.5), 9000)))) for _ in range(n)]
    fixed = [(1000, None), (1001, ""), (1002, "same text"), (1002, "same text"), (None, "no id here"), (1003, "alpha beta " * 20_000), (1004, "x" * 5000)]
    return [(i, t, 1, "a", "b", "c") for i, t in [*enumerate(texts), *fixed]]


def check(got, table, windows=packing.WINDOWS):
    t = bpe.Codec(bpe.default_vocabulary()).tokenizer
    want = defaultdict(list)
    for r in table:
        want[r[0]].append([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(r)
    assert have.keys() == want.keys()
    for doc, pieces in have.items():
        assert sum(p.length for p in pieces) == sum(map(len, want[doc]))
        if len(want[doc]) > 1:
            continue
        ids, at = want[doc][0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == held[0].window <= windows[0] and at & (at - 1) == 0  # full: a power of two, so nothing is padded
        assert len({(p.window, p.step) for p in held}) == 1
    return sequences


@pytest.mark.parametrize("partitions, block", [(1, 1 << 21), (3, 5000), (40, 1)])
def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark, partitions, block):
    table = rows()
    docs = spark.createDataFrame(table, SCHEMA).repartition(partitions)
    got = packing.packing_digests(docs, block_tokens=block).collect()
    sequences = check(got, table)
    short = [held for held in sequences.values() if held[0].window < packing.WINDOWS[-1]]
    assert len(short) <= 11 * partitions


def test_plan_is_the_same_again(spark):
    docs = spark.createDataFrame(rows(60), SCHEMA).coalesce(2)
    assert packing.packing_digests(docs).collect() == packing.packing_digests(docs).collect()


def test_empty_table_and_tables_of_one_token_documents(spark):
    assert packing.packing_digests(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    got = packing.packing_digests(spark.createDataFrame([(i, None) for i in range(13)], "doc_id bigint, text string").coalesce(1)).collect()
    assert len(got) == 13 and sorted({(r.sequence_id, r.window) for r in got}) == [(0, 8), (1, 4), (2, 1)]


def test_gaps_are_filled_with_whole_pieces_before_any_is_cut():
    pool = packing.Pool(2048)
    for i, n in enumerate([1500, 400, 148, 700, 30, 600]):
        pool.add(packing.Piece(i, 0, n))
    first = packing.fill(pool, 2048, pool.take(1500))
    assert [p.length for p in first] == [1500, 400, 148]
    second = packing.fill(pool, 1024, pool.take(700))
    assert [(p.doc, p.start, p.length) for p in second] == [(3, 0, 700), (4, 0, 30), (5, 0, 294)]
    assert pool.by_length == {306: [packing.Piece(5, 294, 306)]}


def test_pool_agrees_with_a_plain_search():
    rng = np.random.default_rng(4)
    for _ in range(300):
        lengths = rng.integers(1, 64, int(rng.integers(1, 9))).tolist()
        pool = packing.Pool(64)
        for i, n in enumerate(lengths):
            pool.add(packing.Piece(i, 0, n))
        g = int(rng.integers(1, 64))
        assert pool.longest(g) == max([n for n in lengths if n <= g], default=0)
        assert pool.shortest_over(g) == min([n for n in lengths if n > g], default=0)
        pairs = [max(a, b) for i, a in enumerate(lengths) for b in lengths[:i] if a + b == g]
        found = pool.pair(g)
        assert (found in pairs) if found else (not pairs or all(2 * x == g for x in pairs))


def test_steps_hold_one_window_and_differ_little_in_cost():
    rng = np.random.default_rng(2)
    sequences = []
    for _ in range(900):
        window = int(rng.choice(packing.WINDOWS))
        cut = int(rng.integers(1, window))
        sequences.append((window, [packing.Piece(0, 0, cut), packing.Piece(1, 0, window - cut)]))
    step = packing.step_groups(sequences, 1 << 15)
    cost, tokens, windows = defaultdict(int), defaultdict(int), defaultdict(set)
    for (w, held), s in zip(sequences, step.tolist()):
        cost[s] += sum(p.length**2 for p in held)
        tokens[s] += w
        windows[s].add(w)
    assert all(len(w) == 1 for w in windows.values()) and max(tokens.values()) <= 1 << 15
    for w in packing.WINDOWS:
        own = [s for s in cost if windows[s] == {w}]
        assert max(tokens[s] for s in own) - min(tokens[s] for s in own) <= w
        mean = [cost[s] / tokens[s] for s in own]
        assert max(mean) / min(mean) < 1.1
