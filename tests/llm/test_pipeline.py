"""Language scores against a plain count, and the whole pipeline against brute force on a small table."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pollmirror.llm import bpe, language_id, mixing, near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cut int, certain int, __size string, __gone string, __row string, gone string"
EN = ["the", "cat", "and", "dog", "went", "with", "town", "other", "people", "house", "over", "water", "every", "would", "through", "place", "light"]
FR = ["le", "chat", "avec", "chien", "dans", "ville", "autres", "gens", "maison", "eau", "chaque", "serait", "travers", "lieu", "lumière", "être"]


def table(n=160):
    rng = np.random.default_rng(7)
    text = lambda words, k: " ".join(rng.choice(words, k))
    rows = [(i, text(EN if i % 3 else FR, int(rng.integers(8, 60))), "en" if i % 3 else "fr", "abc"[int(rng.integers(0, 3)) % (1 + i % 3)]) for i in range(n)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "b") for i in range(12)]  # exact copies
    for i in range(20, 30):  # near copies: one word of many
        words = (rows[i][1] + " " + text(EN, 60)).split()
        rows.append((2000 + i, " ".join(words), "en", "c"))
        words[3] = "changed"
        rows.append((3000 + i, " ".join(words), "en", None))
    rows += [(4000, None, None, "a"), (4001, "", "en", "a"), (4002, "12 34 !!", "en", "a"), (4003, "qxzvvk jjwzzkq wqxjkkvz zzvvkq", "en", "a"), (4004, text(EN, 5000), "en", None)]
    return [(*r, len(r[1] or ""), 1, 2, "s", "g", "r", "x") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def model(docs):
    return language_id.fit_filters(docs)


def plain_grams(text):
    """Windows of two to four characters over letters and single spaces, with letters inside."""
    s = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    s = f" {s} " if s else " "
    return [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1] and s[i : i + n] != "  "]


def plain_key(gram):
    key = len(gram)
    for c in gram:
        key = (key * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    return int(language_id.mix64(np.array([key], np.uint64))[0])


AWKWARD = ["12", "the", "", None, "a", "..b..", "le chat", "ok", "  ", "x" * 50, "é1é", "the--cat " * 40, "İstanbul ß ſ", "123 456", "\U0001d552 b", "don't go"]


def test_ngrams_equal_a_plain_count_whatever_stands_beside():
    want = [Counter(plain_key(g) for g in plain_grams(t)) for t in AWKWARD]
    for size in (1 << 19, 64, 7, 3):
        got = [Counter() for _ in AWKWARD]
        for keys, who in language_id.ngrams(AWKWARD, size):
            for k, w in zip(keys.tolist(), who.tolist()):
                got[w][k] += 1
        assert got == want, size


def test_prediction_equals_a_plain_one_and_does_not_depend_on_neighbours(model):
    texts = AWKWARD + [r[1] for r in table()[:40]]
    lang, score = model.predict(texts)
    order = np.random.default_rng(1).permutation(len(texts))
    lang2, score2 = model.predict([texts[i] for i in order])
    assert [lang[i] for i in order] == lang2 and (score[order] == score2).all()
    mask = model.masks.shape[0] - 1
    for t, l, s in zip(texts, lang, score):
        assert ([l], s) == (model.predict([t])[0], model.predict([t])[1][0])
        keys = [plain_key(g) for g in plain_grams(t)]
        if not keys:
            assert (l, s) == ("und", 0)
            continue
        true = []
        for i, _ in enumerate(model.languages):
            bits = [all(int(model.masks[(k + j * ((k >> 40) | 1)) & mask, 0]) >> i & 1 for j in range(3)) for k in keys]
            f = model.false_rate[i]
            true.append(max((sum(bits) - len(keys) * f) / (1 - f), 0))
        best = max(range(len(true)), key=lambda i: (true[i], model.prior[i], -i))
        assert (l, round(s, 12)) == (model.languages[best], round(min(true[best] / len(keys), 1), 12))


def test_null_and_letterless_texts_are_in_no_language_in_any_place(model):
    for texts in (["12 34", "the cat"], [None, "the cat"], ["the cat", "12 34", None, "le chat"], ["!!", "??"]):
        lang, score = model.predict(texts)
        assert [(x == "und", s == 0) for x, s in zip(lang, score)] == [(t in (None, "12 34", "!!", "??"),) * 2 for t in texts]


def test_scores_are_the_same_in_any_partitioning(docs, model):
    one = sorted(language_id.predict_languages(docs.repartition(1), model).collect(), key=str)
    assert one == sorted(language_id.predict_languages(docs.repartition(13), model).collect(), key=str)


def test_clashing_columns_come_back_as_they_were(docs):
    for got in (mixing.mix(docs), near_dedup.keep_one_each(docs), language_id.keep_languages(docs, language_id.fit_filters(docs))):
        assert got.columns == docs.columns
        assert {tuple(r)[4:] for r in got.collect()} <= {tuple(r)[4:] for r in table()}
    assert len(mixing.mix_report(docs).collect()) == len(table())


def test_stages_keep_what_brute_force_keeps(spark, docs, model):
    rows = {r[0]: r for r in table()}
    grams = 0.3
    lang = {i for i, r in rows.items() if model.predict([r[1]])[0][0] != "und" and model.predict([r[1]])[1][0] >= grams}
    assert not {4000, 4001, 4002, 4003} & lang and len(lang) == len(rows) - 4  # clean texts stay
    by_text = {}
    for i in lang:
        by_text[rows[i][1]] = max(i, by_text.get(rows[i][1], -1))
    distinct = set(by_text.values())
    shingles = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i in distinct for w in [rows[i][1].lower().split()]}
    label = {i: i for i in distinct}
    ids = sorted(distinct)
    for a in ids:
        for b in ids:
            if a < b and label[a] != label[b] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    kept = {i for i in ids if label[i] == i}
    assert len(kept) < len(distinct) < len(lang)

    current, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, "")
        seen[name] = [r.doc_id for r in current.collect()]
        assert current.columns == docs.columns
    assert sorted(seen["language_id"]) == sorted(lang)
    assert sorted(seen["exact_dedup"]) == sorted(distinct)
    assert sorted(seen["near_dedup"]) == sorted(kept)
    size = {i: len(rows[i][1].split()) for i in kept}
    total, by_source = sum(size.values()), Counter()
    for i in kept:
        by_source[rows[i][3] or ""] += size[i]
    weight = dict(zip([*sorted(s for s in by_source if s), *([""] if "" in by_source else [])], [5, 2, 1, 5]))
    target, free, left = {}, dict(weight), total
    while free:  # the excess of capped sources goes to the others
        level = left / sum(free.values())
        over = [s for s in free if 3 * by_source[s] <= level * free[s]]
        if not over:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in over:
            target[s] = 3 * by_source[s]
            left -= target[s]
            del free[s]
    taken = Counter()
    for i, n in Counter(seen["mix_sources"]).items():
        assert n <= 3
        taken[rows[i][3] or ""] += n * size[i]
    assert set(seen["mix_sources"]) <= kept
    for s, t in target.items():
        longest = max(size[i] for i in kept if (rows[i][3] or "") == s)
        assert abs(taken[s] - t) <= longest
    last = corpus_pipeline.STAGES[-1][1](spark, current, "").collect()
    t = bpe.codec(bpe.default_vocabulary()).tokenizer
    for r in last:
        ids_ = t.encode(rows[r.doc_id][1], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids_), hashlib.sha256(np.array(ids_, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()
    assert sorted(r.doc_id for r in last) == sorted(seen["mix_sources"])


def test_run_reads_the_documents_of_a_folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
