"""License scan: base places against the pattern, fuzzy finds against a plain edit distance."""

import re

import numpy as np
import pytest

from pollmirror.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    w = words(text)
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def fuzzy(text):
    """Labels of notices that some run of whole words comes near enough to."""
    w, found = [x.encode().decode("latin-1") for x in words(text)], set()
    for phrase, label in licenses.NOTICES.items():
        edits = licenses.EDITS.get(phrase, max(1, len(phrase) // licenses.PER_EDIT))
        k = len(phrase.split())
        for n in range(max(1, k - edits), k + edits + 1):
            for i in range(len(w) - n + 1):
                run = " ".join(w[i : i + n])
                if abs(len(run) - len(phrase)) <= edits and distance(phrase, run) <= edits:
                    found.add(label)
    return found


def texts(n=150):
    rng = np.random.default_rng(6)
    parts = [*licenses.BASE, *licenses.NOTICES, "the", "MIT", "license", "Licence", "cc", "BY", "of", "é", "12", "apache", "and\n", "--", "gnu general"]
    out = []
    for _ in range(n):
        t = list(" ".join(rng.choice(parts, int(rng.integers(1, 7)))))
        for _ in range(int(rng.integers(0, 4))):  # errors
            at = int(rng.integers(0, len(t)))
            t[at : at + int(rng.integers(0, 2))] = "abc é"[int(rng.integers(0, 5))]
        out.append("".join(t))
    return [*out, "MIT Licence", "Apache Lisence 2.0", "under the Apache Licence", "emit a license", "", None, "CC-BY 4.0", "mit license " * 300]


def test_finds_equal_a_plain_search(spark):
    table = list(enumerate(texts()))
    d = spark.createDataFrame(table, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert len(got) == len(table)
    for i, t in table:
        r = got[i]
        n, places = base(t)
        assert (r.n_words, r.n_base) == (n, len(places)), t
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None)), t
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        labels = set(r.labels.split(",")) - {""}
        if len(t or "") < 200:
            assert labels == fuzzy(t) | {label for _, label in places}, t
        assert sorted((s.word, s.label) for s in r.spans if s.base) == places and (r.score == 1.0) == any(s.similarity == 1.0 for s in r.spans)


@pytest.mark.parametrize("text, label", [("MIT Licence", "mit"), ("Apache Lisence 2.0", "apache"), ("under the Apache Licence", "apache")])
def test_misspelt_base_phrases_are_found(text, label):
    (n, finds), = licenses.scanner().scan_texts([text.encode()])
    assert label in {f[2] for f in finds} and not any(f[4] for f in finds)
