"""The line field against enumeration of all labellings, and texts scored alone or among others."""

from itertools import product

import numpy as np
import pytest

from pollmirror.llm import quality

TEXTS = [b"", b"one line", b"A good line of words.\n\n!!! @@@ ###\nanother line, and more\n\x00\xff", b"\n\n\n", b"same\nsame\nsame\nother", "é ß\n12 34".encode()]


def field(seed):
    rng = np.random.default_rng(seed)
    return quality.Field(rng.normal(0, 1, quality.FEATURES), rng.normal(0, 1, (2, 2)))


def enumerate_marginals(features, f):
    """P(good) of every line and the expected pair counts, over all labellings."""
    n = len(features)
    total, good, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for labels in product((0, 1), repeat=n):
        score = sum((features[i] @ f.weights) * y for i, y in enumerate(labels)) + sum(f.pairs[a, b] for a, b in zip(labels, labels[1:]))
        w = np.exp(score)
        total += w
        good += w * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            pairs[a, b] += w
    return good / total, pairs / total


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_enumeration(seed):
    f = field(seed)
    features, _, per = quality.line_features(TEXTS)
    good, joint, _ = f.marginals(features, per, want_pairs=True)
    assert np.allclose(good, f.marginals(features, per), atol=1e-15)
    at, pairs = 0, np.zeros((2, 2))
    for n in per:
        want, own = enumerate_marginals(features[at : at + n], f)
        assert np.allclose(good[at : at + n], want, atol=1e-12)
        pairs += own
        at += n
    assert np.allclose(joint, pairs, atol=1e-12)


def test_score_is_the_length_weighted_mean_and_depends_on_the_text_alone():
    f = field(9)
    together = f.score(TEXTS)
    for t, s in zip(TEXTS, together):
        assert f.score([t])[0] == pytest.approx(s, abs=1e-12)
        features, size, per = quality.line_features([t])
        good = f.marginals(features, per)
        weight = np.array([len(line) + 1 for line in t.split(b"\n")])
        assert per.tolist() == [len(weight)] and s == pytest.approx(float((good * weight).sum() / weight.sum()), abs=1e-12)
    assert np.allclose(f.score(TEXTS[::-1])[::-1], together, atol=1e-12)
