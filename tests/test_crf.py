"""The conditional random field against enumeration of all paths, numeric gradients, and a case that needs its moves."""

import random
from itertools import product

import numpy as np
import pytest

from spanspark.operators import bio, crf, evaluate

B, I, O = "B-MATH", "I-MATH", "O"  # noqa: E741


def random_case(rng):
    lengths = rng.integers(1, 5, 6)
    n = int(lengths.sum())
    return rng.normal(size=(7, 3)), rng.normal(size=(4, 3)), rng.integers(0, 7, (n, 2)), rng.integers(0, 3, n), lengths


def test_loss_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(5):
        w, m, a, t, lengths = random_case(rng)
        at, loss = 0, 0.0
        for n in lengths:
            own = w[a[at : at + n]].sum(axis=1)
            score = lambda p: m[3, p[0]] + own[0, p[0]] + sum(m[x, y] + own[k + 1, y] for k, (x, y) in enumerate(zip(p, p[1:], strict=False)))  # noqa: E731, B023
            loss += np.log(sum(np.exp(score(p)) for p in product(range(3), repeat=int(n)))) - score(t[at : at + n].tolist())
            at += n
        assert crf.loss_and_gradient(w, m, a, t, lengths)[0] == pytest.approx(loss)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    w, m, a, t, lengths = random_case(rng)
    _, by_weight, by_move = crf.loss_and_gradient(w, m, a, t, lengths)
    for x, slope in ((w, by_weight), (m, by_move)):
        for k in np.ndindex(x.shape):
            keep, x[k] = x[k], x[k] + 1e-6
            more = crf.loss_and_gradient(w, m, a, t, lengths)[0]
            x[k] = keep - 1e-6
            less = crf.loss_and_gradient(w, m, a, t, lengths)[0]
            x[k] = keep
            assert (more - less) / 2e-6 == pytest.approx(slope[k], abs=1e-4)


def test_penalty_sets_weights_to_zero():
    """min (x - c)^2 / 2 + l1 |x| shrinks each c towards 0 by l1."""
    c = np.array([3.0, -2.0, 0.5, -0.2, 0.0])
    found = crf.minimised(lambda x: (float(((x - c) ** 2).sum() / 2), x - c), np.zeros(5), 1.0, 50, tolerance=1e-12)
    assert found.tolist() == pytest.approx([2.0, -1.0, 0.0, 0.0, 0.0], abs=1e-6)


def test_moves_tell_what_words_do_not(spark, monkeypatch):
    """The words of a span are all alike, so only the moves tell its begin; chunks of few sentences change nothing."""
    rng = random.Random(4)
    rows = []
    for s in range(120):
        tags = []
        for _ in range(rng.randint(1, 4)):
            tags += [O] * rng.randint(1, 3) + [B] + [I] * rng.randint(0, 3)
        rows += [(s, i, "x" if t != O else rng.choice(["and", "so", "then"]), t) for i, t in enumerate(tags)]
    x = spark.createDataFrame(rows, "sid bigint, i int, w string, tag string").repartition(3)
    train, test = x.where("sid % 3 <> 0"), x.where("sid % 3 = 0")
    monkeypatch.setattr(crf, "CHUNK_PLACES", 100)
    model = crf.fit(train, ("w",), buckets=64, iterations=30)
    found = crf.decode(model, test)
    assert found.count() == test.count()
    assert evaluate.span_scores(test, found).first().f1 == 1.0
    assert found.join(bio.violations(found), ["sid", "i"], "left_semi").isEmpty()
