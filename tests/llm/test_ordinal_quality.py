import random

import numpy as np
import pytest

from hopscope.llm import ordinal_quality as oq


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for k in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        w = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if grade == 1:
            w = [x.upper() + "!!" for x in w]
        if grade == 0:
            w[rng.randrange(len(w))] = rng.choice(["dunce,", "Oaf"])
        out.append((k, " ".join(w), grade))
    return out


def test_held_out_accuracy_and_order(spark):
    rows = texts(1500, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(4)
    ratings = spark.createDataFrame([(k, g) for k, _, g in rows if k < 1000], "doc_id long, grade int")
    model = oq.train(docs, ratings, top=2)
    assert np.all(np.diff(model.thresholds) > 0)
    again = oq.train(docs.repartition(2), ratings, top=2)
    assert np.array_equal(again.weights, model.weights)
    got = {r.doc_id: r for r in oq.score(docs, model).collect()}
    held = [(k, g) for k, _, g in rows if k >= 1000]
    assert np.mean([got[k].kept == (g == 2) for k, g in held]) > 0.95
    means = [np.mean([got[k].expected_grade for k, g in held if g == want]) for want in range(3)]
    assert means[0] < means[1] < means[2]


def test_gradient_of_the_likelihood():
    """One step of descent lowers the loss that the closed form gives."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(300)]
    grades = np.array([min(3, int((r < 10).sum())) for r in rows])

    def loss(m):
        p = np.column_stack([np.ones(300), m.tails(np.array([m.weights[r].sum() for r in rows])), np.zeros(300)])
        return -np.log(p[np.arange(300), grades] - p[np.arange(300), grades + 1]).mean()

    losses = [loss(oq.fit(rows, grades, 3, steps=s, ridge=0.0)) for s in (0, 5, 20, 80, 300)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a " * 9000, "z"), (2, "b", None)], "doc_id long, text string, tail string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert oq.train(docs, none, 2) is None
    assert [r.kept for r in oq.score(docs, None).collect()] == [True] * 4
    one = spark.createDataFrame([(2, 2), (None, 0), (1, None)], "doc_id long, grade int")
    got = oq.score(docs, oq.train(docs, one, 2)).collect()
    assert len(got) == 4 and all(0 <= r.tail <= 1 and r.expected_grade == pytest.approx(r.expected_grade) for r in got)
    assert oq.score(docs.limit(0), oq.train(docs, one, 2)).count() == 0
