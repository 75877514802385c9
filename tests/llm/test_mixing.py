import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hopscope.llm import mixing

SCHEMA = "doc_id long, source string, words long"


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """The rule step by step: stop what is over its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        each = (share * sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * each for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 150)
    rng = random.Random(6)
    names = ["a", "b", "Z", "é", "\U0001f600", "ﬀ", None]
    rows = [(k, rng.choice(names if k % 3 else ["a"]), rng.randint(0, 400)) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs.repartition(5), F.col("words")).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.mix_size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.02 * want[s] + 400
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(2), F.col("words")).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    emitted = Counter(r.doc_id for r in mixing.emit(mixing.mix(docs, F.col("words"))).collect())
    assert emitted == +Counter({r.doc_id: r.copies for r in got})


def test_edge_rows(spark):
    rows = [(1, "a", None), (1, "a", 5), (1, "a", 5), (None, None, 7), (2, "b", 0), (3, "c", 10**9)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("target", F.lit("x")).withColumn("copies", F.lit("y"))
    got = mixing.mix(docs, F.col("words")).collect()
    assert len(got) == 6
    assert {r.source: r.target for r in got}["b"] == 0
    assert all(r.copies <= 2 for r in got)
    assert mixing.mix(docs.limit(0), F.col("words")).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, None)], SCHEMA)
    assert [(r.target, r.copies) for r in mixing.mix(nothing, F.col("words")).collect()] == [(0.0, 0), (0.0, 0)]
