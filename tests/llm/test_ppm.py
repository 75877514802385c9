import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopscope.llm import ppm


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [None, "", "word " * 300 + "x" * 700, "ZZZ new\tbytes € zz", "x" * 3000, texts[0], texts[0].upper()]
    return [(k, t, k % 5 != 0) for k, t in enumerate(texts)] + [(None, "abc", None)]


@pytest.mark.parametrize("order", [1, 3, 4])
def test_scores_match_the_trie(spark, monkeypatch, order):
    monkeypatch.setattr(ppm, "PIECE", 200)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 1500)
    rows = corpus()
    trie, words = ppm.Trie(order), Counter()
    split = lambda t: [*ppm._raw(t).split(), None]
    for _, text, train in rows:
        if train:
            trie.learn(text)
            words.update(split(text))
    total, distinct = sum(words.values()), len(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = {r.doc_id: r for r in ppm.score_corpus(docs, F.col("t"), order).collect()}
    assert len(got) == len(rows)
    for k, text, train in rows:
        r, tokens = got[k], split(text)
        assert r.train is bool(train) and r.train_tokens == total and r.n_tokens == len(tokens)
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens), rel=1e-12)
        assert r.score == pytest.approx(trie.score(text, False), rel=1e-9)


def test_spans_cut_long_texts(monkeypatch):
    monkeypatch.setattr(ppm, "PIECE", 50)
    raws = [b"", b"ab cd " * 40, b"x" * 170, b" lead and trail ", b"q"]
    whole = {}
    for words in (False, True):
        seen = [s for spans in ppm._spans(raws, words) for s in spans]
        assert all(b"".join(raws[k][a:e] for j, a, e in seen if j == k) == raws[k] for k in range(len(raws)))
        whole[words] = len(seen)
    assert whole[False] > len(raws)
    keys = [(k, key) for spans in ppm._spans(raws, True) for (k, _, _), part in zip(spans, np.split(*(lambda x: (x[0], np.cumsum(x[1])[:-1]))(ppm.word_keys(raws, spans)))) for key in part]
    names = [(k, w) for k, raw in enumerate(raws) for w in raw.split()]
    assert len(keys) == len(names) and len({(k, v) for k, v in keys}) == len(set(names))
    assert all(v < 0 for _, v in keys)


def test_probabilities_sum_to_one():
    trie = ppm.Trie(3)
    for text in ("abracadabra", "abba", "é"):
        trie.learn(text)
    for context in (b"bra", b"zzz", b"\xfe\xfe\xfe", b"abb"):
        assert sum(10 ** trie.log10(context, s) for s in range(256) if s != ppm.PAD) == pytest.approx(1)


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, "ab", False), (2, None, False)], "doc_id long, text string, t boolean")
    assert ppm.score_corpus(docs.limit(0), F.col("t")).count() == 0
    got = {r.doc_id: r for r in ppm.score_corpus(docs, F.col("t")).collect()}
    assert got[1].score == pytest.approx(-3 * math.log10(255)) and got[1].train_tokens == 0


def test_adaptive_learns_from_the_text_itself(spark):
    docs = spark.createDataFrame([(1, "ab" * 200, 5.0), (2, None, 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in ppm.score_adaptive(docs).collect()}
    assert -60 < got[1] < -4 and got[2] == pytest.approx(-math.log10(255))
