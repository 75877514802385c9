import random

import numpy as np

from hopscope.llm import fm_index as fm


def brute(texts, items, window):
    phrases = {}
    for item, text in items:
        words = fm.words_of(text)
        for at in range(max(1, len(words) - window + 1)) if words else ():
            phrases.setdefault(tuple(words[at : at + window]), set()).add(item)
    out = []
    for text in texts:
        words = fm.words_of(text)
        hit, found = [False] * len(words), set()
        for p, owners in phrases.items():
            for at in range(len(words) - len(p) + 1):
                if tuple(words[at : at + len(p)]) == p:
                    hit[at : at + len(p)] = [True] * len(p)
                    found |= owners
        out.append((len(words), hit, sorted(found)))
    return out


def test_search_matches_brute_force():
    rng = random.Random(5)
    for case in range(60):
        letters = "ab" if case % 2 else "abcdefgh"
        line = lambda n: " ".join(rng.choice(letters) for _ in range(n))
        items = [(str(k), line(rng.randint(0, 8))) for k in range(6)] + [("x", None), ("y", "  .. ")]
        texts = [line(rng.randint(0, 60)) for _ in range(12)] + [None, "", "zz " * 5, items[0][1] + "!" + (items[1][1] or "")]
        window = rng.choice([1, 2, 3, 5])
        phrases = fm.Phrases([(i, fm.words_of(t)) for i, t in items], window)
        got = [(n, h.tolist(), i) for n, h, i in fm.search_shard(texts, [phrases])]
        assert got == brute(texts, items, window)


def test_wavelet_matrix_ranks_and_symbols():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 23, 1000)
    matrix = fm.WaveletMatrix(seq, 5)
    at = np.arange(1000)
    assert (matrix.access(at) == seq).all()
    for c in range(23):
        want = np.concatenate([[0], np.cumsum(seq == c)])
        assert (matrix.rank(np.full(1001, c), np.arange(1001)) == want).all()


def test_clean_cuts_until_nothing_is_left():
    phrases = fm.Phrases([("1", fm.words_of("a b c d"))], 4)
    assert fm.clean("x a b A, b c d. c d y", [phrases]) == "x  y"
    assert fm.clean("Ä a  B\nc d!", [phrases]) == "Ä !"


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "a b"), (2, ""), (2, "a b c"), (3, "q " * 5000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a B"), (8, None), (9, "")], "item_id long, text string")
    rows = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in fm.contamination(docs, bench).collect()}
    assert rows == {(1, 0): (0, 0), (None, 2): (2, 1), (2, 0): (0, 0), (2, 3): (2, 1), (3, 5000): (0, 0)}
    assert fm.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in fm.contamination(docs, bench.limit(0)).collect()} == {0}
    wide = docs.withColumn("n_words", docs.text)
    assert [r.text for r in fm.decontaminate(wide, bench).collect()] == [None, "", "", " c", "q " * 5000]
