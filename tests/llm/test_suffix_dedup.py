import hashlib
import random
from collections import Counter

from hopscope.llm import suffix_dedup


def brute(texts, size):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + size] for r in raws for k in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for k in range(len(r) - size + 1):
            if seen[r[k : k + size]] > 1:
                gone[k : k + size] = [True] * size
        left = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((len(r), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed, letters):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.randint(20, 200)) for _ in range(4)]
    out = [text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 80)) + rng.choice([*shared, ""]) for _ in range(40)]
    return [*out, *out[:3], shared[0][:39], None, "", "a" * 130, "ab" * 90]


def test_digest_matches_brute_force(spark):
    for seed, letters in ((1, "ab"), (2, "abcdé f")):
        texts = corpus(seed, letters)
        rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)] + [(0, texts[0])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 40)))
        got = suffix_dedup.repeat_digest(docs, 40).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    texts = corpus(4, "abcd ")
    windows = [w for t in texts for w in suffix_dedup.segments((t or "").encode(), 40)]
    assert sum(n for _, _, n in windows) == sum(max(0, len((t or "").encode()) - 39) for t in texts)


def test_removal_keeps_columns_and_rows(spark):
    rows = [(1, "x" + "é" * 30 + "1", "k", "s"), (2, "é" * 30 + "2", None, None), (3, None, "", "t"), (3, "alone", "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, spans string")
    got = sorted((r.doc_id, r.text or "", r.th, r.spans) for r in suffix_dedup.remove_repeats(docs, 20).collect() if True)
    assert got == [(1, "x1", "k", "s"), (2, "2", None, None), (3, "", "", "t"), (3, "alone", "", "t")]
    assert suffix_dedup.remove_repeats(docs.limit(0), 20).count() == 0


def test_hot_anchors_and_spilled_shards(spark, monkeypatch):
    """A notice that stands in many different texts: its segments are anchored anew, and shards exceed the sorter's memory."""
    from hopscope.llm import induced_sort

    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1 << 14)
    anew = []
    inner = suffix_dedup._anchored_anew
    monkeypatch.setattr(suffix_dedup, "_anchored_anew", lambda *a: anew.append(1) or inner(*a))
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    notice, texts = text(35), []
    for _ in range(250):
        texts.append(text(60) + notice + text(60))
    texts += [t[10:140] for t in texts[:30]] + [text(30) + t[40:] for t in texts[30:60]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    # Workers take the limit from a default argument.
    monkeypatch.setattr(suffix_dedup, "repeated", lambda segments, size, folder: induced_sort.repeated(segments, size, folder, 1 << 12))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digest(docs, 48).collect())
    assert anew and got == Counter((i, *w) for i, w in enumerate(brute(texts, 48)))
