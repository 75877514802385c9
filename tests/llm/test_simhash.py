import random

import xxhash

from hopscope.llm import simhash


def brute_fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


def signed(v):
    return v - (v >> 63 << 64)


def test_fingerprint_matches_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("aBzÄé ") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words)
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = "the same three words " * 40_000
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_links_lose_nothing(spark):
    """Clusters around centres, in short and long posting lists, for both numbers of bits."""
    rng = random.Random(11)
    for bits, pair_list in ((2, 64), (2, 3), (4, 64), (4, 1)):
        values = set()
        for _ in range(12):
            centre = rng.getrandbits(64)
            for _ in range(8):
                v = centre
                for _ in range(rng.randint(0, 5)):
                    v ^= 1 << rng.randrange(64)
                values.add(v)
        want = brute_components(values, bits)
        frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
        edges = simhash.links(frame, bits, pair_list).collect()
        assert all(((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= bits for e in edges)
        back = {signed(v): v for v in values}
        parent = dict(want)
        joined = {v: {v} for v in values}
        for e in edges:
            a, b = back[e.src], back[e.dst]
            if joined[a] is not joined[b]:
                joined[a] |= joined[b]
                for v in joined[b]:
                    joined[v] = joined[a]
        for v in values:
            assert joined[v] == {w for w in values if parent[w] == parent[v]}


def test_near_duplicates_and_edge_rows(spark):
    rows = [(5, "one two three four"), (3, "ONE two\nthree four"), (9, None), (8, ""), (None, " "), (1, "other words here now"), (1, "other words here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert out == [(0, 8), (1, 1), (1, 1), (3, 3), (5, 3), (8, 8), (9, 8)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
