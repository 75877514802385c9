import random

from hopscope.llm import simhash


def shingles(text, n=5):
    words = simhash.ascii_words(text)
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, similarity):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in ids if root(i) != i}


def joined(found):
    return {r.doc_id: r.component_id for r in found.collect() if r.doc_id != r.component_id}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, rows, k = draw(40), [], 0
    for _ in range(60):
        base = draw(rng.choice([0, 3, 20, 60, 150, 400, 1500])) + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(int(len(words) * rng.choice([0, 0, 0.002, 0.01, 0.02, 0.05]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((k, " ".join(words)))
            k += 1
    return rows


def test_components_against_brute_force(spark):
    found = missed = 0
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = brute(rows, 0.8)
        got = joined(simhash.similar_documents(docs))
        assert set(got) <= set(want)
        found, missed = found + len(got), missed + len(set(want) - set(got))
    assert found and not missed


def test_one_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(7, long, "a"), (3, long + " more", "b"), (5, "short one", "c"), (6, None, "d"), (8, "", "e"), (None, long, "f"), (9, "other", "g"), (9, "other", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    assert sorted(r.h for r in simhash.drop_similar(docs).collect()) == ["b", "c", "d", "g"]
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_rows_not_ids_are_compared(spark):
    """One id may stand for several texts, copies with null ids go, and the caller's names clash with none of ours."""
    x, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    names = ["h", "_h", "text_id", "place", "component", "copies", "n", "id", "row", "best_id", "fps"]
    rows = [(i, t, *range(len(names))) for i, t in ((1, x), (2, x), (2, other), (None, x), (None, "alone here"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    got = simhash.drop_similar(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "alone here"), (1, x), (2, other)]
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got)
    classes = [(r.doc_id, r.component_id) for r in simhash.similar_documents(docs).collect()]
    assert sorted(classes, key=repr) == sorted([(1, 1), (2, 1), (2, 2), (None, 1), (None, None)], key=repr)


def test_variants_of_an_original_in_the_middle(spark):
    """Variants are alike their original only, which is neither the smallest nor the largest id of the meeting."""
    rng = random.Random(5)
    original = [f"w{rng.randrange(10**6)}" for _ in range(304)]
    rows = [(150, " ".join(original))]
    for k in [*range(150), *range(151, 301)]:
        words = list(original)
        for at in rng.sample(range(2, 302), 5):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    near = brute(rows, 0.8)
    assert len(near) == 300
    # Unlike documents in one long meeting with the variants: all share a block of a third of their words.
    block = [f"c{k}" for k in range(100)]
    for k in range(100):
        own = [f"x{k // 2}_{j}" for j in range(200)]
        own[k % 2 * 7] = "changed"
        rows.append((1000 + k, " ".join(block + own)))
    got = joined(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    want = brute(rows, 0.8)
    assert set(got) <= set(want)
    assert got == want


def test_long_meetings_lose_no_pair(spark):
    """All documents meet in one place: chains, stars and unlike ones are joined as all pairs join them."""
    rng, rows, k = random.Random(9), [], 0
    for _ in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            words = list(base)
            for at in rng.sample(range(60), rng.randint(0, 2)):
                words[at] = f"n{k}"
            rows.append((k, " ".join(words)))
            k += 1
    rng.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    names = {x: j for j, x in enumerate(sorted({x for s in sets.values() for x in s}))}
    packed = [(i, b"".join(names[x].to_bytes(4, "little") for x in sorted(s, key=names.get))) for i, s in sets.items()]
    wanted = spark.createDataFrame(packed, "doc_id long, shingles binary")
    members = spark.createDataFrame([(7, i, len(rows), len(s)) for i, s in sets.items()], "at long, doc_id long, n long, size long")
    none = spark.createDataFrame([], "a long, b long")

    def similar(pairs):
        alike = [(a, b) for a, b in pairs.collect() if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        return spark.createDataFrame(alike, "a long, b long")

    edges = simhash._link_long(members, none, wanted, similar, 0.8)
    found = {r.node: r.component for r in simhash.connected_components(edges, "a", "b").collect() if r.node != r.component}
    assert found == brute(rows, 0.8)


def test_fingerprints_of_whole_texts_are_linked_through_the_index(spark, monkeypatch):
    """The pipeline's stage asks the inverted index for links of whole texts, and no other pairs are joined than alike ones."""
    import corpus_pipeline

    linked, inner = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: linked.append({r.fp for r in fps.collect()}) or inner(fps, *a))
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(base[:1500])), (4, " ".join(base[::-1])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {1, 3, 4, 5}
    values = {v - (v >> 63 << 64) for v in (simhash.fingerprint(t, 5) for _, t in rows)}
    assert linked == [values]
    found = simhash.fingerprint_pairs(docs)
    assert [(r.a, r.b) for r in found.collect()] == [(1, 2)]
