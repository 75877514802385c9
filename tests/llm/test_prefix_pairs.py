import random

import numpy as np

from hopscope.llm import simhash


def alike(x, y):
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= 0.8 * (len(x) + len(y) - common)


def pairs_of(spark, sets, components):
    """What the pass makes of ``sets``, all in one meeting."""
    members = spark.createDataFrame([(i, components[i], len(s), [1]) for i, s in sets.items()], "doc_id long, component long, size long, ats array<long>")
    wanted = spark.createDataFrame([(i, s.astype("<u4").tobytes()) for i, s in sets.items()], "doc_id long, shingles binary")
    return {(r.a, r.b) for r in simhash._prefix_pairs(members, wanted, 0.8).collect()}


def test_variants_of_a_lost_original_make_few_pairs(spark):
    """Each has more shingles of its own than two alike may differ in; the rarest of the rest stand in all of them."""
    rng = np.random.default_rng(4)
    shared = np.sort(rng.choice(1 << 30, 120, replace=False)).astype(np.int64)
    sets = {i: np.sort(np.concatenate([shared, (1 << 30) + i * 100 + np.arange(20)])) for i in range(300)}
    assert len(pairs_of(spark, sets, {i: i for i in sets})) < 300


def test_no_pair_of_two_components_is_lost(spark):
    rng, sets = random.Random(8), {}
    for i in range(150):
        base = range(i % 9 * 1000, i % 9 * 1000 + rng.choice([1, 3, 10, 40, 41, 80]))
        own = {x if rng.random() < 0.9 else rng.randrange(1 << 32) for x in base}
        sets[i] = np.array(sorted(own), np.int64)
    sets |= {150: np.zeros(0, np.int64), 151: np.zeros(0, np.int64)}
    components = {i: rng.choice([i, i // 30 * 30]) for i in sets}
    want = {(a, b) for a in sets for b in sets if a < b and components[a] != components[b] and alike(sets[a], sets[b])}
    assert len(want) > 20 and want <= pairs_of(spark, sets, components)


def test_counters_meet_in_few_rows(spark, monkeypatch):
    """A task's counters go on in one row a block, and the driver holds no row of Python's for a counter."""
    rng = np.random.default_rng(6)
    common = rng.choice(1 << 32, 3000, replace=False).astype("<u4")
    sets = [np.unique(np.concatenate([common, rng.choice(1 << 32, 200).astype("<u4")])) for _ in range(40)] + [np.zeros(0, "<u4")]
    packed = spark.createDataFrame([(s.tobytes(),) for s in sets], "shingles binary").repartition(8)
    rows, frame, inner = [], type(packed), type(packed).mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a: rows.append(inner(self, f, *a)) or rows[-1])
    monkeypatch.setattr(frame, "toPandas", None)
    monkeypatch.setattr(frame, "collect", None)
    got = simhash._shingle_counts(packed)
    assert rows[0].count() <= 8 * simhash.COUNTER_BLOCKS
    want = np.bincount(np.concatenate(sets) & np.uint32(simhash.COUNTERS - 1), minlength=simhash.COUNTERS)
    assert got[common & np.uint32(simhash.COUNTERS - 1)].min() >= 40
    assert (got == np.maximum(want, 1)).all()


def test_filters_reach_the_driver_packed(spark, monkeypatch):
    keys = spark.range(5000).selectExpr("xxhash64(id) h")
    want = {r.h % (1 << 17) for r in keys.collect()}
    monkeypatch.setattr(type(keys), "toPandas", None)
    monkeypatch.setattr(type(keys), "collect", None)
    bits, table = simhash.bit_filter(keys, "h", 5000)
    assert bits == 1 << 17 and set(np.flatnonzero(np.unpackbits(table.view(np.uint8), bitorder="little"))) == want
