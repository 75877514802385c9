import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopscope.functions import net
from hopscope.operators import joins, matching, privacy, ranges, series, windows
from hopscope.operators.graph import connected_components


def test_asof_both_ways_with_ties_and_nulls(spark):
    rng = random.Random(1)
    left = [(k, rng.choice([1, 2, None]), rng.randint(0, 30)) for k in range(60)]
    right = [(k, rng.choice([1, 2, None]), rng.randint(0, 30)) for k in range(25)]
    a, b = spark.createDataFrame(left, "id int, g int, t int"), spark.createDataFrame(right, "r int, g int, t int")
    for forward in (False, True):
        got = {x.id: (x.r_r, x.r_t) for x in joins.asof(a, b, ["g"], "t", ["r"], forward).collect()}
        for k, g, t in left:
            near = [(abs(u - t), -r, r, u) for r, h, u in right if h == g and (u >= t if forward else u <= t)]
            assert got[k] == ((min(near)[2], min(near)[3]) if near else (None, None))


def test_nearest_and_one_to_one(spark):
    a = spark.createDataFrame([(1, 1, 10), (2, 1, 14), (3, 1, 100)], "id int, g int, t int")
    b = spark.createDataFrame([(7, 1, 12), (8, 1, 40)], "r int, g int, t int")
    near = joins.nearest(a, b, ["g"], "t", "r", 50)
    assert {(x.id, x.near_r, x.gap) for x in near.collect()} == {(1, 7, 2), (2, 7, 2), (3, None, None)}
    assert [(x.id, x.near_r) for x in joins.one_to_one(near.filter("near_r IS NOT NULL"), "id", "near_r", "gap").collect()] == [(1, 7)]


def test_interval_join_matches_brute_force(spark):
    rng = random.Random(4)
    spans = lambda n: [(k, rng.choice("ab"), lo := rng.randint(0, 200), lo + rng.randint(1, 90)) for k in range(n)]
    pts, rgs = spans(80), spans(40)
    p = spark.createDataFrame(pts, "p int, g string, a int, b int")
    r = spark.createDataFrame(rgs, "r int, g string, lo int, hi int")
    got = {(x.p, x.r) for x in joins.interval_join(p, r, ["g"], "lo", "hi", 16, "a", "b").collect()}
    assert got == {(k, j) for k, g, a, b in pts for j, h, lo, hi in rgs if g == h and lo <= a and b <= hi}


def test_mutual_best_leaves_ties_open(spark):
    pairs = [("a", "x", 1), ("a", "y", 2), ("b", "x", 2), ("b", "y", 3), ("c", "z", 1), ("d", "z", 1)]
    out = joins.mutual_best(spark.createDataFrame(pairs, "l string, r string, d int"), "l", "r", "d").collect()
    assert {(x.l, x.r) for x in out} == {("a", "x"), ("b", "y")}


def test_occurrences_match_one_to_one_in_order(spark):
    """Equal numbers pair in order; else the nearest; what is left is a collision."""
    rows = [(1, k, "even", t) for k, t in enumerate((0, 100, 200))] + [(2, 10 + k, "even", t) for k, t in enumerate((5, 105, 205))]
    rows += [(1, 20, "odd", 0), (1, 21, "odd", 1000), (2, 30, "odd", 990)] + [(1, 40, "far", 0), (2, 41, "far", 9000), (2, 50, "new", 1)]
    rows += [(1, 60, "twice", 0), (1, 61, "twice", 5), (2, 62, "twice", 3)]
    obs = spark.createDataFrame(rows, "point int, row_id int, name string, t int")
    out = {r.row_id: r for r in matching.match_occurrences(matching.prepare_occurrences(obs, ["name"], "t", "row_id"), 1, "t", "row_id", 50).collect()}
    for k in range(3):
        assert out[k].packet_key == out[10 + k].packet_key and out[k].eligible
    assert len({out[k].packet_key for k in range(3)}) == 3
    assert out[30].packet_key == out[21].packet_key != out[20].packet_key
    assert out[41].excluded_reason == "occurrence collision" and not out[41].eligible
    assert out[61].excluded_reason == "near duplicate" and out[50].eligible
    assert out[62].packet_key == out[60].packet_key


def test_loss_kinds_in_order(spark):
    cases = [(True, 5, 1, "capture_miss"), (False, 5, 1, "recovered"), (False, 200, 1, "impactful"), (False, 5, 2, "impactful"), (False, None, None, "unrecovered")]
    frame = spark.createDataFrame(cases, "s boolean, r int, n int, want string")
    assert all(x.got == x.want for x in frame.withColumn("got", matching.loss_kind(F.col("s"), F.col("r"), F.col("n"), 200)).collect())


def test_atoms_and_coverage_over_the_wrap(spark):
    rows = [("f", 0, "k1", net.U32 - 10, 30), ("f", 3, "k2", net.U32 - 10, 15), ("f", 3, "k3", 5, 5), ("g", 0, "k4", 0, 10)]
    frame = spark.createDataFrame(rows, "flow string, point int, packet_key string, seq long, len long")
    cut = ranges.atom_rows(ranges.intervals(frame, "seq", F.col("len"), ["flow", "point", "packet_key"]), ["flow"], ["point", "packet_key"])
    got = {r.flow: (r.bytes, r.seen, r.missing, r.state) for r in ranges.coverage(cut, ["flow"], 0, 3).collect()}
    assert got == {"f": (30, 20, 10, "unknown"), "g": (10, 0, 10, "missing")}


def test_windows(spark):
    rows = spark.createDataFrame([(1, 0, 65530), (1, 1, 3), (1, 2, 65533), (1, 9, 10)], "g int, t int, c int")
    got = windows.unwrap(rows, ["g"], ["t"], "c", 16, "u").orderBy("t").collect()
    assert [r.u for r in got] == [65530, 65539, 65533, 65546]
    runs = windows.runs(spark.createDataFrame([(1, b) for b in (1, 2, 3, 7, 8)], "g int, b int"), ["g"], "b", 3).collect()
    assert [(r.first, r.last, r.length) for r in runs] == [(1, 3, 3)]
    silence = windows.longest_silence(rows, ["g"], "t", F.lit(1), F.lit(8)).first()
    assert silence.silence_us == 6


def test_clock_fit_finds_offset_and_drift(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 60e6, 4000))
    clock = lambda x: x + 250_000 + 20e-6 * x
    delay = lambda: 500 + rng.exponential(300, len(t))
    fwd, rev = np.column_stack([t, clock(t + delay())]), np.column_stack([t + delay(), clock(t)])

    def fit(*sides):
        rows = [("p", float(x), float(y), way) for way, side in zip((True, False), sides) for x, y in side]
        found = series.clock_models(spark.createDataFrame(rows, "pair string, ref_us double, other_us double, forward boolean"), "pair").collect()
        assert len(found) == 1 and found[0].samples == len(rows)
        return found[0]

    model = fit(fwd, rev)
    assert model["reason"] is None and abs(model["drift"] - 20e-6) < 2e-6
    assert abs(model["offset_us"] - (250_000 + 20e-6 * t.min())) < 100 < 250_000
    few = fit(fwd[:2], rev)
    assert few["reason"] == "too few samples" and few["offset_us"] is few["drift"] is None
    assert fit(np.column_stack([t, t * 1.01]), rev)["reason"] == "drift out of range"
    assert fit(np.column_stack([t, t - 9000]), np.column_stack([t, t + 9000]))["reason"] == "infeasible"


def test_onset_folds():
    flat = [1, 0, 1, 1, 0]
    assert series.count_onset([*flat, 0, 5, 6]) == 6
    assert series.count_onset([*flat, 9, None, 0]) is None
    assert series.count_onset([*flat, 9] + [0] * 20) is None
    assert series.count_onset([1, 2]) is None
    assert series.value_onset([10, 10, 11, 10, 10, 90, 10, 80, 95], floor=5) == 7
    assert series.value_onset([10, 10, 11, 10, 10, 90, None, 80, 10], floor=5) is None
    assert series.latency_window([10] * 6 + [99, 98, 97, 10, 10, 10], floor=5) == (6, 9)
    assert series.latency_window([10] * 6 + [99, 98, 97, None, 10], floor=5) is None
    assert series.latency_window([10, 99], floor=5) is None


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_addresses(spark):
    texts = ["10.1.2.3", "10.1.2.77", "192.0.2.1", "2001:db8::1", "300.1.1.1", "x", None]
    frame = spark.createDataFrame([(t,) for t in texts], "a string")
    nets = ["10.0.0.0/8", "2001:db8::/32"]
    got = frame.select(net.in_networks(F.col("a"), nets).alias("v4"), net.in_networks_any(F.col("a"), nets).alias("all"), privacy.anonymise_ipv4(F.col("a"), b"k").alias("m")).collect()
    assert [r.v4 for r in got] == [True, True, False, False, False, False, False]
    assert [bool(r["all"]) for r in got] == [True, True, False, True, False, False, False]
    first, second = got[0].m.split("."), got[1].m.split(".")
    assert first[:3] == second[:3] and first[3] != second[3] and got[5].m is None
    bits = lambda s: "".join(f"{int(x):08b}" for x in s.split("."))
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(bits(a), bits(b))) if x != y), 32)
    assert shared(got[0].m, got[1].m) == shared(texts[0], texts[1])


def test_ewma_against_the_loop(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "g int, t int, x double")
    want = 0.0
    for v in values:
        want += (v - want) / 16
    assert math.isclose(windows.ewma(rows, ["g"], ["t"], "x", 1 / 16, "j").first().j, want)


def test_gating_keeps_the_unknown(spark):
    rows = spark.createDataFrame([("partial", 5, 5), ("capturing", 0, 0), ("capturing", 10, 8), ("capturing", 10, 10)], "c string, e int, m int")
    value, reason = series.gated(F.lit(1.0), F.col("c"), F.col("e"), F.col("m"))
    got = [(r.v, r.w) for r in rows.select(value.alias("v"), reason.alias("w")).collect()]
    assert got == [(None, "coverage: partial"), (None, "no eligible records"), (None, "too few matchable records"), (1.0, None)]


def test_grid_refuses_too_many_buckets(spark):
    keys = spark.createDataFrame([(1, 0, 10**9)], "k int, a long, b long")
    with pytest.raises(ValueError):
        series.grid(keys, F.col("a"), F.col("b"), 1)
