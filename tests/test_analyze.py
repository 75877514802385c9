"""Synthetic paths with known truth, through the whole analysis."""

import json
import random
from dataclasses import asdict

import pytest

from hopscope.__main__ import main, read_topology
from hopscope.plans.analyze import analyse
from hopscope.plans.topology import Point, Topology

SCHEMA = "source string, iface int, row_id long, t_us long, flow string, direction string, proto string, src string, dst string, sport int, dport int, seq long, ack long, flags int, length int, ipid int"
OFFSETS = {"s0": 0, "s1": 120_000, "s2": -80_000}


def scenario(lost=(), missed=(), retried=(), n=400, seed=1):
    """Records of ``n`` packets each way over three points; lost ones end before point 1's neighbour, missed ones are not recorded at point 1."""
    rng, rows, ids = random.Random(seed), [], 0
    for k in range(n):
        for direction in ("forward", "reverse"):
            path = ["s0", "s1", "s2"] if direction == "forward" else ["s2", "s1", "s0"]
            for attempt in range(2 if direction == "forward" and k in retried else 1):
                t = 1_700_000_000_000_000 + k * 50_000 + attempt * 400_000
                for hop, source in enumerate(path):
                    t += 0 if not hop else 1000 + rng.randint(0, 200)
                    if direction == "forward" and attempt == 0 and hop > 0 and k in lost:
                        break
                    if direction == "forward" and hop == 1 and k in missed:
                        continue
                    ends = ("10.0.0.1", "192.0.2.1") if direction == "forward" else ("192.0.2.1", "10.0.0.1")
                    ids += 1
                    rows.append((source, 0, ids, t + OFFSETS[source], f"f{k % 5}", direction, "tcp", *ends, 1000 + k % 5, 80, k * 100, 7, 16, 100, k * 2 + attempt))
    return rows


def topology(**more):
    return Topology((Point("p0", "s0"), Point("p1", "s1"), Point("p2", "s2")), ("p0", "p1", "p2"), **more)


def test_losses_clocks_and_latency(spark):
    lost, missed, retried = {5, 77, 200}, {9, 10, 300}, {77, 200}
    records = spark.createDataFrame(scenario(lost, missed, retried), SCHEMA)
    result = analyse(records, topology())
    for s, offset in OFFSETS.items():
        assert result.clocks[s]["reason"] is None and abs(result.clocks[s]["offset_us"] - offset) < 250
    got = {(r.direction, r.point_a): r for r in result.segments.collect()}
    first = got["forward", "p0"]
    assert (first.unrecovered, first.impactful, first.recovered, first.capture_miss) == (1, 2, 0, 3)
    for key in (("forward", "p1"), ("reverse", "p2"), ("reverse", "p1")):
        assert got[key].unrecovered + got[key].impactful + got[key].recovered + got[key].capture_miss == 0
        assert 700 < got[key].p50_us < 1500 and got[key].negative == 0
    kinds = {r.kind for r in result.losses.collect()}
    assert kinds == {"unrecovered", "impactful", "capture_miss"}


def test_healthy_traffic_has_no_findings(spark):
    result = analyse(spark.createDataFrame(scenario(), SCHEMA), topology(bucket_seconds=1.0))
    assert result.losses.count() == 0 and {r.loss_percent for r in result.segments.collect()} == {0.0}
    assert {r.onset for r in result.onsets.collect()} == {None}
    assert all(r.loss_percent in (0.0, None) and (r.loss_percent is None) == (r.reason is not None) for r in result.buckets.collect())


def test_onset_of_a_loss_burst(spark):
    lost = set(range(240, 300))
    result = analyse(spark.createDataFrame(scenario(lost), SCHEMA), topology())
    onsets = {(r.direction, r.point_a): r.onset for r in result.onsets.collect()}
    assert onsets["forward", "p0"] == (1_700_000_000_000_000 + 240 * 50_000) // 1_000_000
    assert onsets["reverse", "p2"] is None


def test_without_samples_the_clock_is_unknown(spark):
    result = analyse(spark.createDataFrame([r for r in scenario(n=30) if r[0] != "s2"], SCHEMA), topology())
    assert result.clocks["s2"]["reason"] == "no calibrated path to the reference"


def test_two_points_on_one_record_are_refused(spark):
    both = Topology((Point("a", "s0"), Point("b", "s0")), ("a", "b"))
    with pytest.raises(ValueError):
        analyse(spark.createDataFrame(scenario(n=3), SCHEMA), both)


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame(scenario({3}, n=60), SCHEMA).write.parquet(f"{tmp_path}/r.parquet")
    raw = {"points": [asdict(p) for p in topology().points], "forward": ["p0", "p1", "p2"]}
    (tmp_path / "t.json").write_text(json.dumps(raw))
    assert read_topology(json.dumps(raw)).segments() == topology().segments()
    assert main(["analyse", f"{tmp_path}/r.parquet", f"{tmp_path}/t.json", f"{tmp_path}/a.json"]) == 0
    document = json.loads((tmp_path / "a.json").read_text())
    assert document["segments"]["count"] == 4 and any("lost (1)" in h for h in document["headlines"])
    assert main(["compare", f"{tmp_path}/a.json", f"{tmp_path}/a.json"]) == 0
    assert json.loads(capsys.readouterr().out)["count"] == 0
