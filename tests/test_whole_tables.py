"""Queries over all flows and events, held against brute force on a fixture that no id filter spares."""

import datetime
from collections import defaultdict

import pytest

from hopscope.plans import catalogue, observations

QUERIES = catalogue.queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """800 events of the flows 36 to 47."""
    start, kinds = datetime.datetime(2024, 1, 1), ("view", "click", "signup", "error", "purchase")
    rows = [(k, 36 + k % 12, start + datetime.timedelta(seconds=37 * k), kinds[k % 5], float(k), f'{{"k": {k * 7 % 101}}}') for k in range(800)]
    path = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def obs(spark, folder):
    return observations.path_obs(spark.read.parquet(f"{folder}/events.parquet")).collect()


def seen_bytes(obs):
    """Bytes by point and flow, with the packet keys that carry each."""
    at = {0: defaultdict(lambda: defaultdict(set)), 3: defaultdict(lambda: defaultdict(set))}
    for r in obs:
        if r.direction == "forward" and r.point in at:
            for b in range(r.seq, r.seq + r.len):
                at[r.point][r.flow][b].add(r.packet_key)
    return at[0], at[3]


def test_ranges_of_all_flows(spark, folder, obs):
    here, there = seen_bytes(obs)
    got = {r.flow: (r.bytes, r.seen, r.missing) for r in QUERIES["range_coverage"](spark, folder).collect()}
    both = {f: len(here[f].keys() & there[f].keys()) for f in here}
    assert max(got) >= 40 and got == {f: (len(here[f]), both[f], len(here[f]) - both[f]) for f in here}
    gone = defaultdict(set)
    for r in QUERIES["missing_ranges"](spark, folder).collect():
        gone[r.flow] |= set(range(r.lo, r.hi))
    assert max(gone) >= 40 and gone == {f: here[f].keys() - there[f].keys() for f in here if here[f].keys() - there[f].keys()}


def test_recoveries_of_all_flows(spark, folder, obs):
    _, there = seen_bytes(obs)
    arrived = {r.packet_key for r in obs if r.point == 3 and r.direction == "forward"}
    want = {}
    for r in obs:
        if r.point == 0 and r.direction == "forward" and r.packet_key not in arrived:
            again = {any(k > r.packet_key for k in there[r.flow][b]) for b in range(r.seq, r.seq + r.len)}
            want[r.packet_key] = "unknown" if len(again) > 1 else "recovered" if True in again else "missing"
    got = {r.packet_key: r.state for r in QUERIES["range_recoveries"](spark, folder).collect()}
    assert got == want and len(set(want.values())) > 1


def test_field_changes_of_all_flows(spark, folder, obs):
    at = defaultdict(list)
    for r in obs:
        at[r.packet_key, r.hop].append(r)
    want = [(a.packet_key, a.hop, f, a[f], b[f]) for (key, hop), rows in at.items() for a in rows for b in at.get((key, hop + 1), []) for f in ("ttl", "dscp", "len") if a[f] != b[f]]
    got = [(r.packet_key, r.hop, r.field, r.before, r.after) for r in QUERIES["field_diff"](spark, folder).collect()]
    assert want and sorted(got) == sorted(want)


def test_sessions_of_all_events(spark, folder):
    """Streams that share keys in any event are one session; every stream has a row."""
    from pyspark.sql import functions as F

    few = folder + "/few"
    # Few events, so that not all streams are joined; most ids are no multiple of five.
    spark.read.parquet(f"{folder}/events.parquet").filter("event_id % 67 < 3").withColumn("props", F.format_string('{"k": %d}', F.col("event_id") % 67)).write.parquet(f"{few}/events.parquet")
    events = observations.micro_events(spark.read.parquet(f"{few}/events.parquet")).collect()
    parent = {e.flow: e.flow for e in events}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    first = {}
    for e in events:
        lo, hi = sorted((root(e.flow), root(first.setdefault(e.k * 1000 + e.event_id % 40, e.flow))))
        parent[hi] = lo
    got = {r.stream: r.session for r in QUERIES["linked_sessions"](spark, few).collect()}
    assert got == {f: root(f) for f in parent}
    assert len(got) == 12 and len(set(got.values())) > 1
