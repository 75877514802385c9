import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from hopscope.plans.topology import Point, Topology, client_networks, group_sources, order_points, overlapping, restrict_scope, select_observations
from hopscope.sources import containers, sinks, tables


def packet(seq, flags=16, payload=b"hello"):
    tcp = struct.pack(">HHIIBBHHH", 1234, 80, seq, 7, 0x50, flags, 100, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 46 << 2, 20 + len(tcp), 99, 0, 64, 6, 0, bytes([10, 0, 0, 1]), bytes([192, 0, 2, 1]))
    return b"\2" * 12 + b"\x08\x00" + ip + tcp


def pcap(packets, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(f"{order}IHHIIII", magic, 2, 4, 0, 0, 65535, 1)
    for k, p in enumerate(packets):
        out += struct.pack(f"{order}IIII", 1_700_000_000 + k, 5000 if nano else 5, len(p), len(p) + 1) + p
    return out


def pcapng(packets):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 256) + struct.pack("<HH4s", 2, 4, b"eth7") + struct.pack("<HHB3x", 9, 1, 9))
    for k, p in enumerate(packets):
        t = (1_700_000_000 + k) * 10**9 + 5000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(p), len(p)) + p)
    return out + block(5, struct.pack("<III", 0, 0, 0) + struct.pack("<HHQ", 5, 8, 42))


def snoop(packets):
    out = b"snoop\0\0\0" + struct.pack(">II", 2, 4)
    for k, p in enumerate(packets):
        pad = -len(p) % 4
        out += struct.pack(">IIIIII", len(p), len(p), 24 + len(p) + pad, k, 1_700_000_000 + k, 5) + p + b"\0" * pad
    return out


def test_containers(spark, tmp_path):
    packets = [packet(k * 5) for k in range(4)]
    files = {"a.pcap": pcap(packets), "b.pcap": pcap(packets, ">", True), "c.pcapng": pcapng(packets), "d.snoop": snoop(packets)}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    containers.register(spark)
    uris = [f"file://{tmp_path}/{n}" for n in files]
    rows = spark.read.format("recording").option("paths", ",".join(uris)).load().orderBy("path", "row_id").collect()
    assert len(rows) == 16
    for k, r in enumerate(rows):
        assert (r.src, r.dst, r.sport, r.dport, r.proto, r.ttl, r.dscp, r.length, r.flags) == ("10.0.0.1", "192.0.2.1", 1234, 80, 6, 64, 46, 5, 16)
        assert r.seq == k % 4 * 5 and r.t_us == (1_700_000_000 + k % 4) * 1_000_000 + 5
    found = {n: containers.inventory(u) for n, u in zip(files, uris)}
    assert [i["format"] for i in found.values()] == ["pcap", "pcap", "pcapng", "snoop"]
    assert found["c.pcapng"]["interfaces"] == ["eth7"] and found["c.pcapng"]["dropped"] == 42 and found["d.snoop"]["dropped"] == 3


def test_damaged_and_zero_tails(tmp_path):
    raw = pcap([packet(1), packet(6)])
    for name, data, records, damaged, zeros in (("cut", raw[:-3], 1, True, 0), ("zero", raw + b"\0" * 400, 2, False, 400), ("none", b"text", 0, False, 0), ("empty", b"", 0, False, 0)):
        (tmp_path / name).write_bytes(data)
        got = containers.inventory(f"file://{tmp_path}/{name}")
        assert (got["records"], got["damaged_tail"], got["zero_tail"]) == (records, damaged, zeros)
    # Zeros in the middle end nothing, and zeros of the last record count to the tail.
    hole = raw + b"\0" * 400 + raw[24:]
    assert containers._next_solid(io.BytesIO(b"\0" * 9000 + b"x\0"), 5, 9002) == 9000
    (tmp_path / "hole").write_bytes(hole)
    got = containers.inventory(f"file://{tmp_path}/hole")
    assert got["records"] >= 2 + 25 and got["zero_tail"] == 0
    assert containers._next_solid(io.BytesIO(b"ab\0\0"), 2, 4) is None


def test_field_dump_and_quarantine(spark, tmp_path):
    lines = ["1\t1700000000.5\t0\t10.0.0.1\t10.0.0.2\t1\t2\ttcp\t5\t6\t16\t9\t64\t0\t7\tab\t", "2\t\t0\ta\tb\t1\t2\ttcp\t\t\t\t\t\t\t\t\t", "3\t5.0\t0\ta\tb\t1\t2\tudp\t\t\t\t\t\t\t\t\t", "4\t1700000001\t0\ta\tb\t2\t1\tarp\t\t\t\t\t\t\t\t\t"]
    (tmp_path / "x.tsv").write_text("\n".join(lines))
    good, bad = tables.parse_records(tables.field_dump(spark, [str(tmp_path / "x.tsv")]), F.lit(1_800_000_000_000_000))
    assert [(r.row_id, r.t_us) for r in good.collect()] == [(1, 1_700_000_000_500_000)]
    assert {r.row_id: r.reason for r in bad.collect()} == {2: "missing", 3: "before 2000", 4: "unsupported protocol"}


def test_prefilter(spark):
    large = spark.createDataFrame([("a", "b")] * 3 + [("x", "y")] * 10, "src string, dst string")
    small = spark.createDataFrame([("b", "a")], "src string, dst string")
    assert tables.prefilter(large, small).count() == 3
    assert tables.prefilter(large.union(large.filter("src = 'x'").limit(10).crossJoin(spark.range(5)).select("src", "dst")), small).count() == 63
    assert tables.choose_prefilter({"a": 10, "b": 11, "c": 100}) == ["c"]


def test_text_log(spark):
    text = ["noise", "2024-01-01 00:00:01.5 port1 in x", "0x0000  0102 0304 0506 0708", "0x0008  090a 0b0c 0d0e 0f10", "", "5.25 port2 out", "0x0000  0102", "oops", "7.0 port2 out", "0x0004  0102"]
    lines = spark.createDataFrame([("f", k, t) for k, t in enumerate(text)], "source string, line long, value string")
    good, skipped = tables.text_log(lines)
    row = good.collect()
    assert [(r.iface, r.t_us, bytes(r.data)) for r in row] == [("port1", 1704067201500000, bytes(range(1, 17)))]
    assert {r.reason: r.lines for r in skipped.collect()} == {"before the first header": 1, "blank": 1, "too short": 1, "other text": 1, "gap or overlap": 1}


def test_application_events_and_overlay(spark):
    values = [{"method": "GET", "uri": "/x"}, {"status": 200, "sni": "h"}, {"rst": True}, {}]
    lines = spark.createDataFrame([("s", k, json.dumps(v)) for k, v in enumerate(values)], "source string, row_id int, value string")
    got = {(r.row_id, r.kind, r.detail) for r in tables.application_events(lines).collect()}
    assert got == {(0, "request", "GET /x"), (1, "response", "200"), (1, "hello", "h"), (2, "close", "reset")}
    rows = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "id int, n int, t string")
    fresh = tables.overlay(rows, spark.createDataFrame([(2, 9)], "id int, n int"), ["id"]).orderBy("id").collect()
    assert [(r.n, r.t) for r in fresh] == [(5, "a"), (9, "b")]


def test_report_exports_and_comparison(spark):
    frame = spark.createDataFrame([(1, "a", None), (2, 'b,"c"', 0.5)], "id int, t string, x double")
    document = sinks.report({"rows": frame})
    assert json.loads(sinks.to_json(document))["rows"]["count"] == 2
    with zipfile.ZipFile(io.BytesIO(sinks.csv_zip({"t": frame}))) as z:
        assert z.read("t.csv").decode().splitlines()[1:] == ["1,a,", '2,"b,""c""",0.5']
    items = [{"id": "n", "metric": "$.rows.count", "check": {"equals": 2}}, {"id": "x", "metric": "$.rows.rows[1].x", "expected": 0.52, "check": {"rel_tol_pct": 5}}, {"id": "gone", "metric": "$.nope", "check": {"max": 3}}]
    assert [i["passed"] for i in sinks.compare_reference(document, items)] == [True, True, False]
    other = sinks.report({"rows": frame.withColumn("x", F.lit(0.7))})
    diff = sinks.compare_runs(document, other, limit=1)
    assert diff["count"] == 2 and len(diff["differences"]) == 1
    with pytest.raises(ValueError):
        sinks.check(1, 2, {"max": 1, "min": 0})


def test_topology_rules_and_order(spark):
    points = tuple(Point(p, f"s{p}") for p in "abc")
    t = Topology(points, ("a", "b", "c"))
    assert t.segments()[0] == ("forward", "a", "b") and t.precedes("c", "a", "reverse") and t.path("reverse") == ("c", "b", "a")
    for bad in ({"forward": ("a", "a")}, {"forward": ("z",)}, {"forward": ("a",), "client_cidrs": ()}, {"forward": ("a",), "stall_ms": 0}, {"forward": ("a",), "start_us": 5, "end_us": 5}):
        with pytest.raises(ValueError):
            Topology(points, **bad)
    with pytest.raises(ValueError):
        Topology((Point("a", "s", "d", "egress"), Point("b", "s", "d", "ingress")), ("a", "b"))
    rows = [{"direction": "forward", "p": p, "q": q, "n": 9, "ttl_step": s, "gap_us": 0} for p, q, s in (("a", "b", 1), ("a", "c", -1), ("b", "c", -2))]
    assert order_points(rows) == (["c", "a", "b"], None)
    assert order_points([*rows[:2], rows[2] | {"ttl_step": 2}])[1] == "the order has a cycle"
    assert order_points(rows[:2])[1]
    recs = spark.createDataFrame([("sa", 0, 1, 5, "f"), ("sb", 0, 2, 6, "f"), ("zz", 0, 3, 7, "f"), ("sa", 0, 4, 8, "g")], "source string, iface int, row_id int, t_us int, flow string")
    seen = select_observations(recs, t)
    assert seen.count() == 3 and overlapping(seen).count() == 0
    kept, gone = restrict_scope(seen)
    assert kept.count() == 2 and gone == {"flows": 1, "rows": 1}
    flows = spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 2), ("s2", 3), ("s4", 3)], "source string, flow int")
    assert {r.source: r.component for r in group_sources(flows).collect()} == {"s1": "s1", "s2": "s1", "s4": "s1", "s3": "s3"}
    syn = spark.createDataFrame([("10.0.0.1", "9.9.9.9", 2), ("9.9.9.9", "10.0.0.1", 18)], "src string, dst string, flags int")
    assert {r.network: r.client for r in client_networks(syn).collect()} == {"10.0.0": True, "9.9.9": False}
