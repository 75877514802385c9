import struct

from pyspark.sql import functions as F

from hopscope.operators import privacy
from hopscope.sources import containers, tables

from .test_sources import packet


def checksum(raw):
    raw += b"\0" * (len(raw) % 2)
    return ~privacy._carry(sum(struct.unpack(f">{len(raw) // 2}H", raw))) & 0xFFFF


def with_checksums(data):
    out = bytearray(data)
    out[24:26] = checksum(bytes(out[14:34])).to_bytes(2, "big")
    tcp = bytes(out[34:])
    out[50:52] = checksum(bytes(out[26:34]) + struct.pack(">HH", 6, len(tcp)) + tcp).to_bytes(2, "big")
    return bytes(out)


def valid(data):
    tcp = data[34:]
    return checksum(data[14:34]) == 0, checksum(data[26:34] + struct.pack(">HH", 6, len(tcp)) + tcp) == 0


def test_records_keep_their_checksums_state(spark):
    good = with_checksums(packet(5, payload=b"secret!"))
    bad = bytearray(good)
    bad[24] ^= 1
    bad[50] ^= 1
    rows = [good, bytes(bad), good[:40], b"\0" * 60, None]
    frame = spark.createDataFrame([(None if r is None else bytearray(r),) for r in rows], "d binary").withColumn("a", privacy.anonymise_records(F.col("d"), b"k"))
    out = [None if r.a is None else bytes(r.a) for r in frame.collect()]
    assert valid(good) == (True, True) and valid(out[0]) == (True, True) and valid(out[1]) == (False, False)
    assert out[2:] == [None, None, None]
    assert b"secret" not in out[0] and len(out[0]) == len(good)
    before, after = containers.headers(good, 1), containers.headers(out[0], 1)
    assert after["src"] == privacy.map_address(before["src"], b"k") != before["src"]
    assert {k: before[k] for k in ("sport", "seq", "flags", "ttl", "ipid", "length")} == {k: after[k] for k in ("sport", "seq", "flags", "ttl", "ipid", "length")}


def test_layers_and_fields(spark):
    nested = '[{"proto":"gre","src":"a","dst":"b"},{"proto":"tcp","src":"c","dst":"d","sport":1,"dport":2,"length":9}]'
    lines = spark.createDataFrame([("s", 1, nested), ("s", 2, '[{"proto":"udp","src":"x","dst":"y","length":4}]'), ("s", 3, "[]")], "source string, row_id int, value string")
    layers = tables.layer_rows(lines)
    assert {(r.row_id, r.role, r.src) for r in layers.collect()} == {(1, "outer", "a"), (1, "inner", "c"), (2, "plain", "x")}
    rows = spark.createDataFrame([("s", 1, "a", 50), ("s", 3, "q", 7)], "source string, row_id int, src string, length int")
    inner = layers.select("source", "row_id", "role", "src", "length")
    assert {r.row_id: (r.src, r.length) for r in tables.choose_layer(rows, inner, "inner").collect()} == {1: ("c", 9), 3: ("q", 7)}
    decoded = spark.createDataFrame([("s", 1, "ntp", '{"stratum":"2"}'), ("s", 2, "sip", '{"method":"BYE"}')], "source string, row_id int, proto string, value string")
    got = {r.row_id: (r.ntp_stratum, r.sip_method) for r in tables.protocol_fields(decoded, {"ntp": ["stratum"], "sip": ["method"]}).collect()}
    assert got == {1: ("2", None), 2: (None, "BYE")}
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, None)], "id int, fields map<string,string>")
    new = spark.createDataFrame([(1, {"b": "9", "c": "3"}), (2, {"d": "4"})], "id int, fields map<string,string>")
    assert {r.id: r.fields for r in tables.merged_fields(old, new, ["id"]).collect()} == {1: {"a": "1", "b": "9", "c": "3"}, 2: {"d": "4"}}
