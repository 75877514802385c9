import io
import zipfile

import pytest

from hopscope.llm import warc_zip


def test_directory_of_other_writers():
    for force in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in (("a.txt", b"alpha"), ("ü/b.bin", bytes(range(256)))):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=force) as m:
                    m.write(body)
            z.writestr(zipfile.ZipInfo("c"), b"zip", zipfile.ZIP_DEFLATED)
            z.comment = b"PK\x05\x06 in a comment"
        package = warc_zip.Package(out)
        assert package.read(*package.locate("ü/b.bin")) == bytes(range(256)) and package.read(*package.locate("a.txt")) == b"alpha"
        with pytest.raises(ValueError):
            package.locate("c")
    with pytest.raises(ValueError):
        warc_zip.Package(io.BytesIO(b"no archive"))


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(5):
            z.writestr(zipfile.ZipInfo(f"m{k}"), bytes([k]) * 90)
    assert b"PK\x06\x06" in out.getvalue()
    package = warc_zip.Package(out)
    assert [package.read(*package.locate(f"m{k}")) for k in range(5)] == [bytes([k]) * 90 for k in range(5)]


def test_round_trip_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "READ_BYTES", 500)
    rows = [(4, "http://a/\r\nb", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (7, "u", ""), (5, "x", "long " * 50_000), (5, "x", "long " * 50_000), (None, "n", "<p>é</p>"), (1, "z", "a\r\n\r\nb")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    packages = warc_zip.write_packages(pages)
    assert sum(r.records for r in packages.collect()) == len(rows)
    got = warc_zip.read_packages(packages, payloads=True).collect()
    assert len(got) == len(rows)
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == sorted(
        [(4, "revisit", 2), (2, "response", 0), (9, "revisit", 7), (7, "response", 0), (5, "response", 0), (5, "response", 0), (0, "revisit", 2), (1, "response", 0)]
    )
    texts = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc_zip.payload_digest(body))
        assert r.payload == (bytes(body) if r.record_type == "response" else None)
    assert warc_zip.read_packages(warc_zip.write_packages(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc_zip.read_packages(warc_zip.write_packages(pages, min_bytes=10**9)).collect()} == {"response"}
