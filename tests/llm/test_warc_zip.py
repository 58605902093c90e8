"""Packages against Python's own ZIP reader, and round trips of pages."""

import base64
import gzip
import hashlib
import io
import zipfile

import duckdb
import pyarrow as pa
import pytest

from imgcurate.llm.queries import ORACLES, QUERIES
from imgcurate.llm.warc_zip import PackageWriter, data_offset, fetch, locate, parse_record, read_directory, record, with_revisits, write_packages


@pytest.mark.parametrize("zip64", [False, True])
def test_own_packages_are_zip_files(zip64):
    sink = io.BytesIO()
    writer = PackageWriter(sink, zip64)
    members = {"archive/a.warc.gz": b"abc" * 1000, "indexes/index.cdxj": b"", "é": b"x"}
    for name, data in members.items():
        writer.add(name, data)
    writer.close()
    with zipfile.ZipFile(io.BytesIO(sink.getvalue())) as z:
        assert {n: z.read(n) for n in z.namelist()} == members and z.testzip() is None
    source = pa.BufferReader(sink.getvalue())
    assert {m.name: source.read_at(m.size, data_offset(source, m)) for m in read_directory(source)} == members


@pytest.mark.parametrize("many, comment", [(3, b""), (70_000, b""), (3, b"PK\x05\x06 is a signature" + b"." * 30)])
def test_foreign_zip_files_are_read(many, comment):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for i in range(many):
            with z.open(zipfile.ZipInfo(f"m{i}"), "w", force_zip64=i % 2 == 0) as f:
                f.write(b"%d" % i)
        z.comment = comment
    source = pa.BufferReader(made.getvalue())
    found = read_directory(source)
    assert len(found) == many
    for m in (found[0], found[1], found[-1]):
        assert source.read_at(m.size, data_offset(source, m)) == m.name[1:].encode()


def test_damage_is_told():
    with pytest.raises(ValueError, match="central directory"):
        read_directory(pa.BufferReader(b"no zip file"))
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    source = pa.BufferReader(made.getvalue())
    with pytest.raises(ValueError, match="not stored"):
        data_offset(source, read_directory(source)[0])
    wrong = gzip.compress(gzip.decompress(record("urn:1", "u", b"payload", None)).replace(b"payload", b"Payload"))
    with pytest.raises(ValueError, match="damaged"):
        parse_record(wrong)


def test_round_trip(spark, tmp_path):
    rows = [(f"urn:{i}", f"http://h/{i}", bytes([i % 256]) * (i * 37 % 5000), "urn:0" if i % 7 == 3 else None) for i in range(500)]
    rows += [("urn:null", None, None, None), ("urn:crlf", "http://h/\r\nX: y", b"\r\n\r\na\r\n\r\n", None), ("urn:long", "u", b"z" * 3_000_000, None)]
    df = spark.createDataFrame(rows, "record_id string, uri string, payload binary, refers_to string").repartition(3)
    packages = write_packages(df, str(tmp_path / "p"), zip64=True, package_bytes=20_000, member_bytes=5_000)
    assert packages.count() > 3 and packages.agg({"records": "sum"}).first()[0] == len(rows)
    for p in packages.collect():
        with zipfile.ZipFile(p.package) as z:
            assert z.testzip() is None and len(z.namelist()) > 1
    got = {r.record_id: r for r in fetch(locate(packages)).collect()}
    assert len(got) == len(rows)
    for i, uri, payload, refers in rows:
        r, payload = got[i], payload or b""
        assert (r.refers_to, r.record_type) == (refers, "revisit" if refers else "response")
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r.payload == (None if refers else payload)
        assert r.uri == (uri or "").replace("\r\n", "%0D%0A")


def test_shorter_payloads_are_never_revisits(spark):
    rows = [(3, "a", b"xy"), (1, "b", b"xy"), (2, "c", b"x"), (4, "d", b"x"), (5, "e", None), (6, "f", b"")]
    df = spark.createDataFrame(rows, "id long, uri string, payload binary")
    pairs = lambda least: {(r.id, r.refers_to) for r in with_revisits(df, least).collect() if r.refers_to}
    assert pairs(2) == {(3, 1)}
    assert pairs(0) == {(3, 1), (4, 2), (6, 5)}


def test_odd_pages_against_sql(spark, tmp_path):
    rows = [(2, "u", "é"), (1, None, "é"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, None, None), (None, "x", "é"), (9, "u", "w" * 2_000_000)]
    spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, QUERIES["op1_warc_zip"](spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    result = con.execute(ORACLES["op1_warc_zip"])
    assert [d[0] for d in result.description] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got == sorted(result.fetchall(), key=str)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op1_warc_zip"](spark, str(tmp_path)).count() == 0
