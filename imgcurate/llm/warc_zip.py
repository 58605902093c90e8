"""WARC records in ZIP packages: written, located by their directories and indexes, read by range.

A package is a ZIP file with stored (not deflated) members: ``archive/*.warc.gz`` of records
that are compressed one by one, and ``indexes/index.cdxj`` with a line for each record: its id,
member, offset and length. Reading parses the central directory at the end of the file (and
the ZIP64 records where there are any), finds the data of stored members behind their local
headers, reads the index, and then fetches records by their byte ranges. Nothing is unpacked.

Packages lie in any file system that ``pyarrow.fs`` opens by URI. Tasks write under names of
their own, and what they report to Spark says which packages count; a task that runs again
leaves at most an unreported file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgcurate.session import scratch_path, written

from .arrow import slices
from .registry import query, table

#: Bytes of compressed records in a member, and of members in a package, about.
MEMBER_BYTES = 4 << 20
PACKAGE_BYTES = 64 << 20
#: Records of neighbouring ranges are fetched together up to so many bytes.
FETCH_BYTES = 2 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- Records


def record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    """A compressed response, or a revisit that keeps the headers and leaves the payload to the record it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>"]
    head += [f"WARC-Target-URI: {clean(uri)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


@dataclass(frozen=True)
class Read:
    record_id: str
    uri: str
    kind: str
    refers_to: str | None
    digest: str
    payload: bytes | None
    payload_bytes: int


def parse_record(packed: bytes) -> Read:
    """A record from its compressed bytes. A response's digest is checked, a revisit's length is that of its headers."""
    data = zlib.decompress(packed, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    refers = fields.get("warc-refers-to")
    strip = lambda v: v[1:-1]
    return Read(strip(fields["warc-record-id"]), fields["warc-target-uri"], kind, refers and strip(refers), digest, payload if kind == "response" else None, length)


# --- Packages


class PackageWriter:
    """A ZIP file of stored members, written front to back. ``zip64`` forces ZIP64 records, which are otherwise written where needed."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.entries = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.zip64 or len(data) >= LIMIT32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        size = LIMIT32 if big else len(data)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.entries:
            big = [v for v in (size, size, at) if self.zip64 or v >= LIMIT32]
            extra = struct.pack("<HH", 1, 8 * len(big)) + b"".join(struct.pack("<Q", v) for v in big) if big else b""
            low = lambda v: LIMIT32 if self.zip64 or v >= LIMIT32 else v
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, low(size), low(size), len(raw), len(extra), 0, 0, 0, 0, low(at)) + raw + extra
            )
        size, count = self.at - start, len(self.entries)
        big = self.zip64 or start >= LIMIT32 or count >= LIMIT16
        if big:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
        short, low = (LIMIT16 if big else count), (lambda v: LIMIT32 if big else v)
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, short, short, low(size), low(start), 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def read_directory(source) -> list[Member]:
    """The members of a ZIP file from its central directory, with sizes and offsets from ZIP64 fields where these are used."""
    size = source.size()
    tail_at = max(0, size - LIMIT16 - 22 - 20)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # A comment may hold the signature too; the right one ends with the file.
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == LIMIT16 or LIMIT32 in (length, start)):
        at = struct.unpack_from("<Q", tail, end - 12)[0]
        record64 = source.read_at(56, at)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    data, members, at = source.read_at(length, start), [], 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method, packed, whole = struct.unpack_from("<H", data, at + 10)[0], *struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                numbers = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole = next(numbers) if whole == LIMIT32 else whole
                packed = next(numbers) if packed == LIMIT32 else packed
                header = next(numbers) if header == LIMIT32 else header
            extra = extra[4 + n :]
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_comment
    return members


def data_offset(source, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose extra field may differ from the directory's."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("a damaged local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


# --- Spark


def write_packages(records: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES, member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """``(package, records)``: packages written from ``(record_id, uri, payload, refers_to)``, one or more a partition.

    A null ``refers_to`` makes a response, other records are revisits. A null payload is empty,
    a null URI too. Records hold at most a member's bytes in memory besides themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        state: dict = {}

        def start() -> None:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            sink = system.open_output_stream(name)
            state.update(name=name, sink=sink, zip=PackageWriter(sink, zip64), index=[], held=[], bytes=0, members=0)

        def end_member() -> None:
            if state["held"]:
                state["zip"].add(f"archive/data-{state['members']:05d}.warc.gz", b"".join(state["held"]))
                state.update(held=[], bytes=0, members=state["members"] + 1)

        def end() -> None:
            end_member()
            lines = "".join(json.dumps({"id": i, "filename": m, "offset": at, "length": n}) + "\n" for i, m, at, n in state["index"])
            state["zip"].add("indexes/index.cdxj", lines.encode())
            state["zip"].close()
            state["sink"].close()
            done.append((state["name"], len(state["index"])))
            state.clear()

        for batch in batches:
            for part in slices(batch, "payload"):
                rows = part.to_pydict()
                for record_id, uri, payload, refers in zip(rows["record_id"], rows["uri"], rows["payload"], rows["refers_to"], strict=True):
                    if not state:
                        start()
                    made = record(record_id, uri or "", payload or b"", refers)
                    state["index"].append((record_id, f"data-{state['members']:05d}.warc.gz", state["bytes"], len(made)))
                    state["held"].append(made)
                    state["bytes"] += len(made)
                    if state["bytes"] >= member_bytes:
                        end_member()
                    if state["zip"].at >= package_bytes:
                        end()
        if state:
            end()
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["package", "records"])

    wanted = records.select("record_id", "uri", F.col("payload").cast("binary").alias("payload"), "refers_to")
    return written(wanted.mapInArrow(run, "package string, records long"), "packages")


def locate(packages: DataFrame) -> DataFrame:
    """``(package, at, length)``: the byte range of each record, from the indexes of the packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("package").to_pylist():
                system, path = opened(name)
                with system.open_input_file(path) as source:
                    members = {m.name: m for m in read_directory(source)}
                    starts = {n.rpartition("/")[2]: data_offset(source, m) for n, m in members.items() if n.startswith("archive/")}
                    at, length = [], []
                    for m in members.values():
                        if m.name.startswith("indexes/"):
                            for line in source.read_at(m.size, data_offset(source, m)).decode().splitlines():
                                entry = json.loads(line)
                                at.append(starts[entry["filename"]] + entry["offset"])
                                length.append(entry["length"])
                for a in range(0, len(at), 10_000):
                    some = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at[some])), pa.array(at[some], pa.int64()), pa.array(length[some], pa.int64())], names=["package", "at", "length"])

    return packages.select("package").mapInArrow(run, "package string, at long, length long")


def fetch(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the given ranges: id, URI, type, what it refers to, digest, length and, if wanted, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, name = None, None

        def read(at: int, stop: int, group: list[tuple[int, int]]) -> pa.RecordBatch:
            data = source.read_at(stop - at, at)
            made = [parse_record(data[a - at : a - at + n]) for a, n in group]
            columns = [pa.array([getattr(r, f) for r in made], t) for f, t in (("record_id", pa.string()), ("uri", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()))]
            names = ["record_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes"]
            if payloads:
                columns.append(pa.array([r.payload for r in made], pa.binary()))
                names.append("payload")
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            group: list[tuple[int, int]] = []
            low = high = 0
            for package, at, length in zip(*(batch.column(c).to_pylist() for c in ("package", "at", "length")), strict=True):
                if package != name or not group or at != high or high - low >= FETCH_BYTES:
                    if group:
                        yield read(low, high, group)
                    if package != name:
                        if source is not None:
                            source.close()
                        system, path = opened(package)
                        source, name = system.open_input_file(path), package
                    group, low = [], at
                group.append((at, length))
                high = at + length
            if group:
                yield read(low, high, group)
        if source is not None:
            source.close()

    kind = "record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long" + ", payload binary" * payloads
    # A package's ranges are dealt in stretches, so that a large package is read by many tasks.
    dealt = ranges.repartition("package", F.floor(F.col("at") / (8 * FETCH_BYTES))).sortWithinPartitions("package", "at")
    return dealt.mapInArrow(run, kind)


def with_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """``(id, uri, payload)`` with ``refers_to``: the smallest id of an equal payload of ``least`` bytes or more.

    It is null for that record itself, for shorter payloads, and for rows without an id.
    Repeated rows of the smallest id all stand for themselves. Only digests and ids are
    grouped; payloads meet the repeated digests in a join that is split where a digest is hot.
    """
    rows = records.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.when(F.length("payload") >= least, F.unhex(F.sha1("payload"))))
    first = rows.where("sha1 is not null and id is not null").groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = written(first.where("first != last").select("sha1", "first"), "repeated")
    return rows.join(first, "sha1", "left").select("id", "uri", "payload", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))


ID = "urn:x-record:"

B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p), b AS (
  SELECT *, list_reduce(list_transform(range(0, 40), lambda i: format('{{:04b}}', ('0x' || digest[i + 1])::INT)), lambda x, y: x || y) AS bits FROM f
)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: '{B32}'[1 + list_sum(list_transform(range(0, 5), lambda j: bits[5 * i + j + 1]::INT * (16 >> j)))::INT]), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = first_id OR page_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""


@query("op1_warc_zip", SQL)
def op1_warc_zip(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    name = lambda c: F.concat(F.lit(ID), F.col(c).cast("string"))
    records = with_revisits(pages).select(F.coalesce(name("id"), F.lit(ID)).alias("record_id"), "uri", "payload", name("refers_to").alias("refers_to"))
    packages = write_packages(records, scratch_path(spark, "warc"))
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(ID) + 1}) as bigint)")
    read = fetch(locate(packages), payloads=False)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
