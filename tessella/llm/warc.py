"""Web archives in ZIP packages: writing, and reading single records by range without extracting.

A package is a ZIP file of stored (uncompressed) members: ``archive/*.warc.gz`` hold the WARC records, each a gzip
member of its own, and ``indexes/index.cdxj`` has a line per record with its place. As members are stored, a
record lies at a known range of the package: the reader fetches the end of the file, follows the ZIP64 locator
if there is one, parses the central directory, reads the index and then only the ranges it wants.

Writing is a Spark job whose tasks each stream their records into packages in a shared folder. A task names its
packages at random and returns their names; the written manifest has those of the tasks that were committed, so
tasks that are run again or twice leave nothing that is read.

Records of equal payloads: the one of the smallest key is the ``response``, the others are ``revisit`` records that
refer to it and hold its digest and length but no payload. Groups of equal payloads are found on digests (two columns
move). Large groups have their winners sent to all tasks (there are fewer than ``HOT_SHARE``), so their payloads
are not shuffled at all; the rest meet their winner by a join.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize, text_batches
from tessella.session import shared_dir

#: A digest is hot if it has more than ``HOT_LEAST`` rows and more than one in ``HOT_SHARE`` of all.
HOT_LEAST, HOT_SHARE = 100, 10_000
#: Size at which a task begins another member, and another package.
MEMBER_BYTES, PACKAGE_BYTES = 64 << 20, 512 << 20
#: Ranges of one package that follow each other are read together, up to this size; a task reads about TASK_BYTES.
READ_BYTES, TASK_BYTES = 4 << 20, 32 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "indexes/index.cdxj"
MANIFEST = "package string, bytes bigint, records bigint"
PLACES = "package string, member string, offset bigint, length bigint"
RECORDS = "record_id string, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to string, payload binary"

# Signatures and layouts of ZIP structures.
_END = struct.Struct("<4s4H2LH")  # PK\5\6: disks, entries, directory size and offset, comment length
_END64_LOCATOR = struct.Struct("<4sLQL")  # PK\6\7: disk, offset of the ZIP64 end record, disks
_END64 = struct.Struct("<4sQ2H2L4Q")  # PK\6\6: size, versions, disks, entries, directory size and offset
_ENTRY = struct.Struct("<4s6H3L5H2L")  # PK\1\2
_LOCAL = struct.Struct("<4s5H3L2H")  # PK\3\4
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _uri(url: str) -> str:
    """Control characters and spaces would break the header; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(record_id: str, url: str | None, digest: str, n_bytes: int, payload: bytes | None, refers_to: str | None, date: str = DATE) -> bytes:
    """One WARC record as a gzip member. With ``refers_to`` it is a revisit, which keeps the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "WARC-Profile": PROFILE if refers_to is not None else None,
        "WARC-Refers-To": f"<{refers_to}>" if refers_to is not None else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> dict[str, Any]:
    """What ``record`` wrote; ValueError if lengths or digests do not hold."""
    text = gzip.decompress(data)
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record: its length does not hold")
    of = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    if fields["WARC-Block-Digest"] != of(block):
        raise ValueError("damaged record: its block digest does not hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind == "response" and (fields["WARC-Payload-Digest"] != of(payload) or int(stated["Content-Length"]) != len(payload)):
        raise ValueError("damaged record: its payload digest does not hold")
    refers = fields.get("WARC-Refers-To")
    return {
        "record_id": fields["WARC-Record-ID"][1:-1],
        "record_type": kind,
        "url": fields.get("WARC-Target-URI"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(stated["Content-Length"]),
        "refers_to": refers[1:-1] if refers else None,
        "payload": payload if kind == "response" else None,
    }


class _Package:
    """A ZIP package under way: one member at a time, the index at the end."""

    def __init__(self, target: fs.FileSystem, path: str):
        self.sink = target.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.lines: list[str] = []
        self.member, self.name, self.at, self.bytes = None, "", 0, 0

    def add(self, key: str, data: bytes, member_bytes: int) -> None:
        if self.member is None or self.at >= member_bytes:
            self._end_member()
            self.name = f"archive/data-{len(self.zip.namelist()):05d}.warc.gz"
            self.member, self.at = self.zip.open(zipfile.ZipInfo(self.name), "w", force_zip64=True), 0
        self.member.write(data)
        self.lines.append(f"{key} {json.dumps({'offset': self.at, 'length': len(data), 'filename': self.name.removeprefix('archive/')})}")
        self.at += len(data)
        self.bytes += len(data)

    def _end_member(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def close(self) -> int:
        self._end_member()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(line + "\n" for line in self.lines))
        self.zip.close()
        size = self.sink.tell()
        self.sink.close()
        return size


def write_packages(records: DataFrame, folder: str, member_bytes: int = MEMBER_BYTES, package_bytes: int = PACKAGE_BYTES, date: str = DATE) -> DataFrame:
    """Manifest (package, bytes, records) of the packages that hold ``records(record_id, url, sha1, payload_bytes, payload, refers_to)``.

    ``folder`` is a path that all executors share, of a scheme pyarrow opens. A task streams its rows: it holds
    one record and the index lines of one package. Other columns are ignored; no rows give an empty manifest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        package, path = None, ""

        def ended() -> pd.DataFrame:
            return pd.DataFrame({"package": [path], "bytes": [package.close()], "records": [len(package.lines)]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if package is not None and package.bytes >= package_bytes:
                    yield ended()
                    package = None
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path, package = f"{folder}/{name}", _Package(target, f"{root}/{name}")
                data = record(row.record_id, row.url, base32(row.sha1), row.payload_bytes, row.payload, row.refers_to, date)
                package.add(row.record_id, data, member_bytes)
        if package is not None:
            yield ended()

    columns = ("record_id", "url", "sha1", "payload_bytes", "payload", "refers_to")
    return materialize(records.select(*columns).mapInPandas(run, MANIFEST))


class ZipDirectory:
    """Members of a ZIP file that is open for reading at any place: name, method, sizes and where the data begin."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        tail_at = max(0, self.size - _END.size - _FULL16 - _END64_LOCATOR.size)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + _END.size > len(tail) or end + _END.size + _END.unpack_from(tail, end)[-1] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature may also occur within the comment
        if end < 0:
            raise ValueError("not a ZIP file: it has no end record")
        _, _, _, _, entries, length, offset, _ = _END.unpack_from(tail, end)
        if end >= _END64_LOCATOR.size and tail[end - _END64_LOCATOR.size :].startswith(b"PK\x06\x07"):
            at = _END64_LOCATOR.unpack_from(tail, end - _END64_LOCATOR.size)[2]
            far = _END64.unpack(self.read(at, _END64.size))
            if far[0] != b"PK\x06\x06":
                raise ValueError("damaged ZIP file: no ZIP64 end record where its locator points")
            entries, length, offset = far[7:10]
        elif entries == _FULL16 or _FULL32 in (length, offset):
            raise ValueError("damaged ZIP file: it needs a ZIP64 end record")
        self.members = self._entries(self.read(offset, length), entries)

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("damaged ZIP file: it ends too early")
        return data

    @staticmethod
    def _entries(data: bytes, count: int) -> list[dict[str, Any]]:
        out, at = [], 0
        for _ in range(count):
            e = _ENTRY.unpack_from(data, at)
            if e[0] != b"PK\x01\x02":
                raise ValueError("damaged ZIP directory")
            flags, method, packed, size, n_name, n_extra, n_comment, offset = e[3], e[4], e[8], e[9], e[10], e[11], e[12], e[16]
            at += _ENTRY.size
            name = data[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, at = data[at + n_name : at + n_name + n_extra], at + n_name + n_extra + n_comment
            place = 0
            while place + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, place)
                if kind == 1:  # ZIP64: the numbers that did not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                    size = next(wide) if size == _FULL32 else size
                    packed = next(wide) if packed == _FULL32 else packed
                    offset = next(wide) if offset == _FULL32 else offset
                place += 4 + n
            out.append({"name": name, "method": method, "packed": packed, "size": size, "offset": offset})
        return out

    def start(self, member: dict[str, Any]) -> int:
        """Where the member's data begin: behind its local head, whose extra field differs from the directory's."""
        local = _LOCAL.unpack(self.read(member["offset"], _LOCAL.size))
        if local[0] != b"PK\x03\x04":
            raise ValueError("damaged ZIP file: no member where its directory points")
        return member["offset"] + _LOCAL.size + local[-2] + local[-1]

    def content(self, member: dict[str, Any]) -> bytes:
        """A small member as a whole, stored or deflated."""
        raw = self.read(self.start(member), member["packed"])
        raw = raw if member["method"] == 0 else zlib.decompress(raw, -15)
        return gzip.decompress(raw) if member["name"].endswith(".gz") else raw


def _scan(directory: ZipDirectory, start: int, length: int) -> Iterator[tuple[int, int]]:
    """Places of the gzip members of a WARC member without an index, read in pieces."""
    at = begun = start
    inflate = zlib.decompressobj(31)
    while at < start + length:
        piece = directory.read(at, min(READ_BYTES, start + length - at))
        while piece:
            inflate.decompress(piece)
            at += len(piece) - len(inflate.unused_data)
            if not inflate.eof:
                break
            yield begun, at - begun
            begun, piece, inflate = at, inflate.unused_data, zlib.decompressobj(31)


def places(file) -> Iterator[tuple[str, int, int]]:
    """(member, offset in the package, length) of every record of an open package, by its index, or by a scan of
    the members that no index names."""
    directory = ZipDirectory(file)
    archives = {m["name"].removeprefix("archive/"): m for m in directory.members if re.fullmatch(r"archive/.*\.warc(\.gz)?", m["name"])}
    for m in archives.values():
        if m["method"] != 0:
            raise ValueError(f"{m['name']} is compressed as a whole: its records have no range of their own")
    starts = {name: directory.start(m) for name, m in archives.items()}
    named = set()
    for m in directory.members:
        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m["name"]):
            for line in directory.content(m).decode().splitlines():
                place = json.loads(line[line.index("{") :])
                named.add(place["filename"])
                yield place["filename"], starts[place["filename"]] + int(place["offset"]), int(place["length"])
    for name in archives.keys() - named:
        for at, length in _scan(directory, starts[name], archives[name]["packed"]):
            yield name, at, length


def locate(manifest: DataFrame) -> DataFrame:
    """(package, member, offset, length) of every record in the packages of ``manifest(package, ...)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for package in pdf["package"]:
                source, path = fs.FileSystem.from_uri(package)
                with source.open_input_file(path) as file:
                    rows = [(package, *place) for place in places(file)]
                yield pd.DataFrame(rows, columns=["package", "member", "offset", "length"])

    return manifest.select("package").mapInPandas(run, PLACES)


def read_records(located: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``located(package, offset, length)``: record_id, record_type, url, payload_digest, payload_bytes,
    refers_to, payload (null for revisits, and for all if ``payloads`` is off; digests are checked all the same).

    Places are dealt by ranges, so a large package is read by many tasks; each reads runs of neighbouring records. The number
    of tasks follows from the bytes to read, of which the places themselves say nothing.
    """

    def parsed(source: fs.FileSystem, path: str, run: list[tuple[int, int]]) -> list[dict[str, Any]]:
        with source.open_input_file(path) as file:
            file.seek(run[0][0])
            data = file.read(run[-1][0] + run[-1][1] - run[0][0])
        made = [parse_record(data[at - run[0][0] : at - run[0][0] + n]) for at, n in run]
        return made if payloads else [r | {"payload": None} for r in made]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for package, rows in pdf.groupby("package", sort=False):
                source, path = fs.FileSystem.from_uri(package)
                held: list[tuple[int, int]] = []
                for at, n in zip(rows["offset"], rows["length"]):
                    at, n = int(at), int(n)
                    if held and (at != held[-1][0] + held[-1][1] or at + n - held[0][0] > READ_BYTES):
                        yield pd.DataFrame(parsed(source, path, held))
                        held = []
                    held.append((at, n))
                yield pd.DataFrame(parsed(source, path, held))

    located = materialize(located.select("package", "offset", "length"))
    tasks = 1 + (located.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    dealt = located.repartitionByRange(tasks, "package", "offset").sortWithinPartitions("package", "offset")
    return dealt.mapInPandas(run, RECORDS)


def with_revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", prefix: str = "urn:x-page:", least_bytes: int = 0) -> DataFrame:
    """Records of ``pages(key, url, payload, ...)`` as ``write_packages`` takes them.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest key are responses, and the others
    refer to it. A null payload is empty; a null key is larger than any other, and rows of a group without any
    key are all responses; repeated rows of the smallest key are all responses. Equal means equal SHA-256 digests.
    Other columns are ignored, whatever their names; an empty table gives no records.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).cast("string").alias("url"), data.alias("payload")).withColumn("_sha", F.sha2("payload", 256))
    short = materialize(rows.where(F.octet_length("payload") >= least_bytes).select("_key", "_sha"))
    hot_rows = max(HOT_LEAST, short.count() // HOT_SHARE)
    groups = materialize(short.groupBy("_sha").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col("_first").isNotNull()))
    hot = groups.where(F.col("_n") > hot_rows).select("_sha", F.col("_first").alias("_hot"))
    cold = groups.where(F.col("_n") <= hot_rows).select(F.col("_sha").alias("_group"), F.col("_first").alias("_cold"))
    met = rows.join(F.broadcast(hot), "_sha", "left")
    # Rows of hot groups have their winner already: they are dealt by their own key, and revisits without payload.
    again = lambda c: c.isNotNull() & ~F.col("_key").eqNullSafe(c)
    size, sha1 = F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1")
    met = met.select(
        "_key", "url", size, sha1, "_hot", F.when(~again(F.col("_hot")), F.col("payload")).alias("payload"),
        F.when(F.col("_hot").isNull(), F.col("_sha")).otherwise(F.concat(F.lit("hot "), F.coalesce(F.col("_key").cast("string"), F.lit("")))).alias("_group"),
    )
    first = F.coalesce("_hot", "_cold")
    name = lambda c: F.concat(F.lit(prefix), F.coalesce(c.cast("string"), F.lit("")))
    return met.join(cold, "_group", "left").select(
        name(F.col("_key")).alias("record_id"), "url", "sha1", "payload_bytes",
        F.when(~again(first), F.col("payload")).alias("payload"), F.when(again(first), name(first)).alias("refers_to"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_packages(with_revisits(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    number = lambda c: F.regexp_replace(c, "^urn:x-page:", "").try_cast("bigint")
    read = read_records(locate(manifest), payloads=False)
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
