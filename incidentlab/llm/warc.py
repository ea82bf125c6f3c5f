"""Web archives in ZIP packages: written by tasks, read back by ranges without extraction.

A package holds one stored member of gzip-compressed WARC records, each compressed by itself, and
one stored index of their places. The reader parses the end record, its ZIP64 form and the central
directory, finds the members' data behind their local headers, cuts the index into ranges and lets
tasks read and parse the records of a range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
LEAST_REVISIT = 1000
MAX_PACKAGE = 256 << 20
RANGE = 4 << 20
#: Bytes of packages that one task reads.
TASK_BYTES = 8 << 20


# ---- ZIP directories

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # place of the local header


def members(file, size: int) -> list[Member]:
    """Members of a ZIP file, from its central directory; ``file`` has seek and read."""

    def at(place: int, length: int) -> bytes:
        file.seek(place)
        return file.read(length)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20:end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    locator_at = tail_at + end - 20
    locator = at(locator_at, 20) if locator_at >= 0 else b""
    if locator[:4] == b"PK\6\7":
        wide = at(int.from_bytes(locator[8:16], "little"), 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, found, p = at(start, length), [], 0
    for _ in range(count):
        if directory[p:p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", directory[p + 8:p + 12])
        packed, full, n, x, c = struct.unpack("<IIHHH", directory[p + 20:p + 34])
        header = int.from_bytes(directory[p + 42:p + 46], "little")
        name = directory[p + 46:p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = directory[p + 46 + n:p + 46 + n + x], 0
        while e + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[e:e + 4])
            if kind == 1:  # 64-bit values, in this order, for the fields that are all ones
                wide = list(struct.unpack(f"<{width // 8}Q", extra[e + 4:e + 4 + width // 8 * 8]))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + width
        found.append(Member(name, method, packed, header))
        p += 46 + n + x + c
    return found


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed by the package; ranges need it stored")
    file.seek(member.header)
    local = file.read(30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header for {member.name}")
    n, x = struct.unpack("<HH", local[26:30])
    return member.header + 30 + n + x


def places(file, size: int) -> list[tuple[int, int]]:
    """Place and length in the package of every record that its indexes list, in order.

    All members below archive/ and indexes/ count. An index entry is a JSON object at the end of its
    line; it names its member (``filename``, below archive/) unless there is only one. Entries of
    members that are not there, and archives without entries, are errors.
    """
    found = [m for m in members(file, size) if not m.name.endswith("/")]
    archives = {m.name[len("archive/"):]: m for m in found if m.name.startswith("archive/")}
    bases = {name: data_offset(file, m) for name, m in archives.items()}
    listed: dict[str, set] = {name: set() for name in archives}
    for index in (m for m in found if m.name.startswith("indexes/")):
        file.seek(data_offset(file, index))
        for line in file.read(index.size).splitlines():
            if not line.strip():
                continue
            entry = json.loads(line[max(0, line.find(b"{")):])
            name = entry.get("filename", next(iter(archives)) if len(archives) == 1 else None)
            name = name[len("archive/"):] if name and name.startswith("archive/") else name
            if name not in archives:
                raise ValueError(f"{index.name} lists a record of no archive member: {name}")
            at, length = int(entry["offset"]), int(entry["length"])
            if at < 0 or at + length > archives[name].size:
                raise ValueError(f"{index.name} lists a record beyond the end of {name}")
            listed[name].add((bases[name] + at, length))
    empty = sorted(name for name, own in listed.items() if not own)
    if empty or not archives:
        raise ValueError(f"archive without index entries: {', '.join(empty) or 'none in package'}")
    return sorted(place for own in listed.values() for place in own)


# ---- records

def make_record(page_id: object, url: str | None, payload: bytes, digest: str,
                refers_to: object | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    packed = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{packed}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of a record. A response's payload is checked against its length and digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n")
                  if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length
                               or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")

    def page(name: str) -> str | None:
        return fields.get(name, "")[len("<urn:page:"):-1] or None

    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": page("warc-refers-to"), "payload": payload}


# ---- jobs

def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url",
                   html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row and return the packages as rows (path, size, records).

    Of equal payloads of at least ``least`` bytes, those with the largest id are responses and the
    others revisit it; null ids are smaller than all others. A null payload is empty. Rows that
    repeat the largest id are all responses. Packages lie in the session's shared folder under
    names of their own for each attempt, so a task that runs again leaves no broken package in the
    list. No rows make no package.
    """
    rows = pages.select(pages[id_col].alias("id"), pages[url].cast("string").alias("url"),
                        F.coalesce(pages[html].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= least)
    heads = large.groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n"))
    # written, so that both sides of the join are plain shuffles: a payload that a third of all
    # pages have is split over tasks
    heads = stage(heads.where("n > 1").select("digest", "head"))
    rows = rows.join(heads, "digest", "left").select(
        F.col("id").cast("string").alias("id"), "url", "html", "digest",
        F.when(F.coalesce(F.col("id") < F.col("head"), F.col("id").isNull()),
               F.col("head").cast("string")).alias("head"))
    folder = shared_folder(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        package = None
        made: list[tuple[str, int, int]] = []

        def finish() -> None:
            path, out, zipped, data, index = package
            data.close()
            zipped.writestr(zipfile.ZipInfo(INDEX), "".join(
                json.dumps(x) + "\n" for x in index))
            zipped.close()
            made.append((path, out.tell(), len(index)))
            out.close()

        for batch in batches:
            for page_id, link, body, digest, head in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(path)
                    zipped = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    data = zipped.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
                    package, place = (path, out, zipped, data, []), 0
                record = gzip.compress(
                    make_record(page_id, link, body.encode(), digest, head), 1, mtime=0)
                data.write(record)
                package[4].append({"offset": place, "length": len(record)})
                place += len(record)
                if place >= MAX_PACKAGE:
                    finish()
                    package = None
        if package is not None:
            finish()
        paths, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()),
             pa.array(counts, pa.int64())], ["path", "size", "records"])

    packages = stage(rows.mapInArrow(write, "path string, size long, records long"))
    return packages.select(F.lit(folder).alias("folder"), "path", "size", "records")


def read_archives(packages: DataFrame, payload: bool = False) -> DataFrame:
    """Records of the packages (folder, path, size): page_id and refers_to as text, url,
    payload_bytes, payload_digest, record_type, and on demand the payload (null for revisits)."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as file:
                    found = places(file, size)
                starts, lengths = [[]], [[]]
                for start, length in found:
                    # a range is read whole: what lies between records counts as well
                    if starts[-1] and start + length - starts[-1][0] > RANGE:
                        starts.append([])
                        lengths.append([])
                    starts[-1].append(start)
                    lengths[-1].append(length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(starts)), pa.array([path] * len(starts)),
                     pa.array(starts, pa.list_(pa.int64())),
                     pa.array(lengths, pa.list_(pa.int64()))],
                    ["folder", "path", "starts", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for folder, path, starts, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as file:
                    file.seek(starts[0])
                    block = file.read(starts[-1] + lengths[-1] - starts[0])
                rows = [parse_record(zlib.decompress(
                    block[s - starts[0]:s - starts[0] + n], 31)) for s, n in zip(starts, lengths)]
                columns = [pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)]
                if payload:
                    columns.append(pa.array(
                        [r["payload"] if r["record_type"] == "response" else None for r in rows],
                        pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names + ["payload"] * payload)

    ranges = packages.select("folder", "path", "size").mapInArrow(
        plan, "folder string, path string, starts array<long>, lengths array<long>")
    # A stated number of tasks by the bytes to read: the rows that name ranges are tiny, and would
    # be merged into one task by their own size.
    size = packages.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    dealt = ranges.repartition(max(1, -(-size // TASK_BYTES)))
    fields = ("page_id string, url string, payload_bytes long, payload_digest string, "
              "record_type string, refers_to string")
    return dealt.mapInArrow(read, fields + ", payload binary" * payload)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """Write the rows as archives and return what the archives hold."""
    kind = pages.schema[id_col].dataType
    records = read_archives(write_archives(pages, id_col, url, html))
    return records.select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
