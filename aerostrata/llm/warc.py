"""Web archives in ZIP packages: writing, and reading records by range without extraction.

A package holds the records (`archive/data.warc.gz`, one gzip member per record) and their index
(`indexes/index.cdxj`) as stored members. The reader finds the end-of-directory record, follows it
(or its ZIP64 form) to the central directory, locates the two members, reads the index and then each
record by its own byte range.

Files are opened through `pyarrow.fs`, so the folder may be any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from aerostrata.llm.common import fresh_id, prepared, written
from aerostrata.session import scratch_dir

ARCHIVE_BYTES = 64 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_URN = "urn:aerostrata:page:"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# --- ZIP ---------------------------------------------------------------------------------------

@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def directory(read: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """Members by name, from the central directory; `read(offset, length)` reads a range."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and not (len(tail) - end >= 22 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        at = tail_at + end - 20
        locator = read(at, 20) if at >= 0 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end of directory is missing")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
    body, at, found = read(offset, length), 0, {}
    for _ in range(count):
        if body[at:at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, = struct.unpack_from("<H", body, at + 10)
        packed, plain, n, extra, comment = struct.unpack_from("<IIHHH", body, at + 20)
        header, = struct.unpack_from("<I", body, at + 42)
        name = body[at + 46:at + 46 + n].decode()
        pos, stop = at + 46 + n, at + 46 + n + extra
        while pos + 4 <= stop:
            kind, width = struct.unpack_from("<HH", body, pos)
            if kind == 1:  # ZIP64: those of the three fields that overflow, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", body, pos + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            pos += 4 + width
        found[name] = Member(name, method, packed, header)
        at = stop + comment
    return found


def data_offset(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed by the package; its ranges cannot be read")
    header = read(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", header, 26))


# --- records -----------------------------------------------------------------------------------

def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'none' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    own = urn.strip("<>").removeprefix(_URN)
    return None if own == "none" else int(own)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    content = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(content)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + content + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}


def parsed(raw: bytes) -> tuple:
    """page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    own = _headers(head)
    http, _, payload = rest[:int(own["content-length"])].partition(b"\r\n\r\n")
    size = int(_headers(http)["content-length"])
    stated = own["warc-payload-digest"].removeprefix("sha1:")
    url = unquote(own["warc-target-uri"]) if "warc-target-uri" in own else None
    page = _page_of(own["warc-record-id"])
    if own["warc-type"] == "revisit":
        return page, url, "revisit", None, size, stated, _page_of(own["warc-refers-to"])
    digest = base32(hashlib.sha1(payload).hexdigest())
    if digest != stated or len(payload) != size:
        raise ValueError(f"record of page {page} is damaged")
    return page, url, "response", payload, size, digest, None


# --- Spark -------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `pages` (page_id, url, html) as packages below `folder`; returns archive, records, bytes.

    Of records with equal payloads of at least `least` bytes the one with the largest page_id is a
    response, the others revisit it. A null html is empty; a null page_id is the smallest; rows of
    one page_id and payload are alike, hence all of one type. Only the narrow (page_id, digest) rows
    meet by digest; the payloads are dealt out by page and digest, so copies do not pile up.

    A task writes packages under new names and reports them when it is done, so the files of a lost
    or repeated attempt are never listed.
    """
    prepared(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.sha1("html"))
    narrow = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    largest = narrow.groupBy("digest").agg(F.max("page_id").alias("first"))
    again = narrow.join(largest, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    typed = rows.join(
        again.hint("shuffle_hash"), rows["page_id"].eqNullSafe(again["_page"]) & (rows["digest"] == again["_digest"]), "left"
    ).select("page_id", "url", "html", "digest", F.col("_digest").isNotNull().alias("revisit"), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)

        def package(rows: Iterator[tuple]) -> Iterator[tuple]:
            for first in rows:
                name = f"{fresh_id():016x}.wacz"
                index, at = [], 0
                with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                        row = first
                        while row is not None:
                            page_id, url, text, digest, revisit, refers_to = row
                            raw = record(page_id, url, text.encode(), base32(digest), refers_to, revisit)
                            packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                            data = packer.compress(raw) + packer.flush()
                            member.write(data)
                            index.append(json.dumps({"page": page_id, "offset": at, "length": len(data)}))
                            at += len(data)
                            row = next(rows, None) if at < archive_bytes else None
                    z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
                yield f"{folder}/{name}", len(index), at

        every = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for archive, n, size in package(every):
            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([n]), pa.array([size])], ["archive", "records", "bytes"])

    listed, _ = written(typed.mapInArrow(run, "archive string, records long, bytes long"), "archives")
    return listed


_RECORD = (
    "archive string, offset long, length long, page_id long, url string, record_type string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages named in the column `archive`, each read by its own range.

    Digests and lengths of responses are those of the bytes read and must agree with the record's
    headers; a damaged package or record is an error. An empty list gives no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in _RECORD.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for archive in b.column(0).to_pylist():
                store, path = open_store(archive)
                with store.open_input_file(path) as f:
                    read = lambda at, n: f.read_at(n, at)
                    members = directory(read, f.size())
                    start = data_offset(read, members[DATA])
                    lines = read(data_offset(read, members[INDEX]), members[INDEX].size).decode().splitlines()
                    rows, held = [], 0
                    for entry in map(json.loads, lines):
                        raw = zlib.decompress(read(start + entry["offset"], entry["length"]), 31)
                        page, url, kind, payload, size, digest, to = parsed(raw)
                        rows.append((
                            archive, entry["offset"], entry["length"], page, url, kind, payload if payloads else None, size, digest, to,
                        ))
                        held += len(raw) if payloads else 200
                        if held > 1 << 23:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    # A fixed number: adaptive execution would merge partitions by the bytes of the listing, not of the archives.
    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return spread.mapInArrow(run, _RECORD)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to packages in the shared folder and read the packages back."""
    archives = write_archives(pages, scratch_dir(pages.sparkSession, "warc"), least)
    return read_archives(archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
