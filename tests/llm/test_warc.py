import io
import zipfile

import pytest
from pyspark.sql import functions as F

from aerostrata.llm import warc
from tests.llm import brute

PAGES = [
    (1, "http://a.example/", "<p>one</p>"), (2, "http://a.example/?q=ü%20x\r\nX: y", "<p>one</p>"), (5, None, "<p>one</p>"),
    (3, "http://b.example/", None), (4, "http://c.example/", ""), (6, "http://d.example/", "line\r\n\r\nline " + "é" * 70_000),
    (None, "http://e.example/", "<p>one</p>"), (None, None, "alone"), (8, "u", brute.LONG_TEXT), (8, "u", "other"), (9, "v", "twice"), (9, "v", "twice"),
]
SCHEMA = "page_id long, url string, html string"


def expected(pages, least=0):
    import base64
    import hashlib

    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "") == (html or "")]
        first = max((p for p in same if p is not None), default=None)
        again = page != first and len(body) >= least
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit(1) for c in ("digest", "first", "_page", "archive")})
    assert sorted(map(tuple, warc.round_trip(pages, least).collect()), key=repr) == expected(PAGES, least)


def test_payloads_urls_and_several_packages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, SCHEMA).coalesce(1)
    listed = warc.write_archives(pages, str(tmp_path / "out"), archive_bytes=300)
    assert listed.count() > 2
    rows = warc.read_archives(listed).collect()
    assert sorted(repr((r.page_id, r.url)) for r in rows) == sorted(repr((p, u)) for p, u, _ in PAGES)
    texts = {(p, (h or "")) for p, _, h in PAGES}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def reader(data):
    return lambda at, n: data[at:at + n]


@pytest.mark.parametrize("wide", [False, True])
def test_directory_agrees_with_zipfile(wide):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(5):
            with z.open(zipfile.ZipInfo(f"dir/ü{i}.bin"), "w", force_zip64=wide) as m:
                m.write(bytes([i]) * (i * 100))
        z.comment = b"a comment"
    data = out.getvalue()
    found = warc.directory(reader(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [i.filename for i in z.infolist()] == list(found)
        for name, m in found.items():
            start = warc.data_offset(reader(data), m)
            assert data[start:start + m.size] == z.read(name)


def test_a_comment_that_looks_like_an_end_record():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"b")
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    assert list(warc.directory(reader(data), len(data))) == ["a"]


def test_zip64_end_of_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than the short form can count
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    data = out.getvalue()
    assert len(warc.directory(reader(data), len(data))) == 66_000


def test_zip64_fields_of_a_member():
    import struct

    wide = struct.pack("<HHQQQ", 1, 24, 5_000_000_000, 5_000_000_000, 6_000_000_000)
    entry = b"PK\x01\x02" + b"\0" * 16 + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, 1, len(wide), 0) + b"\0" * 8 + struct.pack("<I", 0xFFFFFFFF) + b"x" + wide
    data = entry + b"PK\x05\x06" + b"\0" * 4 + struct.pack("<HHIIH", 1, 1, len(entry), 0, 0)
    member = warc.directory(reader(data), len(data))["x"]
    assert (member.size, member.header) == (5_000_000_000, 6_000_000_000)


def test_damaged_packages_are_errors():
    with pytest.raises(ValueError):
        warc.directory(reader(b"nothing here" * 9), 108)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    data = out.getvalue()
    with pytest.raises(ValueError):
        warc.data_offset(reader(data), warc.directory(reader(data), len(data))["a"])
    raw = warc.record(1, "u", b"payload", warc.base32("00" * 20), None, False)
    with pytest.raises(ValueError):
        warc.parsed(raw)
