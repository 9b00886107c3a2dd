"""WARC archives: exact round trips, ranges of any size, archives inside archives, damage."""

import base64
import gzip
import hashlib
import io
import uuid

import pytest

from lexilake.llm import warc
from lexilake.llm.common import Workspace

SF = "/root/testdata/sf0.001"


def plain(rows):
    """archived() in plain Python over (page_id, html)."""
    first = {}
    for page, html in rows:
        p = (html or "").encode()
        first[p] = max(first.get(p, -1), -1 if page is None else page)
    out = []
    for page, html in rows:
        p = (html or "").encode()
        again = (-1 if page is None else page) != first[p]
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("split", "archive"), [(64 << 20, 1 << 30), (997, 20_000)])
def test_every_page_comes_back(spark, split, archive):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert got(warc.archived(pages, split_bytes=split, archive_bytes=archive)) == plain(rows)


def test_nulls_repeats_and_odd_urls(spark):
    long = "<p>" + "x ä \x1f " * 400_000
    rows = [(1, "a", None), (2, None, ""), (3, "a\r\nWARC-Type: x", "<p>one"), (7, "b", "<p>one"), (7, "b", "<p>one"), (5, "c", "<p>one"), (None, "d", "<p>one"), (None, "e", "two\r\n\r\nthree"), (8, "ü", long), (9, "u", long)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, sha1 string, payload int")
    assert got(warc.archived(pages, split_bytes=5000)) == plain([(r[0], r[2]) for r in rows])
    assert got(warc.archived(pages.limit(0))) == []
    only = warc.archived(pages, least_bytes=1).where("payload_bytes = 0")
    assert {r.record_type for r in only.collect()} == {"response"}


def test_archives_are_plain_gzip_of_whole_records(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 3}") for i in range(9)], "page_id long, url string, html string")
    work = Workspace(spark, "test-warc")
    files = warc.write_archives(pages, f"{work.root}/a", work).collect()
    assert sum(f.records for f in files) == 9
    kinds = []
    for f in files:
        fs, path = warc.store(f.file)
        with fs.open_input_file(path) as file:
            data = file.read()
        assert len(data) == f.bytes
        text = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            named = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(named[b"Content-Length"])
            assert head.startswith(b"WARC/1.1") and rest[n : n + 4] == b"\r\n\r\n"
            kinds.append(named[b"WARC-Type"].decode())
            text = rest[n + 4 :]
    assert kinds.count("response") == 3 and kinds.count("revisit") == 6 and kinds.count("warcinfo") == len([f for f in files if f.bytes])


def _file(spark, work, data):
    fs, path = warc.store(work.root)
    fs.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.gz"
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return spark.createDataFrame([(f"{work.root}/{name}", len(data))], "file string, bytes long")


def _stored(kind, name, block):
    """A record whose member holds its bytes as they are."""
    import zlib

    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


@pytest.mark.parametrize("split", [100, 333, 1024, 1 << 20])
def test_an_archive_inside_an_archive_is_one_record(spark, split):
    work = Workspace(spark, "test-nested")
    inner = b"".join(warc.record("resource", f"in:{i}", b"text %d" % i) for i in range(20))
    outer = warc.record("resource", "out:1", b"one") + _stored("resource", "out:2", inner) + warc.record("resource", "out:3", b"three")
    back = warc.read_archives(_file(spark, work, outer), work, split, payload=True).orderBy("offset").collect()
    assert [(r.record_id, bytes(r.payload)) for r in back] == [("out:1", b"one"), ("out:2", inner), ("out:3", b"three")]


@pytest.mark.parametrize("split", [50, 400, 1 << 20])
def test_damage_costs_the_damaged_record_alone(spark, split):
    work = Workspace(spark, "test-damage")
    parts = [warc.record("resource", f"r:{i}", bytes(str(i), "ascii") * 200) for i in range(6)]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + b"no gzip \x1f\x8b\x08 here" + parts[1] + bytes(broken) + parts[3] + gzip.compress(b"not a record") + parts[4] + parts[5][:-9]
    back = warc.read_archives(_file(spark, work, data), work, split).orderBy("offset").collect()
    assert [r.record_id for r in back] == ["r:0", "r:1", "r:3", "r:4"]


def test_a_record_of_any_kind_keeps_its_payload(spark):
    work = Workspace(spark, "test-kinds")
    http = b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\n\r\n"
    data = b"".join([
        warc.record("response", "a", http + b"abc", Content_Type="application/http; msgtype=response"),
        warc.record("response", "b", b"HTTP/1.1 204 None\r\n\r\n", Content_Type="application/http"),
        warc.record("response", "c", b"no header end", Content_Type="application/http"),
        warc.record("metadata", "d", b""),
        warc.record("resource", "e", b"\r\n\r\nx" * 300_000),
    ])
    back = warc.read_archives(_file(spark, work, data), work, 1000, payload=True).orderBy("offset").collect()
    assert [(r.record_id, r.payload_bytes, r.stated_bytes) for r in back] == [("a", 3, 3), ("b", 0, None), ("c", 0, None), ("d", 0, None), ("e", 1_500_000, None)]
    assert all(r.sha1 == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() for r in back)
