"""WARC archives of pages: written by tasks, read back by tasks that each scan one range of bytes.

Writing. Payloads are told by their SHA-1. Of rows with equal payloads the one of the largest page_id becomes a response
record, the others become revisit records that name it; a revisit holds the HTTP header alone, whose Content-Length is
the payload's. Each record is a gzip member of its own. A task writes files under names of its attempt and returns
their names and sizes; only files that the written manifest names are read, so what a lost or repeated attempt left
behind is never seen.

Reading. Archives are cut into ranges of bytes with no regard to records. A task looks in its range for the gzip magic,
takes a candidate for a record only if its first bytes decode to a WARC header and the whole member decodes to its
check sum and stated length, owns the records that begin inside its range, and reads on past the end for the last one.
A member may hold an archive as its payload, stored as it is: a task that starts inside such a member finds records of
that inner archive. They begin before the end of a record that an earlier range owns, and are dropped by that.

Scale. Payloads of a hot group are not shuffled to one task: the join on the digest has one row a digest on its small
side, so that Spark may split the other. Nothing but the manifest's sums reaches the driver.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexilake.llm.common import Workspace, bounded_batches, released

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
ARCHIVE, SPLIT = 1 << 30, 64 << 20
HEADER = 1 << 20
PIECE = 1 << 14
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long"
FIELDS = "file string, offset long, length long, split long, type string, record_id string, refers_to string, uri string, digest string, payload_bytes long, stated_bytes long, sha1 string"


def store(uri: str):
    """(file system, path) of a folder or file that tasks reach: file, hdfs, s3 and what else Arrow opens."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri)))


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, record_id: str, block: bytes, **headers: str | None) -> bytes:
    """One WARC record as a gzip member."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {_one_line(v)}" for k, v in headers.items() if v is not None]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(["WARC/1.1", *lines, "", ""]).encode()
    return b"".join([z.compress(head), z.compress(block), z.compress(b"\r\n\r\n"), z.flush()])


def _one_line(value: str) -> str:
    """A header's value; control characters, which would end it, are written as URIs write them."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _page(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, sha1, first_id and first_url (of the response, null for one)."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    alike = src.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    own = lambda c: F.when(again, F.col(c))
    return src.join(alike, "sha1", "left").select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "sha1", again.alias("again"), own("first.page_id").alias("first_id"), own("first.url").alias("first_url"))


def write_archives(pages: DataFrame, folder: str, work: Workspace, least_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html) to archives under folder; the manifest: file, bytes, records.

    A null html is the empty payload, a null url has no target URI. Rows that repeat the largest page_id of a payload
    are responses all; a null page_id counts as the least. Archives end with the first record beyond archive_bytes.
    """
    bounded_batches(pages.sparkSession, 512)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, top = store(folder)
        fs.create_dir(top, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, done = None, []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    done.append([f"{folder}/{name}-{len(done):04d}.warc.gz", 0, 0])
                    out = fs.open_output_stream(f"{top}/{done[-1][0].rpartition('/')[2]}", compression=None)
                    info = record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", Content_Type="application/warc-fields")
                    out.write(info)
                    done[-1][1] += len(info)
                data = _page_record(row)
                out.write(data)
                done[-1][1] += len(data)
                done[-1][2] += 1
                if done[-1][1] >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "bytes", "records"])

    return work.save(with_roles(pages, least_bytes).mapInArrow(released(write), MANIFEST))


def _page_record(row: dict) -> bytes:
    digest = base32(bytes.fromhex(row["sha1"]))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    named = {"WARC_Target_URI": row["url"], "Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": f"sha1:{digest}"}
    if not row["again"]:
        return record("response", _page(row["page_id"], digest), http + row["payload"], **named)
    named |= {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": f"<{_page(row['first_id'], digest)}>", "WARC_Refers_To_Target_URI": row["first_url"]}
    return record("revisit", _page(row["page_id"], digest), http, **named)


class _Bytes:
    """A file's bytes by position, read a window at a time."""

    WINDOW = 1 << 20

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.window = file, size, 0, b""

    def piece(self, pos: int, n: int = PIECE) -> bytes:
        """Up to n bytes from pos on; none at the end of the file."""
        if not self.at <= pos < self.at + len(self.window):
            self.file.seek(pos)
            self.at, self.window = pos, self.file.read(min(self.WINDOW, max(self.size - pos, 0)))
        a = pos - self.at
        return self.window[a : a + n]

    def magic(self, pos: int, end: int) -> int | None:
        """The first place of the gzip magic in [pos, end); its bytes may reach beyond."""
        while pos < end:
            part = self.piece(pos, self.WINDOW)
            if len(part) < len(MAGIC):  # at the window's end: read on from here
                if pos + len(MAGIC) > self.size:
                    return None
                self.window = b""
                continue
            i = part.find(MAGIC)
            if i >= 0:
                return pos + i if pos + i < end else None
            pos += len(part) - len(MAGIC) + 1
        return None


class _Record:
    """Takes the bytes of one member as they are decoded: headers, then the payload's length and digest."""

    def __init__(self, keep: bool):
        self.head, self.named, self.body, self.stated = b"", None, 0, None
        self.http, self.n, self.sha, self.kept, self.tail = None, 0, hashlib.sha1(), [] if keep else None, b""

    def take(self, data: bytes) -> bool:
        """False: these are not the bytes of a record."""
        if self.named is None:
            self.head += data
            if not self.head.startswith(VERSION[: len(self.head)]) or len(self.head) > HEADER + len(data):
                return False
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return True
            lines = self.head[:end].decode("utf-8", "replace").split("\r\n")[1:]
            self.named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            if not re.fullmatch(r"\d{1,18}", self.named.get("content-length", "")) or "warc-type" not in self.named:
                return False
            self.body, data, self.head = int(self.named["content-length"]), self.head[end + 4 :], b""
            self.http = b"" if self.named.get("content-type", "").startswith("application/http") else None
        block, data = data[: self.body], data[self.body :]
        self.body -= len(block)
        if self.http is not None and (block or not self.body):
            self.http += block
            end = self.http.find(b"\r\n\r\n")
            if end >= 0 or not self.body:
                head, block = (self.http[:end], self.http[end + 4 :]) if end >= 0 else (self.http, b"")
                found = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
                self.stated, self.http = int(found[1]) if found else None, None
            else:
                block = b""
        self.n += len(block)
        self.sha.update(block)
        if self.kept is not None:
            self.kept.append(block)
        self.tail += data
        return len(self.tail) <= 4

    def whole(self) -> bool:
        return self.named is not None and self.body == 0 and self.tail == b"\r\n\r\n"


def _member(data: _Bytes, pos: int, keep: bool) -> tuple[_Record, int] | None:
    """The record of the gzip member at pos and the member's length; None if no whole record stands there."""
    z, rec, at = zlib.decompressobj(31), _Record(keep), pos
    part = data.piece(at)
    try:
        while True:
            out = z.decompress(part, HEADER)
            if out and not rec.take(out):
                return None
            if z.eof:
                return (rec, at + len(part) - len(z.unused_data) - pos) if rec.whole() else None
            if z.unconsumed_tail:
                at += len(part) - len(z.unconsumed_tail)
                part = z.unconsumed_tail
                continue
            at += len(part)
            part = data.piece(at)
            if not part and not out:
                return None
    except zlib.error:
        return None


def records_in(file, size: int, start: int, end: int, keep: bool = False) -> Iterator[tuple[int, int, _Record]]:
    """(offset, length, record) of the members that begin in [start, end) of a file of size bytes."""
    data, pos = _Bytes(file, size), start
    while (at := data.magic(pos, min(end, size))) is not None:
        found = _member(data, at, keep)
        if found:
            yield at, found[1], found[0]
        pos = at + (found[1] if found else 1)


def splits_of(files: DataFrame, split_bytes: int = SPLIT) -> DataFrame:
    """Ranges of files(file, bytes): file, bytes, split, start, end."""
    n = F.expr(f"(bytes + {split_bytes - 1}) div {split_bytes}")
    each = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("split"))
    return each.withColumn("start", F.col("split") * split_bytes).withColumn("end", F.least(F.col("start") + split_bytes, "bytes"))


def read_archives(files: DataFrame, work: Workspace, split_bytes: int = SPLIT, payload: bool = False) -> DataFrame:
    """The records of archives files(file, bytes), a row each with FIELDS, and the payload if asked for.

    Bytes that belong to no whole record (damage, other files) are passed over. sha1 and payload_bytes are of what
    the record holds, digest and stated_bytes what its headers say. Archives may have any number of records, or none.
    """
    spark = files.sparkSession
    bounded_batches(spark, 512)
    splits = splits_of(files, split_bytes)
    n = max(1, min(splits.count(), 100_000))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * payload
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in FIELDS.split(", ")] + [pa.binary()] * payload
        rows, room = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for s in b.to_pylist():
                fs, path = store(s["file"])
                with fs.open_input_file(path) as file:
                    for offset, length, rec in records_in(file, s["bytes"], s["start"], s["end"], payload):
                        h = rec.named
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        own = (s["file"], offset, length, s["split"], h["warc-type"], h.get("warc-record-id", "").strip("<>"), h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, h.get("warc-target-uri"), digest, rec.n, rec.stated, base32(rec.sha.digest()))
                        rows.append(own + ((b"".join(rec.kept),) if payload else ()))
                        room += rec.n if payload else 0
                        if len(rows) >= 1024 or room >= 8 << 20:
                            yield batch()
                            rows, room = [], 0
        if rows:
            yield batch()

    dealt = splits.select("file", "bytes", "split", "start", "end").repartition(n, "file", "split")
    found = work.save(dealt.mapInArrow(released(scan), FIELDS + ", payload binary" * payload))
    # where the records that begin in earlier ranges of a file end: one row a range
    ends = found.groupBy("file", "split").agg(F.max(F.col("offset") + F.col("length")).alias("to"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    reach = ends.withColumn("reach", F.max("to").over(before)).where(f"reach > split * {split_bytes}").select("file", "split", "reach")
    inner = found.select("file", "split", "offset").join(reach, ["file", "split"]).where("offset < reach").select("file", "offset")
    return found.join(inner, ["file", "offset"], "left_anti")


def archived(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE, split_bytes: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for pages(page_id, url, html), from the archives
    that are written of them and read back. Null, empty and repeated rows: see write_archives. An empty table has none."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    files = write_archives(pages, f"{work.root}/archives", work, least_bytes, archive_bytes)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d*):", 1).try_cast("long")
    back = read_archives(files.select("file", "bytes"), work, split_bytes).where("type in ('response', 'revisit')")
    response = F.col("type") == "response"
    return back.select(
        page("record_id").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"),
        F.when(response, F.col("sha1")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY sha1(payload)) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
