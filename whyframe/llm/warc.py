"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own, so an archive can be read from any
byte on. Reader tasks scan a byte range for gzip magic, accept a candidate
only if it inflates to a WARC version line and header fields (magic bytes also
occur inside compressed data), and own the members that start inside their
range, however far they reach beyond it.

Payloads that occur again are revisits: the record with the smallest id is the
response, the others point to it with ``WARC-Refers-To`` and carry the HTTP
header of the payload, with its full length, but not the payload.

Defined results: a null html is an empty payload. A null url is written as an
empty target. Rows with a null id are left out. Of rows that repeat an id with
the same payload, all are responses if the id is the payload's smallest. An
empty table writes no archive and reads as an empty result. Payloads shorter
than ``least_bytes`` are always responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_id, new_path, partitions
from .files import reading, writing

MAGIC = b"\x1f\x8b\x08"
NAMESPACE = "urn:page:"
SPLIT = 8 << 20
MANIFEST = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def record_bytes(page_id: int, url: str, payload: bytes, refers_to: int | None, date: str) -> bytes:
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAMESPACE}{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{NAMESPACE}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def write_archives(pages: DataFrame, base: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> list[tuple[str, int]]:
    """Write a record for each page; (path, bytes) of each archive. Only digests are grouped, by SHA-1 with partial minima."""

    def run(batches):
        path, written, records = f"{base}/part-{TaskContext.get().partitionId():05d}.warc.gz", 0, 0
        first = next(batches, None)
        if first is None:
            return
        with writing(path) as f:
            while first is not None:
                for k in range(first.num_rows):
                    row = {n: first.column(n)[k].as_py() for n in ("id", "url", "payload", "first_id", "eligible")}
                    refers = row["first_id"] if row["eligible"] and row["first_id"] != row["id"] else None
                    data = member(record_bytes(row["id"], row["url"] or "", row["payload"], refers, date))
                    f.write(data)
                    written += len(data)
                    records += 1
                first = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([written]), pa.array([records])], schema=MANIFEST)

    plain = pages.select(as_id(id_col).alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.encode(F.col(f"`{payload_col}`").cast("string"), "UTF-8"), F.lit(b"")).alias("payload")).where("id IS NOT NULL")
    plain = plain.withColumn("eligible", F.length("payload") >= least_bytes).withColumn("sha", F.sha1("payload"))
    first = plain.where("eligible").groupBy("sha").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first_id")
    done = plain.join(first, "sha", "left").select("id", "url", "payload", "first_id", (F.col("eligible") & F.col("first_id").isNotNull()).alias("eligible")).mapInArrow(run, "path string, bytes long, records long")
    return sorted((r.path, r.bytes) for r in done.collect())  # one row for each archive


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


class _Window:
    """A file's bytes from a place on, read ahead as far as asked."""

    def __init__(self, f, start: int, step: int = 1 << 20):
        self.f, self.start, self.step, self.data, self.ended = f, start, step, bytearray(), False
        f.seek(start)

    def upto(self, end: int) -> None:
        while not self.ended and self.start + len(self.data) < end:
            more = self.f.read(self.step)
            self.ended = not more
            self.data += more

    def forget(self, before: int) -> None:
        del self.data[: max(0, before - self.start)]
        self.start = max(self.start, before)


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and the place after it; None if there is no whole WARC member.

    A false candidate is given up as soon as its first bytes aren't a WARC
    version line, before the rest is read.
    """
    z, out, here = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            window.upto(here + 1)
            piece = bytes(window.data[here - window.start : here - window.start + 65536])
            if not piece:
                return None
            out += z.decompress(piece)
            here += len(piece)
            if len(out) >= 5 and not out.startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return (bytes(out), here - len(z.unused_data)) if out.startswith(b"WARC/") else None


def parse_record(data: bytes) -> tuple | None:
    """A row of RECORDS, or None if the headers don't make a whole response or revisit record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    size = fields.get("content-length", "")
    if not gap or not size.isdigit() or len(rest) < int(size) or fields.get("warc-type") not in ("response", "revisit"):
        return None
    page = lambda name: int(fields[name].strip("<>")[len(NAMESPACE) :])
    http, _, payload = rest[: int(size)].partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    length = int(_headers(http).get("content-length", len(payload)))
    named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and (len(payload) != length or digest(payload) != named):
        raise ValueError(f"the payload of {fields.get('warc-record-id')} doesn't match its digest")
    return page("warc-record-id"), fields.get("warc-target-uri", ""), fields["warc-type"], page("warc-refers-to") if revisit else None, length, named, None if revisit else payload


def members(f, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end) of an archive."""
    window, at = _Window(f, start), start
    while at < end:
        window.upto(at + window.step)
        found = window.data.find(MAGIC, at - window.start)
        if found < 0:
            if window.ended:
                return
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.forget(at)
            continue
        at = window.start + found
        if at >= end:
            return
        whole = _inflate(window, at)
        if whole is None:
            at += 1
        else:
            yield whole[0]
            at = whole[1]
        window.forget(at)


#: Ranges share tasks beyond so many.
MOST_TASKS = 20_000


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row for each record, from byte ranges of ``split`` bytes each, which are dealt out on the executors."""

    def run(batches):
        for batch in batches:
            for path, start, end in zip(*(batch.column(n).to_pylist() for n in ("path", "start", "end"))):
                rows, room = [], 4 << 20
                with reading(path) as f:
                    for data in members(f, start, end):
                        row = parse_record(data)
                        if row is None:
                            continue
                        rows.append(row if payloads else (*row[:-1], None))
                        room -= len(row[-1] or b"") if payloads else 64
                        if room <= 0:
                            yield _batch(rows)
                            rows, room = [], 4 << 20
                if rows:
                    yield _batch(rows)

    known = spark.createDataFrame([a for a in archives if a[1]], "path string, size long")
    ranges = known.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end"))
    tasks = sum(-(-size // split) for _, size in archives)
    table = ranges.repartition(min(max(1, tasks), max(MOST_TASKS, partitions(spark))))
    return table.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), RECORDS)], schema=RECORDS)


def archive_pages(pages: DataFrame, base: str | None = None, least_bytes: int = 0, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Write pages to archives, in a new shared folder if none is given, and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, base or new_path(spark, "warc"), least_bytes), split, payloads)
