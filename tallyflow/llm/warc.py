"""WARC archives whose repeated payloads are revisits.

Headers are joined by payload digest: the record with the smallest page id is the
response and the others refer to it. Each different payload moves once, to its response's archive; revisits move as headers. Archives are gzip members, one per
record, many records to a file; files are rows of a Parquet table, so any store
that Spark reaches will do. Reading joins revisits to their responses again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.session import settle

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6f1f4a52-6a0b-4c5e-9a46-0a4d5d0f7a11")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, of: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{of}/{copy}')}>"


def record(r: dict, date: str) -> bytes:
    """One WARC record with fresh headers; a revisit has the HTTP head but no payload."""
    payload = (r["html"] or "").encode()
    of = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    block = head if r["record_type"] == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {record_id(r['page_id'], of, r['copy'])}", f"WARC-Date: {date}"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {_line(r['url'])}")
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    lines.append(f"WARC-Payload-Digest: sha1:{of}")
    if r["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(r['first_id'], of, 0)}", f"WARC-Refers-To-Date: {date}"]
        if r["first_url"] is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_line(r['first_url'])}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def _members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof and at < len(data):
            parts.append(unzip.decompress(data[at : at + step]))
            at += min(step, len(data) - at) - len(unzip.unused_data)
        yield b"".join(parts)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive."""
    for one in _members(data):
        head, _, rest = one.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


# --- writing -----------------------------------------------------------------

ARCHIVES = pa.schema([("archive", pa.string()), ("n_records", pa.int32()), ("data", pa.binary())])
ARCHIVES_DDL = "archive string, n_records int, data binary"


def _archiver(date: str, most: int, level: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, members, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            row = {"archive": f"part-{part:05d}-{number:05d}.warc.gz", "n_records": len(members), "data": b"".join(members)}
            return pa.RecordBatch.from_pylist([row], schema=ARCHIVES)

        for batch in batches:
            for i in range(batch.num_rows):
                members.append(gzip.compress(record({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}, date), level, mtime=0))
                size += len(members[-1])
                if size >= most:
                    yield flush()
                    number, members, size = number + 1, [], 0
        if members:
            yield flush()

    return write


def deduplicated(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 23, level: int = 2) -> DataFrame:
    """Archives of all pages, ``archive, n_records, data``, stored in the shared folder.

    Of pages with equal payloads (html in UTF-8, null as empty) of at least
    ``min_bytes``, that with the smallest ``page_id`` (null last, then the smallest
    url) is a response, the others revisit it; smaller payloads are all responses.
    Rows that repeat a page are records of their own. A payload that many pages
    share is combined before the shuffle; what revisits it moves as headers only.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"), html.alias("html"))
    large, small = rows.filter(F.col("payload_bytes") >= min_bytes), rows.filter(F.col("payload_bytes") < min_bytes)
    heads = large.groupBy("sha1", "payload_bytes", "page_id", "url").agg(F.count("*").cast("int").alias("n"))
    heads = settle(heads, "heads")
    smallest = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", F.col("url").isNull().alias("nowhere"), "url"))
    firsts = heads.groupBy("sha1").agg(smallest.alias("first"))
    firsts = firsts.select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    nothing = lambda kind: F.lit(None).cast(kind)
    responses = large.groupBy("sha1").agg(F.first("html").alias("html"), F.first("payload_bytes").alias("payload_bytes")).join(firsts, "sha1")
    responses = responses.select(
        F.col("first_id").alias("page_id"), F.col("first_url").alias("url"), "sha1", "payload_bytes", "html", F.lit("response").alias("record_type"),
        F.lit(0).alias("copy"), nothing("long").alias("first_id"), nothing("string").alias("first_url"),
    )
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    copies = heads.join(firsts, "sha1").withColumn("from", F.when(is_first, 1).otherwise(0)).filter(F.col("from") < F.col("n"))
    revisits = copies.select(
        "page_id", "url", "sha1", "payload_bytes", nothing("string").alias("html"), F.lit("revisit").alias("record_type"),
        F.explode(F.sequence(F.col("from"), F.col("n") - 1)).alias("copy"), "first_id", "first_url",
    )
    others = small.select("page_id", "url", "sha1", "payload_bytes", "html", F.lit("response").alias("record_type"), F.lit(0).alias("copy"), nothing("long").alias("first_id"), nothing("string").alias("first_url"))
    return settle(responses.unionAll(revisits).unionAll(others).mapInArrow(_archiver(date, archive_bytes, level), ARCHIVES_DDL), "archives")


# --- reading -----------------------------------------------------------------

HEADS = pa.schema([
    ("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
HEADS_DDL = "page_id bigint, record_id string, record_type string, url string, payload_digest string, payload_bytes bigint, payload binary"


def _parser(with_payload: bool) -> Callable:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                out = []
                for fields, block in records(data.as_py()):
                    kind, of = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, payload = fields.get("X-Page-ID"), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if digest(payload) != of:
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not that of its digest")
                    out.append({
                        "page_id": int(page) if page else None, "record_id": fields["WARC-Record-ID"], "record_type": kind, "url": fields.get("WARC-Target-URI"),
                        "payload_digest": of, "payload_bytes": None if payload is None else len(payload), "payload": payload if with_payload else None,
                    })
                yield pa.RecordBatch.from_pylist(out, schema=HEADS)

    return parse


def resolved(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of archives: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and each response's ``payload``.

    A revisit has the size of the response with its digest and that page's id; both
    are null where the archives hold none. Payloads are checked against their
    digests. Headers alone are shuffled.
    """
    heads = archives.select("data").mapInArrow(_parser(with_payload), HEADS_DDL)
    lean = archives.select("data").mapInArrow(_parser(False), HEADS_DDL) if with_payload else heads
    own = lean.filter("record_type = 'response'").groupBy("payload_digest")
    own = own.agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "payload_bytes")).alias("first"))
    revisits = lean.filter("record_type = 'revisit'").drop("payload_bytes").join(own, "payload_digest", "left")
    payload = ["payload"] if with_payload else []
    responses = heads.filter("record_type = 'response'").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), *payload)
    return responses.unionAll(revisits.select("page_id", "url", F.col("first.payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first.page_id").alias("refers_to"), *payload))
