"""WARC archives, index first.

Records are written as gzip members of WARC/1.1 files, and every record's file, offset, length, URL and digest
go into an index, a table of its own. Reading starts from the index: the selected records of each file are sorted
by offset, neighbouring byte ranges are coalesced into one read, and records are cut out of what was read.

Of records with equal payloads of ``LEAST`` bytes or more, the one with the smallest id is a response; the others
are revisits, which have no payload but refer to it. Equality is that of SHA-256 digests and lengths.

A file begins with a warcinfo record, which is in no index. Responses are HTTP messages whose body is the payload; payload
digests are those of the body. A record's id is made from the page's id and its payload's digest, so a revisit names its
response (WARC-Refers-To, with the response's URI and date) without meeting it.

A task writes each file under a name of its own and names it in the index only when it is complete; the index is
committed by Spark. A file of a failed or repeated attempt is in no index and so is never read. Files go to a folder
that executors share (``spark.checkpoint.dir``) through Arrow's file systems, by the URIs that Spark users write; a store that Arrow
doesn't have is opened by a function that the caller gives (``open_with``).

Memory: a reading task holds one coalesced read (8 MB, or one longer record) and up to ``UNPACKED`` bytes of payloads that were unpacked from
it, beside the record at hand, however well they compress.

Nulls and edge cases: a null payload is written as empty; a URL that is null, or holds characters that a header can't, is
written percent-encoded (null as ``urn:x-none``) and kept as it is in a field ``X-Target``, from which it is read back; a
null id is larger than all others, and is written as ``null``; rows that repeat an id and payload are one capture: they
have the same record id, and if theirs is the smallest id, all of them are responses; an empty table gives an empty
result; clashing columns of the input aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, free, pieces, scratch_path
from tesserae.sources.locations import Opener, open_at

LEAST = 100
FILE_BYTES, GAP, MOST_READ, UNPACKED = 64 << 20, 64 << 10, 8 << 20, 8 << 20
#: Archive bytes that a reading task is given, and the number of tasks beyond which they get more each.
TASK_BYTES, MOST_TASKS = 4 << 20, 4096
WHEN, NO_URL = "2024-01-01T00:00:00Z", "urn:x-none"
_INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("page_id", pa.int64()),
])
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html binary"
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.binary()),
])


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload_bytes, payload_digest, and refers_to and refers_url (null for responses).

    Groups are settled on ids and digests alone. The decisions are written before they meet the payloads: Spark sees their size,
    and sends them to every task if they are small; otherwise payloads and decisions are shuffled by id.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha2(payload, 256)
    long = cut(pages.where(F.octet_length(payload) >= least).select("page_id", "url", F.unhex(digest).alias("digest")), "warc-digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("page_id").alias("m"), F.count("*").alias("n"), F.min_by("url", "page_id").alias("first_url"))
    first = cut(first.where("first < last OR (m > 0 AND m < n)").select(F.col("digest").alias("_f"), "first", "first_url"), "warc-first")
    copies = long.join(first, F.col("digest") == F.col("_f")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    copies = copies.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("first").alias("refers_to"), F.col("first_url").alias("refers_url")).distinct()
    copies = cut(copies, "warc-copies")
    free(long, first)
    sized = pages.select("page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), digest.alias("payload_digest"))
    on = F.col("page_id").eqNullSafe(F.col("_p")) & (F.unhex("payload_digest") == F.col("_d"))
    return sized.join(copies, on, "left").drop("_p", "_d")


def _target(url: str | None) -> str:
    return NO_URL if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") or "urn:x-empty"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _framed(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(None, name)}", f"WARC-Date: {WHEN}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _framed(head, b"software: tesserae\r\nformat: WARC File Format 1.1\r\n")


def _record(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    body = b"" if revisit else (row["html"] or "").encode()
    target = _target(row["url"])
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(row['page_id'], row['payload_digest'])}",
        f"WARC-Date: {WHEN}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Bytes: {row['payload_bytes']}", f"X-Page-ID: {'null' if row['page_id'] is None else row['page_id']}",
    ]
    if target != row["url"]:
        head.append(f"X-Target: {json.dumps(row['url'])}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(row['refers_to'], row['payload_digest'])}", f"WARC-Refers-To-Target-URI: {_target(row['refers_url'])}",
            f"WARC-Refers-To-Date: {WHEN}", f"X-Refers-To-Page-ID: {row['refers_to']}",
        ]
    message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    return _framed([*head, "Content-Type: application/http; msgtype=response"], message + body)


def parse(record: bytes) -> dict:
    """A record's fields; html is its payload, null for a revisit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    size = int(field["Content-Length"])
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    kind, digest = field["WARC-Type"], field["WARC-Payload-Digest"].removeprefix("sha256:")
    body = rest[:size].partition(b"\r\n\r\n")[2]
    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"the payload of {field['X-Page-ID']} does not have its digest")
    number = lambda x: None if x in (None, "null") else int(x)
    return {
        "page_id": number(field["X-Page-ID"]), "url": json.loads(field["X-Target"]) if "X-Target" in field else field["WARC-Target-URI"],
        "payload_bytes": int(field["X-Payload-Bytes"]) if kind == "revisit" else len(body), "payload_digest": digest, "record_type": kind,
        "refers_to": number(field.get("X-Refers-To-Page-ID")), "html": body if kind == "response" else None,
    }


def write(decided: DataFrame, folder: str, file_bytes: int = FILE_BYTES, open_with: Opener = open_at) -> DataFrame:
    """Writes a record per row of ``decide`` to files in ``folder``, and returns the index (written beside them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        store.create_dir(top, recursive=True)
        out, name, at, rows = None, "", 0, []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal out, rows
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
            out, rows = None, []

        for batch in batches:
            for part in pieces(batch, "html"):
                for row in part.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                        info = gzip.compress(_info(name), 4, mtime=0)
                        out.write(info)
                        at = len(info)
                    data = gzip.compress(_record(row), 4, mtime=0)
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": row["url"], "digest": row["payload_digest"], "page_id": row["page_id"]})
                    at += len(data)
                    if at >= file_bytes:
                        yield from done()
        yield from done()

    index = decided.select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to", "refers_url").mapInArrow(run, INDEX)
    index.write.parquet(f"{folder}/index")
    return decided.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def ranges(spans: Iterable[tuple[int, int]], gap: int = GAP, most: int = MOST_READ) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(offset, length, spans) of reads that cover sorted (offset, length) spans: spans less than ``gap`` apart share a read of up to ``most`` bytes."""
    begin = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in spans:
        if inside and (offset - end > gap or max(end, offset + length) - begin > most):
            yield begin, end - begin, inside
            inside = []
        if not inside:
            begin = end = offset
        inside.append((offset, length))
        end = max(end, offset + length)
    if inside:
        yield begin, end - begin, inside


def unpacked(data: bytes, begin: int, spans: Iterable[tuple[int, int]], most: int = UNPACKED) -> Iterator[pa.RecordBatch]:
    """The records at (offset, length) spans of what was read from ``begin``, in batches that end once they hold ``most`` bytes of payloads."""
    rows, held = [], 0
    for offset, length in spans:
        rows.append(parse(gzip.decompress(data[offset - begin : offset - begin + length])))
        held += len(rows[-1]["html"] or b"")
        if held >= most:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def read(index: DataFrame, folder: str, open_with: Opener = open_at) -> DataFrame:
    """The records of the index rows given, each as a row. Sorted by file and offset within tasks, so that reads run forward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_with(folder)
        opened, name = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            at = 0
            while at < len(files):
                to = at
                while to < len(files) and files[to] == files[at]:
                    to += 1
                if files[at] != name:
                    if opened is not None:
                        opened.close()
                    name = files[at]
                    opened = store.open_input_file(f"{top}/{name}")
                for begin, size, inside in ranges(zip(offsets[at:to], lengths[at:to], strict=True)):
                    yield from unpacked(opened.read_at(size, begin), begin, inside)
                at = to
        if opened is not None:
            opened.close()

    wanted = index.select("file", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    # a file's ranges may be read by several tasks, so one large file doesn't make one long task; the number of tasks follows from what
    # is to be read, as the index itself is small
    tasks = max(1, min(-(-total // TASK_BYTES), MOST_TASKS), total // (64 * TASK_BYTES))
    dealt = wanted.repartition(tasks, F.col("file"), F.floor(F.col("offset") / TASK_BYTES))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    return read(write(decide(pages), folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 100
"""
