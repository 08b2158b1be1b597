"""Operator 12 — WARC archives and revisit resolution.

Archives are WARC/1.1 files of bounded size, gzipped: a task puts its rows'
records together until an archive is full and hands it on as one text value,
which Spark's text writer writes as one file (so its committer keeps each
task's files whole, on any file system Spark can write).  Reading goes through
the binary file source, an archive a row; a record's length header leads from
record to record, so payloads may hold any bytes.

Revisits are resolved on headers alone: they are shuffled by payload digest (and
length), every group's smallest row id becomes the original by a map-side
minimum, and the other records join their original.  The archives are then
written anew, each from its old one with the decisions of its own records:
responses keep their block, revisits lose the payload and say where it is, and
all get fresh record ids, made from the old ones so that a repeated task writes
the same.  Payloads are not shuffled as long as the decisions are few enough to
be sent to every task (``SENT_ROWS``, counted); beyond, archives and decisions
meet by archive name.

A null page is an empty payload, a null id or url leaves its header out (such
records come last as originals); ties of ids go to the smaller record id, the
others are revisits of it, so of repeated rows one is the response.  Control
characters and blanks of a url are percent-encoded.  Records of other types are
skipped in reading; one without a payload digest gets its digest computed.  An
empty table gives empty archives and no rows; other columns are not read.  A
record longer than an archive is an archive of its own, of 2 GB at most.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.session import scratch_path

from .common import release, small, stored, text_bytes

#: Bytes of records in an archive before compression, and decisions that are sent to every task at most.
ARCHIVE_BYTES, SENT_ROWS = 8 << 20, 200_000
#: Payloads shorter than this always stay responses.
MIN_BYTES = 0

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROW, REFERS_ROW = "X-Row-ID", "X-Refers-To-Row-ID"
_ESCAPED = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends behind it."""
    lines = [VERSION.decode(), f"WARC-Type: {kind}"] + [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + END + block


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}".encode() + END


def response(record_id: str, row: int | None, url: str | None, date: str, payload: bytes) -> bytes:
    """The record of one page."""
    fields = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
              (ROW, row), ("Content-Type", "application/http;msgtype=response")]
    return record("response", fields, http_head(len(payload)) + payload)


def records(content: bytes):
    """(fields by lower-case name, block) of each record of an archive, gzipped (one member or many) or plain."""
    raw = io.BytesIO(content)
    source = gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue   # the line ends between records
        fields = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, source.read(int(fields.get("content-length") or 0))


def payload_of(fields: dict, block: bytes) -> tuple[bytes, int]:
    """(payload in the record, bytes of the full payload)."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(END)
    if fields["warc-type"] != "revisit":
        return body, len(body)
    length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return body, int(length.group(1)) if length else 0


def text_values(values: list[bytes]) -> pa.Array:
    """A string column of raw bytes (as the input had them)."""
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(values))])


def archive_rows(parts, archive_bytes: int):
    """A row for each full archive of the records."""
    held, size = [], 0
    for part in parts:
        if held and size + len(part) > archive_bytes:
            yield pa.RecordBatch.from_arrays([text_values([END.join(held)])], ["value"])
            held, size = [], 0
        held.append(part)
        size += len(part) + len(END)
    if held:
        yield pa.RecordBatch.from_arrays([text_values([END.join(held)])], ["value"])
    release()


def written(archives: DataFrame, folder: str) -> None:
    """Each row a file; the writer's line end is what ends a record."""
    archives.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)


def write_archives(pages: DataFrame, folder: str, row: str = "page_id", date: str = "2000-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A response record for every row (``row``, url, html), in archives under ``folder``; no shuffle."""
    run_id = uuid.uuid4().hex

    def run(batches):
        def parts():
            place = TaskContext.get().partitionId()
            number = 0
            for batch in batches:
                ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                data, offsets = text_bytes(batch.column(2))
                for k, (id_, url) in enumerate(zip(ids, urls)):
                    key = hashlib.sha1(f"{run_id}/{place}/{number}".encode()).hexdigest()
                    number += 1
                    url = None if url is None else _ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", url)
                    yield response(f"urn:uuid:{uuid.UUID(key[:32])}", id_, url, date, data[offsets[k]:offsets[k + 1]].tobytes())
        yield from archive_rows(parts(), archive_bytes)

    written(pages.select(F.col(row).cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value string"), folder)


HEADS = ("archive string, place int, record_id string, kind string, row_id long, url string, date string, payload_digest string, payload_bytes long, "
         "refers_to string, refers_row long")


def whole(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?\d{1,19}", value) else None


def head_of(fields: dict, block: bytes) -> tuple:
    """The columns of HEADS behind the first two, and the payload in the record."""
    payload, full = payload_of(fields, block)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or payload_digest(payload)
    return (fields.get("warc-record-id", "").strip("<>"), fields["warc-type"], whole(fields.get(ROW.lower())), fields.get("warc-target-uri"), fields.get("warc-date"),
            digest, full, fields.get("warc-refers-to", "").strip("<>") or None, whole(fields.get(REFERS_ROW.lower()))), payload


def archives_of(spark, folder: str) -> DataFrame:
    """(archive, content): a row for each file."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("archive"), "content")


def read_records(spark, folder: str, payloads: bool = False) -> DataFrame:
    """The headers (and payloads) of all response and revisit records."""
    names = [f.split()[0] for f in HEADS.split(", ")]
    types = {"place": pa.int32(), "row_id": pa.int64(), "payload_bytes": pa.int64(), "refers_row": pa.int64(), "payload": pa.binary()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip([*names, *["payload"] * payloads], zip(*rows))],
                                          [*names, *["payload"] * payloads])

    def run(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for place, (fields, block) in enumerate(records(content.as_py())):
                    if fields.get("warc-type") in ("response", "revisit"):
                        head, payload = head_of(fields, block)
                        rows.append((archive, place, *head, *[payload] * payloads))
                        size += len(payload) * payloads
                    if len(rows) >= 10_000 or size > ARCHIVE_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)
        release()

    return archives_of(spark, folder).mapInArrow(run, HEADS + ", payload binary" * payloads)


def revisits_of(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(archive, place, first): the responses whose payload another one has, with that original.

    A payload that few rows or a third of all share costs the same: the minimum
    is taken map-side, and only payloads that occur twice go into the join.
    """
    open_ = heads.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes))
    first = F.min(F.struct(F.col("row_id").isNull().alias("no_row"), "row_id", "record_id", "url", "date")).alias("first")
    originals = stored(open_.groupBy("payload_digest", "payload_bytes").agg(first, F.count("*").alias("records")).where("records > 1").drop("records"), "warc-originals")
    return (open_.select("archive", "place", "record_id", "payload_digest", "payload_bytes").join(small(originals), ["payload_digest", "payload_bytes"])
            .where(F.col("record_id") != F.col("first.record_id")).select("archive", "place", "first"))


def fresh_id(record_id: str) -> str:
    return f"urn:uuid:{uuid.UUID(hashlib.sha1(('deduplicated ' + record_id).encode()).hexdigest()[:32])}"


def rewritten(fields: dict, block: bytes, first: dict | None) -> bytes:
    """The record with fresh headers; as a revisit of ``first`` if there is one."""
    (record_id, kind, row, url, date, digest, full, refers, refers_row), _ = head_of(fields, block)
    head = [("WARC-Record-ID", f"<{fresh_id(record_id)}>"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + digest), (ROW, row)]
    if first is None:
        more = [("WARC-Refers-To", refers and f"<{fresh_id(refers)}>"), (REFERS_ROW, refers_row), ("WARC-Profile", fields.get("warc-profile"))]
        return record(kind, [*head, *more, ("Content-Type", fields.get("content-type"))], block)
    http = block.partition(END)[0] + END if fields.get("content-type", "").startswith("application/http") else http_head(full)
    more = [("WARC-Refers-To", f"<{fresh_id(first['record_id'])}>"), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", first["date"]),
            (REFERS_ROW, first["row_id"]), ("WARC-Profile", PROFILE), ("Content-Type", "application/http;msgtype=response")]
    return record("revisit", head + more, http)


def deduplicate(spark, folder: str, target: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the archives of ``folder`` anew under ``target``, repeated payloads as revisits of one original."""
    heads = stored(read_records(spark, folder), "warc-heads")
    revisits = stored(revisits_of(heads, min_bytes), "warc-revisits")
    decisions = revisits.groupBy("archive").agg(F.collect_list(F.struct("place", "first")).alias("decisions"))   # an archive's records at most
    if revisits.count() <= SENT_ROWS:
        decisions = F.broadcast(decisions)

    def run(batches):
        for batch in batches:
            for content, chosen in zip(batch.column(0), batch.column(1).to_pylist()):
                firsts = {d["place"]: d["first"] for d in chosen or []}
                yield from archive_rows((rewritten(fields, block, firsts.get(place)) for place, (fields, block) in enumerate(records(content.as_py()))
                                         if fields.get("warc-type") in ("response", "revisit")), archive_bytes)

    written(archives_of(spark, folder).join(decisions, "archive", "left").select("content", "decisions").mapInArrow(run, "value string"), target)


def restored(spark, folder: str) -> DataFrame:
    """Every record with its full payload: revisits join the response that they refer to."""
    rows = read_records(spark, folder, payloads=True)
    own = rows.where("kind = 'response'")
    back = (rows.where("kind = 'revisit'").drop("payload")
            .join(own.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to", "left").select(*own.columns))
    return own.unionByName(back)


def op12_warc_revisits(spark, sf_dir: str) -> DataFrame:
    """Registered query: all pages written as archives, deduplicated, and their records read back."""
    raw, target = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc-deduplicated")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw)
    deduplicate(spark, raw, target)
    return read_records(spark, target).select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
                                              F.col("refers_row").alias("refers_to"))


OP12_SQL = """
WITH digested AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
based AS (
  SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM digested),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first,
    row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id NULLS LAST) AS place FROM based)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first END AS refers_to
FROM firsts"""
