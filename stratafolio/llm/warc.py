"""WARC archives: one gzip member per record, written by tasks and read sequentially.

Writing turns exact payload repeats into revisit records. Reading streams a file in bounded pieces: it inflates
incrementally, frames each record by its Content-Length and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafolio.llm._shared import open_fs, shared_dir, spread

#: Bytes that one read asks the store for.
PIECE = 1 << 18
#: A hot payload's rows are split over so many salts before they are joined.
SALTS = 64
#: Reading tasks at most; beyond that a task reads several files.
MOST_TASKS = 100_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, record_offset long, record_id string, record_type string, target_uri string, page_id long, payload_bytes long, "
    "payload_digest string, refers_to long, verified boolean, payload binary"
)


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def sha1_label(data: bytes) -> str:
    """The usual label of a digest in WARC headers."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------------------------------------------------------- roles


def roles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """Per page: page_id, url, payload (UTF-8 bytes, null is empty), payload_digest, record_type, refers_to.

    Of equal payloads of at least ``least_bytes`` the row with the largest page_id is the response and the others revisit it.
    Rows that repeat that page_id and payload are all responses; a null page_id revisits any id, and is a response where all
    ids are null. Smaller payloads are always responses.

    A payload may belong to a third of all pages: ids are pre-aggregated by (digest, salt), then by digest, and come back by
    (digest, salt), so no join key has more than a salt's share of the rows.
    """
    payload = F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    large = F.octet_length("payload") >= least_bytes
    by_salt = base.filter(large).groupBy("payload_digest", "salt").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    by_digest = by_salt.groupBy("payload_digest").agg(F.max("top").alias("first_id"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    firsts = by_salt.select("payload_digest", "salt").join(by_digest, "payload_digest")
    joined = base.join(firsts, ["payload_digest", "salt"], "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & large
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


# -------------------------------------------------------------------------------------------------------------- writing


def record_urn(page_id: int | None, digest: str) -> str:
    """The record id of a page's payload; made from both, so that a revisit can name its response without looking it up."""
    h = hashlib.md5(f"{page_id}:{digest}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _header_value(text: str) -> str:
    """A header line's value: control characters would end the line, so they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record before compression. A revisit keeps the HTTP headers, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_urn(page_id, digest)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url) if url else 'about:blank'}", "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: {sha1_label(block)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_urn(refers_to, digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes rows of :func:`roles` to .warc.gz files below ``folder``, one per task, and returns their manifest.

    Names hold the task attempt, and only attempts that succeeded reach the manifest, so a retried task leaves no duplicate.
    An empty partition writes no file.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, path, n = TaskContext.get(), None, "", 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, root = open_fs(folder)
                    store.create_dir(root, recursive=True)
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{root}/{name}", compression=None)
                data = record_bytes(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"], date)
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(deflate.compress(data) + deflate.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    spark = records.sparkSession
    manifest = f"{folder}/_manifest"
    records.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(task, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


# -------------------------------------------------------------------------------------------------------------- reading


@dataclass
class Record:
    """A record as read: its headers by lower-case name, its block, and where its gzip member starts."""

    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class _Members:
    """The inflated bytes of a file of gzip members, piece by piece; ``offset`` is where the current member starts."""

    def __init__(self, source: BinaryIO, piece: int = PIECE):
        self.source, self.piece = source, piece
        self.raw = b""  # read from the file and not yet inflated
        self.at = self.offset = 0
        self.inflate = zlib.decompressobj(31)

    def next_member(self) -> bool:
        """Moves to the next member; False at the end of the file."""
        self.inflate = zlib.decompressobj(31)
        self.raw = self.raw or self.source.read(self.piece)
        self.offset = self.at
        return bool(self.raw)

    def read(self) -> bytes:
        """More bytes of the current member, at most a piece of them; empty at its end."""
        while not self.inflate.eof:
            self.raw = self.raw or self.source.read(self.piece)
            out = self.inflate.decompress(self.raw, self.piece)
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if not (out or self.raw or self.inflate.eof):
                raise WarcError(f"the member at {self.offset} is cut off")
            self.at += len(self.raw) - len(left)
            self.raw = left
            if out:
                return out
        return b""


def read_records(source: BinaryIO, piece: int = PIECE) -> Iterator[Record]:
    """The records of an open archive, one after the other; memory holds one record and one piece."""
    members = _Members(source, piece)
    while members.next_member():
        record, buffer = Record(members.offset), b""
        while b"\r\n\r\n" not in buffer:
            if not (more := members.read()):
                raise WarcError(f"no end of headers in the record at {record.offset}")
            buffer += more
        head, _, rest = buffer.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise WarcError(f"no WARC version line at {record.offset}")
        record.headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        try:
            length = int(record.headers["content-length"])
        except (KeyError, ValueError) as wrong:
            raise WarcError(f"no Content-Length in the record at {record.offset}") from wrong
        parts, have = [rest], len(rest)
        while have < length + 4 and (more := members.read()):
            parts.append(more)
            have += len(more)
        body = b"".join(parts)
        if have != length + 4 or body[length:] != b"\r\n\r\n" or members.read():
            raise WarcError(f"the record at {record.offset} doesn't have the length that it states")
        record.block = body[:length]
        yield record


def digest_of(label: str | None) -> str | None:
    """The digest of a label "algorithm:value" as lower-case hex; the value may be hex or Base32. None for what is neither."""
    _, colon, value = (label or "").strip().partition(":")
    if not colon:
        return None
    if re.fullmatch(r"[0-9a-fA-F]+", value) and len(value) in (32, 40, 64, 96, 128):
        return value.lower()
    try:
        return base64.b32decode(value.upper() + "=" * (-len(value) % 8)).hex()
    except ValueError:
        return None


def holds(label: str | None, data: bytes) -> bool:
    """Whether a digest label fits the data; a missing one does, and so does one of an algorithm that hashlib lacks, as it can't tell."""
    algorithm = (label or "").strip().partition(":")[0].lower().replace("-", "")
    if not label or algorithm not in hashlib.algorithms_guaranteed or algorithm.startswith("shake"):
        return True
    return digest_of(label) == hashlib.new(algorithm, data).hexdigest()


def verify(record: Record) -> tuple[bool, bytes, int]:
    """Whether the digests hold, the payload, and the full payload's length: by the HTTP headers for HTTP messages, else the block's."""
    if not record.headers.get("content-type", "").lower().startswith("application/http"):
        return holds(record.headers.get("warc-block-digest"), record.block) and holds(record.headers.get("warc-payload-digest"), record.block), record.block, len(record.block)
    head, _, payload = record.block.partition(b"\r\n\r\n")
    m = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    length = int(m[1]) if m else len(payload)
    good = holds(record.headers.get("warc-block-digest"), record.block)
    if record.headers.get("warc-type") != "revisit":
        good &= len(payload) == length and holds(record.headers.get("warc-payload-digest"), payload)
    return good, payload, length


def read_warc(spark: SparkSession, manifest: DataFrame, *, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (a column ``path``), one row each.

    A file is read by one task, front to back, through the store that its URI names. ``strict`` raises on a record whose digest
    fails; else its row has verified = false. Broken framing always raises. No file: no rows.
    """
    schema = RECORDS if with_payload else RECORDS.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = open_fs(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for r in read_records(source):
                        good, payload, length = verify(r)
                        if strict and not good:
                            raise WarcError(f"a digest fails in {uri} at {r.offset}")
                        h = r.headers
                        row = {
                            "path": uri, "record_offset": r.offset, "record_id": h.get("warc-record-id", "").strip("<>"), "record_type": h.get("warc-type"),
                            "target_uri": h.get("warc-target-uri"), "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "payload_bytes": length,
                            "payload_digest": digest_of(h.get("warc-payload-digest")),
                            "refers_to": int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None, "verified": good, "payload": payload,
                        }
                        rows.append({k: row[k] for k in names})
                        held += 500 + len(payload) * with_payload
                        if held > 1 << 23:
                            yield _batch(rows, with_payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, with_payload)

    return spread(manifest.select("path"), MOST_TASKS).mapInArrow(task, schema)


def _batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    kinds = [
        ("path", pa.string()), ("record_offset", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()),
        ("payload", pa.binary()),
    ]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds if with_payload else kinds[:-1]))


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes all pages to archives below ``folder`` (default: the cluster's shared folder) and returns the manifest."""
    return write_warc(roles(pages, **options), folder or shared_dir(pages.sparkSession, "warc"))
