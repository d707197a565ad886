"""WARC archives written and read as a table of record chunks.

A payload is cut into chunks with running digests; every chunk becomes a record of its own
(the first a response, the following ones its continuation segments), so neither writing nor
reading holds more of a record than a chunk. Equal payloads are stored once: the record with
the smallest page_id is the response, the others are revisits without payload that name it.
Archives are written and read by Spark's own file sources, so any store that Spark reaches
will do.

Defined results: a null html is an empty payload; a null page_id stands after all others and
is written without its field; rows equal in page_id and payload are all responses if theirs
is the smallest page_id; a null url has no target field; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.llm.common import stored

CHUNK_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: refers_to is set where an equal payload comes earlier."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    )
    digest = F.struct(F.sha1("payload"), F.octet_length("payload"))
    firsts = (
        rows.select("page_id", F.octet_length("payload").alias("n"), digest.alias("_digest"))
        .where(F.col("n") >= min_bytes)
        .groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_digest", "_first")
    )
    # Written, so that the join is one of two plain shuffles and hot payloads are split.
    firsts = stored(firsts, "firsts")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return (
        rows.withColumn("_digest", digest)
        .join(firsts, "_digest", "left")
        .select("page_id", "url", "payload", refers.alias("refers_to"))
    )


def chunk_records(marked: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in payload order within a task, as the bytes of a WARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(k)[i] for k in range(4))
                for value in _records(
                    page_id.as_py(), url.as_py(), payload.as_buffer(), refers_to.as_py(), chunk_bytes
                ):
                    values.append(value)
                    size += len(value)
                    if size > 8 * chunk_bytes:
                        yield pa.record_batch([pa.array(values, pa.binary())], names=["value"])
                        values, size = [], 0
            if values:
                yield pa.record_batch([pa.array(values, pa.binary())], names=["value"])

    return marked.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "value binary")


def _records(page_id, url, payload, refers_to, chunk_bytes) -> Iterator[bytes]:
    data, total = memoryview(payload), payload.size
    name = "none" if page_id is None else str(page_id)
    if refers_to is not None:
        digest = base32(hashlib.sha1(data).digest())
        fields = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<urn:page:{name}>"),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("X-Payload-Length", str(total)),
        ]
        yield _record(fields, page_id, url, b"")
        return
    running = hashlib.sha1()
    n_chunks = max(1, -(-total // chunk_bytes))
    for chunk in range(n_chunks):
        part = data[chunk * chunk_bytes : (chunk + 1) * chunk_bytes]
        running.update(part)
        fields = [
            ("WARC-Type", "continuation" if chunk else "response"),
            ("WARC-Record-ID", f"<urn:page:{name}{f':{chunk + 1}' if chunk else ''}>"),
            ("X-Running-Digest", f"sha1:{base32(running.digest())}"),
        ]
        if n_chunks > 1:
            fields.append(("WARC-Segment-Number", str(chunk + 1)))
        if chunk:
            fields.append(("WARC-Segment-Origin-ID", f"<urn:page:{name}>"))
        if chunk == n_chunks - 1:
            fields.append(("WARC-Payload-Digest", f"sha1:{base32(running.digest())}"))
            if chunk:
                fields.append(("WARC-Segment-Total-Length", str(total)))
        yield _record(fields, page_id, url, bytes(part))


def _record(fields: list, page_id, url, block: bytes) -> bytes:
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields += [("WARC-Date", DATE), ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    head = "\r\n".join(["WARC/1.1", *(f"{name}: {value}" for name, value in fields)])
    return (head + _END).encode() + block


def write_archives(marked: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Gzipped archives below ``path``, one per task. The record end is the text source's separator."""
    chunk_records(marked, chunk_bytes).select(F.col("value").cast("string").alias("value")).write.option(
        "lineSep", _END
    ).option("compression", "gzip").text(path)


_CHUNKS = (
    "page_id long, url string, record_type string, chunk int, last boolean, chunk_bytes long, "
    "payload_bytes long, payload_digest string, refers_to long, intact boolean, data binary"
)


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The archives as chunk rows with running lengths and digests, in constant memory a record.

    payload_bytes and payload_digest are those of the payload up to and with the chunk,
    taken from the bytes read; at the ``last`` chunk they are those of the whole payload.
    A revisit has one chunk without data and the figures of the payload it stands for.
    ``intact`` tells whether the archive's own digest agrees.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in _parsed(content.as_buffer()):
                    if not with_data:
                        row["data"] = None
                    rows.append(row)
                    size += len(row["data"] or b"")
                    if len(rows) >= 5000 or size > 1 << 24:
                        yield _chunk_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _chunk_batch(rows)

    return files.mapInArrow(run, _CHUNKS)


_CHUNK_TYPE = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("chunk", pa.int32()),
        ("last", pa.bool_()),
        ("chunk_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("intact", pa.bool_()),
        ("data", pa.binary()),
    ]
)


def _chunk_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _CHUNK_TYPE)


class _Stream:
    """Reads a gzipped buffer piece by piece."""

    def __init__(self, content, step: int = 1 << 18):
        self._data, self._at, self._step = memoryview(content), 0, step
        self._gzip = zlib.decompressobj(31)
        self._ready = bytearray()

    def _more(self) -> bool:
        while self._at < len(self._data):
            piece = self._data[self._at : self._at + self._step]
            self._at += len(piece)
            self._ready += self._gzip.decompress(piece)
            if self._gzip.eof:
                rest = self._gzip.unused_data
                self._at -= len(rest)
                self._gzip = zlib.decompressobj(31)
            return True
        return False

    def until(self, end: bytes) -> bytes | None:
        start = 0
        while (at := self._ready.find(end, start)) < 0:
            start = max(0, len(self._ready) - len(end) + 1)
            if not self._more():
                return None
        found = bytes(self._ready[:at])
        del self._ready[: at + len(end)]
        return found

    def take(self, n: int) -> bytes:
        while len(self._ready) < n and self._more():
            pass
        found = bytes(self._ready[:n])
        del self._ready[:n]
        return found


def _parsed(content) -> Iterator[dict]:
    stream = _Stream(content)
    running, total, first = hashlib.sha1(), 0, {}
    while (head := stream.until(_END.encode())) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        data = stream.take(int(fields["Content-Length"]))
        stream.take(len(_END))
        kind = fields["WARC-Type"]
        row = {
            "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
            "url": fields.get("WARC-Target-URI"),
            "chunk_bytes": len(data),
            "data": data,
        }
        if kind == "revisit":
            yield row | {
                "record_type": kind,
                "chunk": 1,
                "last": True,
                "payload_bytes": int(fields["X-Payload-Length"]),
                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                "refers_to": int(fields["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">")),
                "intact": True,
            }
            continue
        if kind == "response":
            running, total, first = hashlib.sha1(), 0, row
        running.update(data)
        total += len(data)
        digest = base32(running.digest())
        yield row | {
            "record_type": "response",
            "chunk": int(fields.get("WARC-Segment-Number", 1)),
            "last": "WARC-Payload-Digest" in fields,
            "payload_bytes": total,
            "payload_digest": digest,
            "refers_to": None,
            "intact": fields["X-Running-Digest"] == f"sha1:{digest}" and row["page_id"] == first["page_id"],
        }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    return (
        read_chunks(spark, path, with_data=False)
        .where("last")
        .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    )
