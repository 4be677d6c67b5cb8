"""WARC archives: writing with revisits and segments, and reading with segment reassembly.

Each record is a gzip member of its own. A response's block is an HTTP message
with a chunked body; a block longer than a segment is cut into a first record
and continuation records, which name the first as their origin and carry their
number, the last also the total length. Reading joins the segments again,
checks the total length, takes the chunked framing off and checks the digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_spark.llm.batches import a_task_each, read_file, write_file

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 8 * 1024
READ_BYTES = 1 << 20
EMIT_BYTES = 8 << 20  # of payloads or blocks in one batch, beyond a single longer one
# Fixed values of the public WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # written where the caller has no capture time
RESULT = "key {key}, payload_bytes long, payload_digest string, record_type string, refers_to {key}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(part), part) for part in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The content of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def record(kind: str, record_id: str, block: bytes, fields: dict[str, object]) -> bytes:
    """One gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **fields, "Content-Length": len(block)}
    lines = [VERSION, *(f"{name}: {' '.join(str(value).split())}" for name, value in head.items() if value is not None)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_records(key: object, url: str | None, payload: bytes, first: object, digest: str) -> Iterator[bytes]:
    """The records of one page: a revisit of ``first``, or a response in as many segments as it needs."""
    name = f"urn:uuid:{uuid.uuid4()}"
    fields = {"WARC-Target-URI": url or None, "WARC-Payload-Digest": f"sha1:{digest}", "Page-Id": key}
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "Refers-To-Page-Id": first}
        yield record("revisit", name, status + b"Content-Length: %d\r\n\r\n" % len(payload), fields)
        return
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    yield record("response", name, cuts[0], fields | ({"WARC-Segment-Number": 1} if len(cuts) > 1 else {}))
    for number, cut in enumerate(cuts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if number == len(cuts) else {}
        own = {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": number, "WARC-Target-URI": url or None}
        yield record("continuation", f"urn:uuid:{uuid.uuid4()}", cut, own | last)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for each row and return the manifest: file, n_records.

    Of rows with equal payloads of at least ``least_bytes`` the one with the
    smallest key is the response, the others are revisits of it. A null payload
    is empty. Rows with a null key are responses and never referred to; rows
    that repeat the smallest key of their payload are responses each. Equal
    payloads are found by SHA-1 and length. Files of failed attempts stay out
    of the manifest, a table in ``folder``: it is computed once.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("h"), F.sha1(body.cast("binary")).alias("d"), F.octet_length(body).alias("n"))
    alike = rows.where(F.col("k").isNotNull() & (F.col("n") >= least_bytes)).groupBy(F.col("d").alias("d2"), F.col("n").alias("n2"))
    firsts = alike.agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").drop("last")
    marked = rows.join(firsts, (F.col("d") == F.col("d2")) & (F.col("n") == F.col("n2")), "left")
    marked = marked.select("k", "u", "h", F.when(F.col("k") > F.col("first"), F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sink, written = TaskContext.get(), None, 0
        name = f"{folder}/pages-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for k, u, h, first in zip(*(column.to_pylist() for column in batch.columns)):
                sink = sink or write_file(name)
                payload = h.encode("utf-8")
                for data in page_records(k, u, payload, first, digest_of(payload)):
                    sink.write(data)
                    written += 1
        if sink:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written])], ["file", "n_records"])

    marked.mapInArrow(write, "file string, n_records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def members(uri: str) -> Iterator[bytes]:
    """The contents of a file's gzip members, one after the other."""
    with read_file(uri) as source:
        unpacker, parts, data = zlib.decompressobj(31), [], b""
        while data or (data := source.read(READ_BYTES)):
            parts.append(unpacker.decompress(data))
            data = b""
            if unpacker.eof:
                yield b"".join(parts)
                unpacker, parts, data = zlib.decompressobj(31), [], unpacker.unused_data
        if any(parts):
            raise ValueError(f"{uri} ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a record of its stated length")
    return fields, rest[:size]


def page_of(kind: str, key: str | None, refers_to: str | None, stated: str, block: bytes) -> tuple:
    """The result row of a whole record and its payload, checked against the stated digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    digest = stated.removeprefix("sha1:")
    if kind == "revisit":
        return (key, int(fields[b"content-length"]), digest, kind, refers_to), None
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    if digest_of(payload) != digest:
        raise ValueError(f"the payload of page {key} does not match its digest")
    return (key, len(payload), digest, kind, None), payload


def result_batch(rows: list[tuple], payloads: list[bytes | None], with_payload: bool) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])]
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if with_payload:
        columns, names = [*columns, pa.array(payloads, pa.binary())], [*names, "payload"]
    return pa.RecordBatch.from_arrays(columns, names)


def read_archives(manifest: DataFrame, key: str = "page_id", key_type: str = "bigint", payload: bool = False) -> DataFrame:
    """Each page's ``key``, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload (null for revisits).

    Records in one piece are decoded where they are read. Segments, and only
    they, are shuffled: grouped by their origin, ordered by number, checked for
    gaps and total length, joined and decoded. A group is one record's.
    """
    files = a_task_each(manifest.select("file"))
    text = RESULT.format(key="string") + (", payload binary" if payload else "")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bodies, held = [], [], 0
        for file in (name for batch in batches for name in batch.column(0).to_pylist()):
            for fields, block in map(parse, members(file)):
                if "warc-segment-number" in fields:
                    continue
                row, body = page_of(fields["warc-type"], fields.get("page-id"), fields.get("refers-to-page-id"), fields["warc-payload-digest"], block)
                rows.append(row)
                bodies.append(body)
                held += 200 + (len(body or b"") if payload else 0)
                if held > EMIT_BYTES:
                    yield result_batch(rows, bodies, payload)
                    rows, bodies, held = [], [], 0
        if rows:
            yield result_batch(rows, bodies, payload)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "number", "total", "page", "stated", "block"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        rows, held = [], 0
        for file in (name for batch in batches for name in batch.column(0).to_pylist()):
            for fields, block in map(parse, members(file)):
                if "warc-segment-number" not in fields:
                    continue
                total = fields.get("warc-segment-total-length")
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                rows.append((origin, int(fields["warc-segment-number"]), int(total) if total else None, fields.get("page-id"), fields.get("warc-payload-digest"), block))
                held += len(block)
                if held > EMIT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bodies = [], []
            for page, stated, total, parts in zip(*(column.to_pylist() for column in batch.columns)):
                block = b"".join(part["block"] for part in parts)
                if [part["number"] for part in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"segments of page {page} are missing or not of the stated total length")
                row, body = page_of("response", page, None, stated, block)
                rows.append(row)
                bodies.append(body)
            if rows:
                yield result_batch(rows, bodies, payload)

    cut = files.mapInArrow(segments, "origin string, number long, total long, page string, stated string, block binary")
    grouped = cut.groupBy("origin").agg(
        F.max("page").alias("page"),
        F.max("stated").alias("stated"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
    )
    read = files.mapInArrow(whole, text).unionByName(grouped.drop("origin").mapInArrow(joined, text))
    typed: list[Column] = [F.col("key").cast(key_type).alias(key), F.col("payload_bytes"), F.col("payload_digest"), F.col("record_type"), F.col("refers_to").cast(key_type)]
    return read.select(*typed, *(["payload"] if payload else []))
