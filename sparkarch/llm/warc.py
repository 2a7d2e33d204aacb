"""WARC archives: writing pages as segmented records with chunked transfer framing, and reassembling them.

A record whose block is longer than a segment is cut: the first part keeps its type and number 1, the others are continuation
records that name the first one's id as origin; the last states the total length. Archives go through Spark's text writer,
hence to any file system that Spark can write, with its commit protocol.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, hot_keys, new_path, small, spread_join, table

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for i in range(0, len(payload), chunk_bytes):
        part = payload[i : i + chunk_bytes]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


class Unchunker:
    """Takes the bytes of an HTTP message piece by piece and gives those of its payload; nothing else is kept.

    Without chunked framing all after the headers is payload. ``problem`` names what is wrong with the framing, or is None.
    """

    def __init__(self) -> None:
        self.held, self.state, self.left, self.problem = b"", "headers", 0, None

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while self.held or self.state == "trailer":
            if self.state == "plain":
                out, self.held = self.held, b""
                yield out
            elif self.state == "data":
                out, self.held = self.held[: self.left], self.held[self.left :]
                self.left -= len(out)
                if not self.left:
                    self.state = "data end"
                yield out
            elif self.state == "data end":
                if len(self.held) < 2:
                    return
                if self.held[:2] != b"\r\n":
                    self.problem = self.problem or "chunk end"
                self.held, self.state = self.held[2:], "size"
            elif self.state == "size":
                line, sep, rest = self.held.partition(b"\r\n")
                if not sep:
                    return
                try:
                    self.left = int(line.split(b";")[0], 16)
                except ValueError:
                    self.problem, self.state, self.held = "chunk size", "over", b""
                    return
                self.held, self.state = rest, "data" if self.left else "trailer"
            elif self.state == "trailer":
                line, sep, rest = self.held.partition(b"\r\n")
                if not sep:
                    return
                self.held = rest
                if not line:
                    self.state = "over"
            elif self.state == "headers":
                head, sep, rest = self.held.partition(b"\r\n\r\n")
                if not sep:
                    return
                self.held, self.state = rest, "size" if b"transfer-encoding: chunked" in head.lower() else "plain"
            else:  # over
                self.problem, self.held = self.problem or "bytes after the last chunk", b""

    def end(self) -> str | None:
        """What is wrong once all bytes are in."""
        return self.problem or (None if self.state in ("over", "plain") else "truncated")


def record(kind: str, record_id: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:{record_id}>".encode(), b"WARC-Date: 2024-01-01T00:00:00Z"]
    lines += [f"{k}: {v}".encode() for k, v in headers if v is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """A header value has no line breaks or control characters."""
    return None if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, name: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations. name: unlike that of any other row."""
    record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    common = [("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id)]
    if is_revisit:
        yield record("revisit", record_id, [*common, ("WARC-Profile", REVISIT), ("Refers-To-Page-ID", refers_to), ("Content-Type", "application/http; msgtype=response")], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(block) <= segment_bytes:
        yield record("response", record_id, [*common, kind], block)
        return
    last = (len(block) - 1) // segment_bytes
    for i in range(last + 1):
        part = block[i * segment_bytes : (i + 1) * segment_bytes]
        if not i:
            yield record("response", record_id, [*common, kind, ("WARC-Segment-Number", 1)], part)
        else:
            yield record("continuation", str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{i}")), [("WARC-Segment-Origin-ID", f"<urn:uuid:{record_id}>"), ("WARC-Segment-Number", i + 1), ("WARC-Segment-Total-Length", len(block) if i == last else None)], part)


def write_archives(pages: DataFrame, path: str, payload: str = "html", segment_bytes: int = 16 << 10, chunk_bytes: int = 4096, archive_bytes: int = 32 << 20) -> None:
    """Write a record per row of ``pages`` (``page_id``, ``url``, payload) to gzip archives in the folder ``path``.

    Of rows with equal payloads of at least 100 bytes those with the smallest page_id become responses and the others revisits
    that name it; a null page_id is larger than any other. A null payload is empty. An archive is closed at ``archive_bytes``
    before compression, so a task holds no more than that and one page.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    again = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    again = cut(again)
    first = again.select("digest", "first")
    marked = spread_join(rows, first, ["digest"], ["page_id", "url"], "left", None if few(first) else hot_keys(again, ["digest"]))  # no shorter payload has such a digest
    marked = marked.select("page_id", "url", "payload", "digest", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), F.monotonically_increasing_id().alias("row"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for page_id, url, data, digest, first, revisit, row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first", "revisit", "row")), strict=True):
                for x in page_records(page_id, url, data, digest, first, revisit, f"{page_id}/{digest}/{row}", segment_bytes, chunk_bytes):
                    held.append(x)
                    n += len(x)
                    if n >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-4]], pa.binary())], ["archive"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-4]], pa.binary())], ["archive"])

    # the line separator is what ends a record; the bytes of a string are written as they are
    out = marked.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").option("compression", "gzip").mode("overwrite").text(path)


def parse_archive(content: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or of one or more gzip members.

    Record lengths are taken from Content-Length alone, so blocks may hold anything. Decompressed bytes are held for a record
    and a step at a time.
    """

    def plain() -> Iterator[bytes]:
        view = memoryview(content)
        if content[:2] != b"\x1f\x8b":
            for i in range(0, len(content), step):
                yield bytes(view[i : i + step])
            return
        at, member = 0, zlib.decompressobj(31)
        while at < len(content) or member.unconsumed_tail:
            data = member.unconsumed_tail
            if not data:
                data = view[at : at + step]
                at += len(data)
            yield member.decompress(data, step)
            if member.eof:
                at -= len(member.unused_data)
                member = zlib.decompressobj(31)

    source, buffer, over = plain(), bytearray(), False

    def more() -> bool:
        nonlocal over
        data = next(source, None)
        over = data is None
        if data:
            buffer.extend(data)
        return not over

    while True:
        while (end := buffer.find(b"\r\n\r\n", 4)) < 0 and more():
            pass
        while buffer[:2] == b"\r\n":
            del buffer[:2]
            end -= 2
        if end < 0:
            if buffer.strip():
                raise ValueError("an archive ends within a record's headers")
            return
        first, *lines = bytes(buffer[:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers = {k.strip().decode().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        while len(buffer) < stop and more():
            pass
        if len(buffer) < stop:
            raise ValueError("an archive ends within a record's block")
        block = bytes(buffer[end + 4 : stop])
        del buffer[:stop]
        yield headers, block


def _payload(blocks: Iterator[bytes], keep: bool) -> tuple[int, str, str | None, bytes | None]:
    """Length, SHA-256, problem and, if kept, bytes of the payload of a message given in pieces."""
    reader, digest, n, kept = Unchunker(), hashlib.sha256(), 0, []
    for block in blocks:
        for part in reader.feed(block):
            digest.update(part)
            n += len(part)
            if keep:
                kept.append(part)
    return n, digest.hexdigest(), reader.end(), b"".join(kept) if keep else None


_OUT = "record_id string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, problem string, payload binary"
_OUT_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string()), ("payload", pa.binary())])
_PART = "record_id string, record_type string, page_id long, refers_to long, stated_digest string, segment int, origin string, total_length long, block binary"
_PART_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total_length", pa.int64()), ("block", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _head(headers: dict[str, str]) -> dict:
    number = lambda k: int(headers[k]) if k in headers else None
    digest = headers.get("warc-payload-digest")
    return {
        "record_id": headers["warc-record-id"], "record_type": headers["warc-type"], "page_id": number("page-id"), "refers_to": number("refers-to-page-id"),
        "stated_digest": digest and digest.removeprefix("sha256:"), "segment": number("warc-segment-number"), "origin": headers.get("warc-segment-origin-id"), "total_length": number("warc-segment-total-length"),
    }


class _Message:
    """A record's payload, fed in pieces."""

    def __init__(self, keep: bool) -> None:
        self.reader, self.digest, self.n, self.kept = Unchunker(), hashlib.sha256(), 0, [] if keep else None

    def feed(self, block: bytes) -> None:
        for part in self.reader.feed(block):
            self.digest.update(part)
            self.n += len(part)
            if self.kept is not None:
                self.kept.append(part)

    def close(self, head: dict, problem: str | None) -> tuple:
        if head["record_type"] == "revisit":
            return head["record_id"], "revisit", head["page_id"], head["refers_to"], None, head["stated_digest"], problem, None
        digest = self.digest.hexdigest()
        problem = problem or self.reader.end() or ("digest" if head["stated_digest"] not in (None, digest) else None)
        return head["record_id"], head["record_type"], head["page_id"], head["refers_to"], self.n, digest, problem, b"".join(self.kept) if self.kept is not None else None


def _batches(found: Iterator[tuple[tuple, int]], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, each with its size in bytes, as batches of a few MB."""
    rows, n = [], 0
    for row, size in found:
        rows.append(row)
        n += size + 200
        if n >= most:
            yield _rows(rows, schema)
            rows, n = [], 0
    if rows:
        yield _rows(rows, schema)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per whole record of the archives in a folder.

    ``record_id``, ``record_type``, ``page_id``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` (SHA-256; for a
    revisit null and the digest it states), ``problem`` (null if none) and, if asked for, ``payload``. Records in one part are
    decoded where they are read. Segments are grouped by origin and ordered by number: an exchange by origin, sorted, that each
    task reads as a stream, holding one segment at a time (and the payload, if that is asked for). Missing or repeated numbers, a
    wrong total length, broken framing and a digest that differs from the one stated are problems; the row stays.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for content in batch.column("content"):
                    for headers, block in parse_archive(content.as_py()):
                        head = _head(headers)
                        if head["segment"] is None and head["origin"] is None:
                            message = _Message(payload)
                            message.feed(block)
                            yield message.close(head, None), len(block) if payload else 0

        yield from _batches(found(), _OUT_ARROW)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for content in batch.column("content"):
                    for headers, block in parse_archive(content.as_py()):
                        head = _head(headers)
                        if head["segment"] is not None or head["origin"] is not None:
                            yield (*(head[f] for f in _PART_ARROW.names[:-1]), block), len(block)

        yield from _batches(found(), _PART_ARROW)

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[tuple, int]]:
            name = None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["name"] != name:
                        if name is not None:
                            yield close()
                        name, message, last, length, total, problem = r["name"], _Message(payload), 0, 0, None, None
                        head = dict(record_id=name, record_type="continuation", page_id=None, refers_to=None, stated_digest=None)
                    if r["origin"] is None:
                        head = r
                    if r["segment"] != last + 1:
                        problem = problem or ("repeated segment" if r["segment"] == last else "missing segment")
                    last, length, total = r["segment"], length + len(r["block"]), r["total_length"] if r["total_length"] is not None else total
                    message.feed(r["block"])

                    def close(message=message, head=head, problem=problem, length=length, total=total) -> tuple[tuple, int]:
                        return message.close(head, problem or (None if total == length else "total length")), message.n if payload else 0

            if name is not None:
                yield close()

        yield from _batches(found(), _OUT_ARROW)

    parts = files.mapInArrow(segments, _PART).withColumn("name", F.coalesce("origin", "record_id"))
    parts = parts.repartition("name").sortWithinPartitions("name", "segment").mapInArrow(join_parts, _OUT)
    return files.mapInArrow(whole, _OUT).unionByName(parts)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` with each revisit's ``payload_bytes`` taken from the response that it names (by page and digest)."""
    sizes = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    revisits = records.filter("record_type = 'revisit'")
    named = sizes.join(small(revisits.select(F.col("refers_to").alias("__page"), F.col("payload_digest").alias("__digest")).distinct()), ["__page", "__digest"], "left_semi")
    found = revisits.join(named, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    found = found.withColumn("payload_bytes", F.col("__bytes")).drop("__page", "__digest", "__bytes")
    return records.filter("record_type <> 'revisit'").unionByName(found)


def op1_segmented_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written to archives in the shared folder and read back: a row per page, null html as an empty payload, repeated rows each."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = cut(read_archives(spark, path, payload=False).drop("payload"))
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM q
"""
