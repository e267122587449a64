"""WARC archives: writing pages as records in segments, and reading them back by reassembly.

Writing: a page's block is an HTTP response with a chunked body. A block longer than a segment is split: the first
record has segment number 1, continuation records name the first one as their origin, and the last has the total
length. Of pages with equal payloads of at least `revisit_bytes`, the one with the smallest id is the response, the
others are revisit records that refer to it. Every record is a gzip member of its own, so that a reader can seek to it. Spark's text writer writes
the files (its line separator is the last byte of each member), so archives go wherever Spark can write; a file holds a bounded number of records of bounded length.

Reading: files are read member by member (or as plain archives) and parsed by Content-Length. Whole records are decoded at once; segments are grouped by their origin,
ordered by number, and verified for gaps and total length before the chunk framing is decoded. A record that fails, in its member, its fields, its length or its framing,
is returned with a null payload and its reason in `problem`, never dropped, and reading goes on at the next record.

Nulls: a null payload is empty; a null URL becomes the page's URN; a page with a null id is a response and comes back with a null id. Empty payloads are responses. Repeated rows of an
id are archived and returned once each. Tables without rows give archives without records. Line breaks in URLs are
percent-encoded. Other input columns are not archived. Ids are integers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import shared

SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
RECORDS_PER_FILE = 2048
REVISIT_BYTES = 100
#: How hard members are packed, their first bytes, and bytes that are unpacked at a time.
LEVEL, MAGIC, PIECE = 6, b"\x1f\x8b\x08", 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, origin string, segment int, total_length long, refers_to long, declared_digest string, payload_bytes long, payload binary, block binary, problem string"


# Records as bytes.


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is 0 as long as `data` has less than 2 to the 24 bytes: the file's line separator adds it."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    made = packer.compress(data) + packer.flush()
    if made[-1] != 0:
        raise ValueError("a record is too long for its segment size")
    return made[:-1]


def records_of(page: int | None, row: str, url: str | None, payload: bytes, digest: str, first: int | None, segment_bytes: int) -> list[bytes]:
    """All records of one page; `first` is the page that it revisits."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page}"
    name = f"<urn:page:{page}:{row}>"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    start = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", PROFILE), *common]
        return [record(fields, start + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = start + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common], block)]
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Segment-Number", "1"), *common], pieces[0])]
    for k, piece in enumerate(pieces[1:], start=2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page}:{row}:{k}>"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k)), ("WARC-Date", DATE)]
        out.append(record(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(pieces)), piece))
    return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields with lower-case names, block, problem) of every record of an uncompressed archive; after a broken record reading goes on at the next one that can be found."""
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        block, problem, after = b"", None, -1
        for line in data[at : end if end >= 0 else len(data)].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            fields[key.strip().lower().decode(errors="replace")] = value.strip().decode(errors="replace")
        size = fields.get("content-length", "")
        if end < 0:
            problem = "the fields have no end"
        elif not (size.isascii() and size.isdigit()):
            problem = "no content length"
        elif end + 4 + int(size) > len(data):
            problem = "shorter than the content length"
        else:
            after = end + 4 + int(size)
            block = data[end + 4 : after]
            if missing := [k for k in ("warc-record-id", "warc-type") if k not in fields]:
                problem = f"no {missing[0]}"
        yield fields, block, problem
        if after < 0:
            after = data.find(b"\r\n\r\nWARC/", at + 5)
            if after < 0:
                return
        at = after


def unzipped(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """(content, problem) of every gzip member of a file, or of the whole file if it is not compressed; what is broken is passed over up to the next member."""
    if data[:2] != MAGIC[:2]:
        if data:
            yield data, None
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        unpacker, out, to = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof and to < len(data):
                out.append(unpacker.decompress(view[to : to + PIECE]))
                to += PIECE
            problem = None if unpacker.eof else "the member has no end"
        except zlib.error as error:
            problem = f"the member is broken: {error}"
        yield b"".join(out), problem
        if problem is None:
            at = min(to, len(data)) - len(unpacker.unused_data)
        else:
            at = found if (found := data.find(MAGIC, at + 1)) >= 0 else len(data)


def body_of(block: bytes) -> tuple[bytes | None, int | None]:
    """The payload of an HTTP block, and the length that its header declares."""
    head, _, body = block.partition(b"\r\n\r\n")
    head = head.lower()
    if b"\r\ntransfer-encoding: chunked" in head:
        payload = unchunked(body)
        return payload, len(payload)
    declared = re.search(rb"\r\ncontent-length: (\d+)", head)
    return body, int(declared[1]) if declared else len(body)


# Archives.


def typed(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """id, url, payload, digest and first (the page whose payload it repeats, else null)."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Written, so that the join has an exchange of its own on either side and a digest of very many pages can be split.
    long = rows.where(F.octet_length("payload") >= revisit_bytes)
    firsts = shared.written(long.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least"), "firsts", few_files=True)
    return rows.join(firsts, "digest", "left").withColumn("first", F.when(F.col("least") != F.col("id"), F.col("least"))).drop("least")


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the pages as archives into the folder `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, where, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "first")), strict=True):
                out += (made := records_of(page, f"{task}.{n}", where, payload, digest, first, segment_bytes))
                n += 1
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(map(member, out), pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(map(member, out), pa.binary())], ["value"])

    rows = typed(pages, id, url, html, revisit_bytes).select("id", "url", "payload", "digest", "first")
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def page_of(name: str | None) -> int | None:
    """The page id in a record's name; null where there is none."""
    found = re.match(r"<urn:page:(-?\d+)[:>]", name or "")
    return int(found[1]) if found else None


def row_of(fields: dict[str, str], block: bytes, problem: str | None) -> dict:
    """A RECORD of a record's fields and block; one with a problem has neither segment nor payload."""
    name, number, total = fields.get("warc-record-id"), fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    row = {"page_id": page_of(name), "record_type": fields.get("warc-type"), "refers_to": page_of(fields.get("warc-refers-to")), "problem": problem}
    row |= {"origin": fields.get("warc-segment-origin-id", name), "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None}
    if problem:
        return row
    try:
        if number:
            row |= {"segment": int(number), "total_length": int(total) if total else None, "block": block}
        else:
            row["payload"], row["payload_bytes"] = body_of(block)
    except ValueError as error:
        row["problem"] = str(error)
    if row["record_type"] == "revisit":
        row["payload"] = None
    return row


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder (RECORD): whole ones with their payload, segments with their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("block", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data, broken in unzipped(content.as_py()):
                    found = False
                    for fields, block, problem in parsed(data):
                        found = True
                        rows.append(row_of(fields, block, problem or broken))
                        size += len(block)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if not found:
                        rows.append({"problem": broken or "no record"})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """One record (page_id, record_type, refers_to, declared_digest, payload_bytes, payload, problem) for each origin of the segments."""
    grouped = segments.groupBy("origin").agg(F.collect_list(F.struct("segment", "block")).alias("pieces"), F.max("total_length").alias("total"), F.max("page_id").alias("page_id"), F.max("declared_digest").alias("declared_digest"), F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads: list[bytes | None] = []
            problems: list[str | None] = []
            for pieces, total in zip(batch.column("pieces"), batch.column("total").to_pylist(), strict=True):
                own = sorted(pieces.as_py(), key=lambda x: x["segment"])
                block = b"".join(x["block"] for x in own)
                if [x["segment"] for x in own] != list(range(1, len(own) + 1)) or total is None:
                    payload, problem = None, "segments are missing"
                elif len(block) != total:
                    payload, problem = None, "total length differs"
                else:
                    try:
                        payload, problem = body_of(block)[0], None
                    except ValueError as error:
                        payload, problem = None, str(error)
                payloads.append(payload)
                problems.append(problem)
            sizes = [None if p is None else len(p) for p in payloads]
            columns = [batch.column("page_id"), batch.column("record_type"), pa.nulls(len(payloads), pa.int64()), batch.column("declared_digest"), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload", "problem"])

    return grouped.mapInArrow(run, "page_id long, record_type string, refers_to long, declared_digest string, payload_bytes long, payload binary, problem string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archived pages: page_id, record_type, refers_to, declared_digest, payload_bytes, payload (null for revisits) and problem."""
    found = records(spark, path)
    columns = ["page_id", "record_type", "refers_to", "declared_digest", "payload_bytes", "payload", "problem"]
    return found.where("segment IS NULL").select(columns).unionByName(reassembled(found.where("segment IS NOT NULL")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
