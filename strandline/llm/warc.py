"""WARC archives: write records from a table, read archives back with segment reassembly.

Writing: a response record holds an HTTP response whose body is framed in chunks. A block longer
than a segment is written as a first segment and ``continuation`` records, which name the first
one's id as their origin; the last one gives the total length. Of records with equal payloads of
at least ``MIN_DEDUP`` bytes one is a response, the others are ``revisit`` records without a
payload. Every record is a gzip member of its own, so readers can seek to it. Files go through Spark's
own writer, so they reach any store Spark can write, and a lost executor or a repeated task leaves
no half file. Tasks hand the writer bundles of members of bounded bytes, and a file takes a bounded
number of bundles, some 16 MB, as its reader holds it whole. Payloads meet the digests that recur in
a hash join and are not sorted: a task's map has at most a short row for every 200 bytes of its payloads.

Reading: a file is parsed by its records' lengths, a member at a time. Whole records are decoded in
place, and records leave a task in batches of a megabyte, as payloads do. Only segments are shuffled: grouped by origin, put in order of segment number, checked for
gaps and for the total length, joined, and then the chunked framing is decoded. Spark's reader of
binary files puts a file into one row, so foreign archives may be as large as a row, 2 GB; an
archive that is not compressed or is one single member can be read as well.

Edge cases: a null payload is an empty one; a null id stays null and refers to nothing by itself;
rows that repeat an id and payload are equal records, all of the same type; an empty table gives an
archive without records; columns other than id, url and payload are ignored; very long payloads are
many segments. A record whose segments or framing are damaged, or that is framed in another way than by chunks, comes back
with ``complete`` false and a null payload; lengths that are not true or too large cost no more memory than what is there. What is no record in a foreign archive is passed over to the next line that begins
one; where a file is cut or cannot be decompressed its reading ends. Either leaves a row of the
type ``damaged`` that is not complete.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import Workspace

CRLF = b"\r\n"
SEGMENT_BYTES = 65_536
CHUNK_BYTES = 8_192
MIN_DEDUP = 100
#: A bundle is an array of the JVM; one of half a region of its heap (1 MB) or more takes whole regions of it.
BUNDLE_BYTES, BUNDLES_PER_FILE = 1 << 18, 64
#: Bytes of records or payloads after which a batch goes on.
BATCH_BYTES = 1 << 20
DAMAGED = "damaged"
#: Bytes that are read at once, and of a header line; a record with a longer one is damaged.
PIECE = 1 << 20
HEX = re.compile(rb"[0-9A-Fa-f]{1,16}")
DATE = "2020-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

RECORD = "record_id string, record_type string, uri string, page_id long, refers_to string, digest string, segment long, origin string, total long, block binary"
PAYLOAD = "record_id string, record_type string, uri string, page_id long, refers_to string, digest string, payload binary, complete boolean"


def record_urn(*parts: object) -> str:
    """A record id that depends on nothing but ``parts``, so a repeated task writes the same one."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunk(body: bytes) -> bytes | None:
    """The payload of a chunked body, None if the framing is damaged."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not HEX.fullmatch(digits):
            return None
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(out)
        if size > len(body) - at or body[at + size : at + size + 2] != CRLF:
            return None
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP message, its transfer framing removed; None if it is framed in any other way than by chunks."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(CRLF)[1:])}
    framing = fields.get(b"transfer-encoding", b"identity")
    return body if framing == b"identity" else dechunk(body) if framing == b"chunked" else None


def clean(value: str) -> str:
    """A header value without line ends."""
    return " ".join(value.split())


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int, str] | None, segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit of ``first``, or a response in as many segments as it takes."""
    own = record_urn(page_id, digest)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", clean(url) if url else None), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", record_urn(first[0], digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block = HEAD + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    http = ("Content-Type", "application/http;msgtype=response")
    if len(parts) == 1:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, http], block)]
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, http, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_urn(page_id, digest, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and digest of every page, and for a revisit the page_id of its response (first_id)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    # one row per payload that occurs more than once, pre-aggregated where it is read
    first = rows.where(F.col("size") >= MIN_DEDUP).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("first_id"))


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to gzip archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for page_id, url, payload, digest, first_id in zip(*batch.columns, strict=True):
                d = digest.as_py()
                first = None if first_id.as_py() is None else (first_id.as_py(), d)
                for made in records_of(page_id.as_py(), url.as_py(), payload.as_py(), d, first, segment_bytes):
                    out.append(member(made))
                    size += len(out[-1])
                    if size > BUNDLE_BYTES:
                        yield bundle(out)
                        out, size = [], 0
        if out:
            yield bundle(out)

    # The text writer writes the bytes of a value as they are, and the separator, which is the bundle's own last byte.
    made = marked(pages).mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", BUNDLES_PER_FILE).text(path)


def member(made: bytes) -> bytes:
    """A record with the two line ends that follow it as a gzip member. Its last byte is 0, as the record has less than 16 MB."""
    if len(made) >= 1 << 24:
        raise ValueError("a segment and its header must have less than 16 MB")
    return gzip.compress(made + CRLF + CRLF, 1, mtime=0)


def bundle(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["records"])


def parse(stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Fields (names in lower case) and block of every record; a block that is cut short is None, as is what is no record."""
    try:
        passed = False  # over something that is no record
        while line := line_of(stream)[0]:
            if not line.startswith(b"WARC/"):
                if line.strip() and not passed:
                    passed = True
                    yield {"warc-type": DAMAGED}, None
                continue
            passed, damaged = False, False
            fields: dict[str, str] = {}
            while (read := line_of(stream))[0].strip():
                name, _, value = read[0].decode("utf-8", "replace").partition(":")
                fields[name.strip().lower()] = value.strip()
                damaged |= read[1]
            length = number(fields, "content-length")
            if length is None or length < 0:
                yield {**fields, "warc-type": DAMAGED}, None
                continue
            block = block_of(stream, length)
            yield {**fields, "warc-type": DAMAGED} if damaged else fields, block if len(block) == length and not damaged else None
    except (EOFError, OSError, zlib.error):
        yield {"warc-type": DAMAGED}, None


def line_of(stream) -> tuple[bytes, bool]:
    """The next line, and whether it is longer than PIECE; what is beyond that is passed over."""
    line = more = stream.readline(PIECE)
    while len(more) == PIECE and not more.endswith(b"\n"):
        more = stream.readline(PIECE)
    return line, more is not line


def block_of(stream, length: int) -> bytes:
    """So many bytes, or as many as there are, whatever the length says."""
    parts = []
    while length > 0 and (part := stream.read(min(length, PIECE))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


def number(fields: dict[str, str], name: str) -> int | None:
    """A field's value as a 64-bit number, None if it is none."""
    try:
        value = int(fields[name])
    except (KeyError, ValueError):
        return None
    return value if abs(value) < 1 << 63 else None


def opened(raw: pa.Buffer):
    """A stream of a file's bytes, decompressed if need be, that copies no more than it is asked for."""
    stream = io.BufferedReader(pa.BufferReader(raw))
    return gzip.GzipFile(fileobj=stream) if raw.size > 1 and raw.slice(0, 2).to_pybytes() == b"\x1f\x8b" else stream


def record_batches(raw: pa.Buffer, segments: bool | None = None) -> Iterator[pa.RecordBatch]:
    """The records of a file's bytes, in batches of bounded bytes; only those that are segments, or are none, if so asked."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in RECORD.split(", ")]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    out, size = [], 0
    for f, block in parse(opened(raw)):
        if segments is not None and segments != (number(f, "warc-segment-number") is not None):
            continue
        out.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), number(f, "x-page-id"), f.get("warc-refers-to"), f.get("warc-payload-digest"), number(f, "warc-segment-number"), f.get("warc-segment-origin-id"), number(f, "warc-segment-total-length"), block))
        size += len(block or b"") + 500
        if size > BATCH_BYTES:
            yield made(out)
            out, size = [], 0
    if out:
        yield made(out)


def payload_batches(found: pa.RecordBatch, blocks: Iterable[bytes | None]) -> Iterator[pa.RecordBatch]:
    """The first six columns of records, and payload and complete from their blocks, in batches of bounded bytes."""
    names = [*found.schema.names[:6], "payload", "complete"]
    payloads, complete, size, at = [], [], 0, 0
    made = lambda: pa.RecordBatch.from_arrays([*found.slice(at, len(payloads)).columns[:6], pa.array(payloads, pa.binary()), pa.array(complete, pa.bool_())], names)
    for kind, block in zip(found.column(1), blocks):
        response = kind.as_py() == "response"
        payload = http_payload(block) if response and block is not None else None
        payloads.append(payload)
        complete.append((payload if response else block) is not None)
        size += len(payload or b"") + 500
        if size > BATCH_BYTES:
            yield made()
            at += len(payloads)
            payloads, complete, size = [], [], 0
    if payloads:
        yield made()


def contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_records(spark: SparkSession, path: str, segments: bool | None = None) -> DataFrame:
    """Every record of the archives below ``path`` as it stands, segments not joined; only segments, or none, if so asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from record_batches(content.as_buffer(), segments)

    return contents(spark, path).mapInArrow(run, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """``records`` with segments joined: one row per record that is not a continuation.

    Columns record_id, record_type, uri, page_id, refers_to, digest, payload, complete. Equal
    records are kept as often as their first segment occurs; of equal segments one is used.
    """
    columns = ["record_id", "record_type", "uri", "page_id", "refers_to", "digest", "blocks"]
    whole = records.where("segment is null").withColumn("blocks", F.when(F.col("block").isNotNull(), F.array("block")))
    return with_payloads(whole.select(*columns).unionByName(joined_segments(records).select(*columns)))


def joined_segments(records: DataFrame) -> DataFrame:
    """One row for every first segment, with the blocks of all of its record in order; null if they are not all there."""
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin", "record_id"))
    joined = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("s"),
        F.max("total").alias("total"),
        F.min(F.when(F.col("segment") == 1, F.struct("record_type", "uri", "page_id", "refers_to", "digest"))).alias("head"),
        F.count(F.when(F.col("segment") == 1, 1)).alias("n"),
    )
    length = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.octet_length(x["block"]).cast("long"), F.lit(-(2**62))))
    fits = (F.array_max(F.transform("s", lambda x: x["segment"])) == F.size("s")) & (length == F.col("total"))
    blocks = F.when(F.coalesce(fits, F.lit(False)), F.transform("s", lambda x: x["block"]))
    return joined.where("n > 0").select(F.col("origin").alias("record_id"), "head.*", blocks.alias("blocks"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def with_payloads(found: DataFrame) -> DataFrame:
    """Payload and complete in place of the blocks, which are the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from payload_batches(batch, (b"".join(x.as_py()) if x.is_valid else None for x in batch.column(6)))

    return found.mapInArrow(run, PAYLOAD)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``reassemble`` of the records below ``path``: whole records are decoded where they are parsed, and only segments go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in record_batches(content.as_buffer(), segments=False):
                    yield from payload_batches(found, (x.as_py() for x in found.column(9)))

    return contents(spark, path).mapInArrow(run, PAYLOAD).unionByName(with_payloads(joined_segments(read_records(spark, path, segments=True))))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and report every page.

    Columns page_id, payload_bytes, payload_digest (of the payload that was read; of a revisit,
    of the response it refers to), record_type, refers_to (a page_id).
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc")
    write_warc(pages, f"{space.path}/archive")
    read = read_warc(spark, f"{space.path}/archive").select("record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    read = space.save(read, "read")
    space.drop("archive")
    source = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("b"), F.first("payload_digest").alias("d"), F.first("page_id").alias("p"))
    revisits = read.where("record_type = 'revisit'").join(source, "refers_to", "left").select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.col("p").alias("refers_to"))
    return read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
