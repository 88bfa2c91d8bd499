"""Sequence files by byte ranges, as Python data sources: nothing is sorted or shuffled to read a chromosome.

``strandline_fasta`` cuts every file into ranges. A range yields the bases that lie in it, in chunks, and
reads on behind its end for the k - 1 bases that its last k-mers need, so each k-mer begins in one chunk only, whether
lines are wrapped or a sequence is one line. To know whether it begins inside a header a range looks back for
the line's start, at most ``HEADER_BYTES``; a longer header is an error wherever it is met, not another result.

``strandline_fastq`` gives the reads of four-line records that begin in a range. The first record's start is
the first line that begins with ``@`` and has a line with ``+`` two lines later: a quality line may begin with ``@`` as well, but two
lines behind one is a sequence, which never begins with ``+``. Bases below a quality can be masked as N.

A range reads its own bytes and what its last k-mers or its last record need behind it, in reads that grow from ``BEHIND``
bytes on. A task takes as many neighbouring ranges as it should, so small ranges are no small tasks, and rows are sent in batches.

Files are opened by Arrow's file systems (local paths, file:, hdfs:, s3:, gs:). Compressed files cannot be cut and are one
range each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.functions.bases import bin_of
from strandline.operators.minimizers import counted_super_kmers
from strandline.runtime import scratch, ship
from strandline.sources.reads import CHUNK, read_long_fasta, tag_of

RANGE = 64 << 20
READ = 4 << 20
#: Bytes of the first read behind a range's end, or before its start; each further one is larger.
BEHIND = 4096
#: Tasks for each core that a file is cut into, as far as they have no more than RANGE bytes.
WAVES = 4
HEADER_BYTES = 1 << 20
#: Rows of a batch of short reads are sent after so many bytes.
BATCH = 2 << 20
PHRED = 33
FASTA = "file string, block bigint, record int, header string, start bigint, own int, seq string"
FASTQ = "file string, at bigint, header string, seq string"
#: Stores that Arrow opens by their names.
STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
COMPRESSED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads."""

    parts: list[ByteRange]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def ranges(path: str, size: int) -> list[ByteRange]:
    """The ranges of all files of a path, those of a compressed file without an end."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    out = []
    for f in sorted(files, key=lambda f: f.path):
        if f.base_name.startswith(("_", ".")) or not f.size:
            continue
        whole = f.base_name.rsplit(".", 1)[-1] in COMPRESSED
        out += [ByteRange(f.path, 0, -1)] if whole else [ByteRange(f.path, a, min(a + size, f.size)) for a in range(0, f.size, size)]
    return out


def some_of(parts: list[ByteRange], one_in: int) -> list[ByteRange]:
    """One in so many ranges, by a hash of name and place; at least one, if there are any."""
    rank = {id(p): zlib.crc32(f"{p.file.rsplit('/', 1)[-1]}:{p.start}".encode()) for p in parts}
    return [p for p in parts if rank[id(p)] % one_in == 0] or sorted(parts, key=lambda p: rank[id(p)])[:1]


def together(parts: list[ByteRange], size: int, cores: int) -> list[Ranges]:
    """The ranges in their order, put together to tasks of RANGE bytes, or less while there are few for so many cores; each alone if cores are not known."""
    room = max(size, min(RANGE, sum(p.end - p.start for p in parts if p.end >= 0) // (WAVES * cores))) if cores else 0
    out, held = [], room
    for p in parts:
        n = p.end - p.start if p.end >= 0 else room
        if held + n > room or not cores:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(p)
        held += n
    return out


class Bytes:
    """A file's bytes from a range's start on, a block at a time. ``before``: those of the range before, if one task reads both."""

    end, name, line, before = -1, "", None, None

    def __init__(self, path: str, part: ByteRange, before: Bytes | None = None):
        kind = COMPRESSED.get(part.file.rsplit(".", 1)[-1])
        self.start, self.end, self.name, self.line = part.start, part.end, part.file, None
        self.before = before if before is not None and before.name == part.file and not kind else None
        if self.before is not None:
            self.file, self.before.before = self.before.file, None
        else:
            system = opened(path)[0]
            self.file = system.open_input_stream(part.file, compression=kind) if kind else system.open_input_file(part.file)

    def blocks(self) -> Iterator[bytes]:
        if self.start:
            self.file.seek(self.start)
        elif self.before is not None:
            self.file.seek(0)
        at, behind = self.start, BEHIND
        while block := self.file.read(READ if self.end < 0 else min(READ, self.end - at if at < self.end else behind)):
            behind *= 1 if at < self.end else 4
            at += len(block)
            yield block

    def line_before(self) -> bytes:
        """The line from its start to the range's start, as far as HEADER_BYTES back; of a long line that is no header, what tells that."""
        if self.line is None:
            self.line = self._line_before()
        return self.line

    def _line_before(self) -> bytes:
        back, found = 0, b""
        while back < min(self.start, HEADER_BYTES) and b"\n" not in found:
            if back and self.before is not None and self.before.end == self.start and self.before.start and self.before.line:
                # the line may have begun before the range before, which knows what it is
                self.file.seek(self.before.start)
                found = self.file.read(self.start - self.before.start)
                if b"\n" in found:
                    return found[found.rfind(b"\n") + 1 :]
                if not self.before.line.startswith(b">"):
                    return b"?"
            back = min(self.start, HEADER_BYTES, max(BEHIND, 8 * back))
            self.file.seek(self.start - back)
            found = self.file.read(back)
        known = b"\n" in found or back == self.start
        return found[found.rfind(b"\n") + 1 :] if known else b"?"  # too long for a header


def sources(path: str, parts: list[ByteRange]) -> Iterator[tuple[ByteRange, Bytes]]:
    source = None
    for part in parts:
        source = Bytes(path, part, source)
        yield part, source


def texts(values: list[bytes]) -> pa.Array:
    try:
        return pa.array(values, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # no UTF-8
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


def fasta_parts(source: Bytes, end: int) -> Iterator[tuple[str, int, bytes | None]]:
    """("header", place behind it, line; None for one that begins behind ``end``), or ("bases", place, bases without line ends), in order; a block's bases do not reach over ``end``."""
    line = source.line_before() if source.start else b""
    in_header, header, at, fresh = line.startswith(b">"), b"", source.start, not line
    skipped = in_header  # begun before the range: its bases are this range's, its name the range's before
    for block in source.blocks():
        a = 0
        while a < len(block):
            if in_header:
                b = block.find(b"\n", a)
                header += block[a : b if b >= 0 else len(block)]
                if len(header) + len(line) > HEADER_BYTES:
                    raise ValueError(f"a header at byte {at + a} is longer than {HEADER_BYTES} bytes")
                if b < 0:
                    break
                if not skipped:
                    yield "header", at + b + 1, header
                in_header, skipped, header, line, fresh, a = False, False, b"", b"", True, b + 1
                continue
            if fresh and block[a : a + 1] == b">":
                in_header, header, a = True, b"", a + 1
                if at + a - 1 >= end >= 0:
                    yield "header", at + a, None
                    return
                continue
            b = block.find(b"\n>", a)
            stop = b + 1 if b >= 0 else len(block)
            if 0 <= at + a < end < at + stop:
                yield "bases", at + a, block[a : end - at].translate(None, b"\r\n")
                a = end - at
            if stop > a:
                yield "bases", at + a, block[a:stop].translate(None, b"\r\n")
            fresh, a = block[stop - 1 : stop] == b"\n", stop
        at += len(block)
    if in_header and not skipped:
        yield "header", at, header


def fasta_chunks(source: Bytes, end: int, k: int, chunk: int) -> Iterator[tuple[int, str | None, int, int, bytes]]:
    """(headers so far, the last one, start in the record or range, own bases, bases): chunks with the k - 1 bases behind them."""
    record, header, held, start, own = 0, None, bytearray(), 0, 0

    def flushed(last: bool) -> Iterator[tuple[int, str | None, int, int, bytes]]:
        nonlocal own, start
        while own > 0 and (last or len(held) >= chunk + k - 1):
            n = min(own, chunk)
            yield record, header, start, n, bytes(held[: n + k - 1])
            del held[:n]
            own, start = own - n, start + n

    for kind, at, data in fasta_parts(source, end):
        behind = 0 <= end <= at
        if kind == "header":
            yield from flushed(True)
            if data is None:
                return
            record, header, start, own = record + 1, data.decode("utf-8", "replace").strip(), 0, 0
            held.clear()
            if behind:
                # the header began in the range and ended behind it: the record's bases are the next range's
                yield record, header, 0, 0, b""
                return
            yield record, header, 0, 0, b""
        elif behind:
            held += data[: k - 1 - (len(held) - own)] if own else b""
            if not own or len(held) - own >= k - 1:
                yield from flushed(True)
                return
        else:
            held += data
            own += len(data)
            yield from flushed(False)
    yield from flushed(True)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.k, self.chunk = options["path"], int(options["k"]), int(options.get("chunk", CHUNK))
        self.size, self.bases, self.one_in = int(options.get("range", RANGE)), options.get("bases", "true") == "true", int(options.get("one_in", 1))
        self.cores = int(options.get("cores", 0))
        if self.chunk < self.k:
            raise ValueError("a chunk must hold a k-mer")

    def partitions(self) -> list[Ranges]:
        return together(some_of(ranges(self.path, self.size), self.one_in), self.size, self.cores)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part, source in sources(self.path, partition.parts):
            for record, header, start, own, seq in fasta_chunks(source, part.end, self.k, self.chunk):
                rows.append((part.file, part.start, record, header, start, own, seq if self.bases else None))
                held += 64 + len(header or "") + (len(seq) if self.bases else 0)
                if held > BATCH:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names, columns = [c.split()[0] for c in FASTA.split(", ")], list(zip(*rows))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds)), texts(columns[6]) if self.bases else pa.nulls(len(rows), pa.string())], names)


class FastaSource(DataSource):
    """Options: path, k, chunk, range (bytes), bases ("false": a row per chunk without its bases), one_in (ranges that are read), cores (for which tasks are made)."""

    @classmethod
    def name(cls) -> str:
        return "strandline_fasta"

    def schema(self) -> str:
        return FASTA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def lines_of(source: Bytes) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of every line that begins at the range's start or later."""
    at, rest, skip = source.start, b"", bool(source.line_before()) if source.start else False
    for block in source.blocks():
        rest += block
        a = 0
        while (b := rest.find(b"\n", a)) >= 0:
            if not skip:
                yield at + a, rest[a:b].removesuffix(b"\r")
            skip, a = False, b + 1
        at, rest = at + a, rest[a:]
    if rest and not skip:
        yield at, rest.removesuffix(b"\r")


def fastq_records(source: Bytes, end: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(place, header, bases, qualities) of the records that begin in the range."""
    held: list[tuple[int, bytes]] = []
    for line in lines_of(source):
        held.append(line)
        if len(held) >= 3 and not (held[0][1].startswith(b"@") and held[2][1].startswith(b"+")):
            held.pop(0)  # no record's start: only before the first one, or between records (blank lines)
        if held and 0 <= end <= held[0][0]:
            return
        if len(held) == 4:
            (at, header), (_, seq), _, (_, quality) = held
            if len(seq) != len(quality):
                raise ValueError(f"the record at byte {at} has {len(seq)} bases and {len(quality)} qualities")
            yield at, header[1:], seq, quality
            held = []
    if len(held) >= 3:
        raise ValueError(f"the record at byte {held[0][0]} is cut off")


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.least = options["path"], int(options.get("range", RANGE)), int(options.get("least_quality", 0))
        self.cores = int(options.get("cores", 0))

    def partitions(self) -> list[Ranges]:
        return together(ranges(self.path, self.size), self.size, self.cores)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part, source in sources(self.path, partition.parts):
            for at, header, seq, quality in fastq_records(source, part.end):
                if self.least:
                    bases = np.frombuffer(seq, dtype=np.uint8)
                    seq = np.where(np.frombuffer(quality, dtype=np.uint8) < self.least + PHRED, ord("N"), bases).astype(np.uint8).tobytes()
                rows.append((part.file, at, header, seq))
                held += 64 + len(header) + len(seq)
                if held > BATCH:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        file, at, header, seq = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), texts(header), texts(seq)], ["file", "at", "header", "seq"])


class FastqSource(DataSource):
    """Options: path, range (bytes), least_quality (bases below it become N), cores."""

    @classmethod
    def name(cls) -> str:
        return "strandline_fastq"

    def schema(self) -> str:
        return FASTQ

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store's name, as the session's settings have it."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (FastaSource, FastqSource):
        spark.dataSource.register(source)


def read_fastq(spark: SparkSession, path: str, least_quality: int = 0, size: int = RANGE) -> DataFrame:
    """(read_id, seq_tag, header, seq) of FASTQ files."""
    register(spark)
    rows = spark.read.format("strandline_fastq").options(path=qualified(spark, path), range=size, least_quality=least_quality, cores=spark.sparkContext.defaultParallelism).load()
    header = F.trim("header")
    return rows.select(F.xxhash64("file", "at").alias("read_id"), tag_of(header).alias("seq_tag"), header.alias("header"), "seq")


def read_fasta_ranges(spark: SparkSession, path: str, k: int, chunk: int = CHUNK, uppercase: bool = False, size: int = RANGE, places: bool = True) -> DataFrame:
    """(read_id, seq_tag, header, chunk_start, seq): chunks of sequences that overlap by k - 1, as they are read.

    Names and places of what a range begins with come from the ranges before it: a row per range, put in order by
    itself and written, then joined to the chunks; Spark sends it to all tasks if it is small, which it knows from the files. Without
    ``places`` (counts need none) nothing is joined, the files are read once, and ids are those of ranges.
    """
    register(spark)
    source = spark.read.format("strandline_fasta").options(path=qualified(spark, path), k=k, chunk=chunk, range=size, cores=spark.sparkContext.defaultParallelism)
    rows = source.load()
    seq = F.upper("seq") if uppercase else F.col("seq")
    if not places:
        return rows.where(F.length("seq") > 0).select(F.xxhash64("file", "block", "record").alias("read_id"), tag_of(F.col("header")).alias("seq_tag"), "header", F.col("start").alias("chunk_start"), seq.alias("seq"))
    each = source.option("bases", "false").load().groupBy("file", "block").agg(F.max("record").alias("heads"), F.max_by("header", F.struct("record", "start")).alias("head"), F.max_by(F.col("start") + F.col("own"), F.struct("record", "start", "own")).alias("behind"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"group": F.coalesce(F.sum("heads").over(before), F.lit(0)) + F.col("heads"), "heads_before": F.coalesce(F.sum("heads").over(before), F.lit(0)), "head_before": F.last("head", True).over(before)})
    inside = Window.partitionBy("file", "group").orderBy("block")
    each = each.withColumn("total", F.sum("behind").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("total_before", F.coalesce(F.lag("total").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    target = scratch(spark, "ranges")
    each.select("file", "block", "heads_before", "head_before", "total_before").write.parquet(target)
    known = spark.read.schema("file string, block bigint, heads_before bigint, head_before string, total_before bigint").parquet(target)
    rows = rows.where(F.length("seq") > 0).join(known, ["file", "block"], "left")
    first = F.col("record") == 0
    header, number = F.coalesce("header", "head_before"), F.coalesce("heads_before", F.lit(0)) + F.col("record")
    place = F.col("start") + F.when(first, F.coalesce("total_before", F.lit(0))).otherwise(0)
    return rows.where(header.isNotNull()).select(F.xxhash64("file", number).alias("read_id"), tag_of(header).alias("seq_tag"), header.alias("header"), place.alias("chunk_start"), seq.alias("seq"))


def sampled_sizes(spark: SparkSession, path: str, k: int, m: int, bins: int, one_in: int, size: int | None = None) -> DataFrame:
    """(bin, n_kmers, error): the k-mers of each bin of a FASTA file as a sample of its byte ranges has them, read alone.

    ``error``: twice the standard error of the estimate, from the ranges' differences. ``size``: bytes of
    a range; if not given, so that some eight ranges at least are read, and 1 MB at most.
    """
    where = qualified(spark, path)
    if size is None:
        size = max(4096, min(1 << 20, sum(p.end - p.start for p in ranges(where, 1 << 40)) // (8 * one_in)))
    every = ranges(where, size)
    some = some_of(every, one_in)
    register(spark)
    rows = spark.read.format("strandline_fasta").options(path=where, k=k, range=size, one_in=one_in, cores=spark.sparkContext.defaultParallelism).load()
    made = counted_super_kmers(rows.withColumn("read_id", F.lit(0)), k, m, "file", "block")
    each = made.groupBy("file", "block", bin_of(F.col("sig_number"), bins).alias("bin")).agg(F.sum("n_kmers").cast("double").alias("x")).groupBy("bin").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    total, read = len(every), len(some)
    spread = F.greatest(F.col("xx") - F.col("x") * F.col("x") / read, F.lit(0.0)) / max(1, read - 1)
    return each.select("bin", F.round(F.col("x") * total / read).cast("bigint").alias("n_kmers"), (2 * total * F.sqrt((1 - read / total) * spread / read)).alias("error"))


def read_sequences(spark: SparkSession, path: str, k: int, places: bool = True) -> DataFrame:
    """Chunks of long sequences: by byte ranges where Arrow opens the store, else by lines through Spark's own reader."""
    if qualified(spark, path).split(":")[0] in STORES:
        return read_fasta_ranges(spark, path, k, places=places)
    return read_long_fasta(spark, path, k)
