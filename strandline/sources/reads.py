"""Reads: FASTA files, and reads derived from tables of text.

A read is (read_id, seq_tag, seq). FASTA has no ids; ``read_id`` is a hash of file and header, of long
sequences also of the record's number in the file, so it does not change when a task runs again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.bases import strip_line_ends

#: Letters and the space become bases in turn, so that prose gives reads with natural breaks.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
LETTER_BASES = "ACGTACGTACGTACGTACGTACGTAC" * 2 + "T"
CHUNK = 1 << 20
#: What each byte of a text becomes: N all that is no letter or space, of other characters their first byte; and the bytes that are left out.
_BASE_OF = bytes.maketrans(LETTERS.encode(), LETTER_BASES.encode()).translate(bytes(c if c in b"ACGT" else 78 for c in range(256)))
_LEFT_OUT = b"\n" + bytes(range(0x80, 0xC0))


def tag_of(header: Column) -> Column:
    """The run of word characters that a header begins with."""
    return F.regexp_extract(header, r"^(\w+)", 1)


def reads_from_text(table: DataFrame, id_col: str = "doc_id", tag_col: str = "source", text_col: str = "text") -> DataFrame:
    """Reads made of a table of prose, bytes at once; a null text gives a null read, which has no k-mers."""
    base_of, left_out = _BASE_OF, _LEFT_OUT

    @F.arrow_udf("string")
    def bases_of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.translate(base_of, left_out) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())

    return table.select(F.col(id_col).alias("read_id"), F.col(tag_col).alias("seq_tag"), bases_of(F.col(text_col)).alias("seq"))


def read_fasta(spark: SparkSession, path: str, uppercase: bool = False) -> DataFrame:
    """FASTA of many short reads: one row per record, with its header. Splits fall between records."""
    record = F.regexp_replace("value", "^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(record, "\n", 1), "\r", ""))
    body = strip_line_ends(F.when(F.instr(record, "\n") > 0, F.expr("substring(record, instr(record, '\n') + 1)")).otherwise(""))
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.col("_metadata.file_path")).where("length(trim(value)) > 0")
    rows = rows.withColumn("record", record)
    return rows.select(F.xxhash64("file", header).alias("read_id"), tag_of(header).alias("seq_tag"), header.alias("header"), (F.upper(body) if uppercase else body).alias("seq"))


def read_long_fasta(spark: SparkSession, path: str, k: int, chunk: int = CHUNK, uppercase: bool = False) -> DataFrame:
    """FASTA of few very long sequences as chunks (read_id, seq_tag, header, chunk_start, seq) that overlap by k - 1.

    The file is read by lines in as many splits as there are. The place of a line in its sequence
    comes from two sums: over the splits before it (one row per split), and over the lines before
    it in its split. Lines are then put together chunk by chunk, so no task holds a sequence. Records
    are told apart by their number in the file, as headers may repeat.
    """
    if chunk < k:
        raise ValueError("a chunk must hold a k-mer")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), strip_line_ends(F.col("value")).alias("line"))
    head = F.col("line").startswith(">")
    lines = lines.withColumns({"is_head": head, "n": F.when(head, 0).otherwise(F.length("line"))})
    inside = Window.partitionBy("file", "block").orderBy("row")
    lines = lines.withColumn("sofar", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("own_heads", F.sum(F.col("is_head").cast("int")).over(inside))
    lines = lines.withColumns({"own_head": F.last(F.when(F.col("is_head"), F.col("line")), True).over(inside), "own_from": F.last(F.when(F.col("is_head"), F.col("sofar")), True).over(inside)})
    blocks = lines.groupBy("file", "block").agg(F.sum("n").alias("n"), F.sum(F.col("is_head").cast("int")).alias("heads"), F.max_by("line", F.when(F.col("is_head"), F.col("row"))).alias("head"), F.max(F.when(F.col("is_head"), F.col("sofar"))).alias("head_at"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("n").over(order), F.lit(0))
    blocks = blocks.withColumns({"before": total, "heads_before": F.coalesce(F.sum("heads").over(order), F.lit(0))}).withColumn("head_total", F.when(F.col("head").isNotNull(), F.col("before") + F.col("head_at")))
    blocks = blocks.select("file", "block", "before", "heads_before", F.last("head", True).over(order).alias("prior_head"), F.last("head_total", True).over(order).alias("prior_total"))
    lines = lines.where("not is_head and n > 0").join(blocks, ["file", "block"])
    start = F.col("before") + F.col("sofar") - F.coalesce(F.col("before") + F.col("own_from"), "prior_total")
    header = F.trim(F.substring(F.coalesce("own_head", "prior_head"), 2, 1 << 30))
    lines = lines.select("file", header.alias("header"), (F.col("heads_before") + F.col("own_heads")).alias("record"), start.alias("start"), "line", "n").where("header is not null")
    # a line gives each chunk [c * chunk, (c + 1) * chunk + k - 1) that it touches its share, cut before anything is moved
    first = F.greatest(F.lit(0), F.floor((F.col("start") - (k - 1)) / chunk))
    lines = lines.withColumn("line", F.encode("line", "utf-8"))
    parts = lines.withColumn("c", F.explode(F.sequence(first.cast("bigint"), F.floor((F.col("start") + F.col("n") - 1) / chunk).cast("bigint"))))
    low, high = F.greatest("start", F.col("c") * chunk), F.least(F.col("start") + F.col("n"), (F.col("c") + 1) * chunk + (k - 1))
    share = F.decode(F.substring("line", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), "utf-8")
    joined = parts.groupBy("file", "record", "header", "c").agg(F.array_sort(F.collect_list(F.struct(low.alias("start"), share.alias("share")))).alias("p"))
    seq = F.concat_ws("", F.transform("p", lambda x: x["share"]))
    rows = joined.select(F.xxhash64("file", "record", "header").alias("read_id"), tag_of(F.col("header")).alias("seq_tag"), "header", (F.col("c") * chunk).alias("chunk_start"), (F.upper(seq) if uppercase else seq).alias("seq"))
    return rows.where(F.length("seq") >= 1)


def chunk_reads(reads: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """Reads cut into chunks that overlap by k - 1, so that each k-mer begins in one chunk only."""
    s = F.encode("seq", "utf-8")
    starts = F.sequence(F.lit(0), F.length("seq") - k, F.lit(chunk))
    rows = reads.where(F.length("seq") >= k).withColumn("chunk_start", F.explode(starts))
    return rows.withColumn("seq", F.decode(F.substring(s, F.col("chunk_start") + 1, F.lit(chunk + k - 1)), "utf-8"))
