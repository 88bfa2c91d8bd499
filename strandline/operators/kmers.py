"""k-mers of reads and their counts.

Reads are first cut into stretches of bases, so no k-mer has to be tested; stretches are cut into
pieces, so that one very long read neither grows quadratic nor keeps one task busy; and places are
taken from bytes, as a place in a string costs time in proportion to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import packed
from strandline.functions.bases import PER_WORD
from strandline.functions.packed import windows_of_words
from strandline.operators.bin_counting import count_long
from strandline.operators.minimizers import codes_of, mapped
from strandline.operators.short_counting import MOST_BASES, count_short

PIECE = 4096
#: Bases from which on there are more k-mers than tasks can add up.
LONG = 16


def pieces(reads: DataFrame, k: int, *keep: str, piece: int = PIECE) -> DataFrame:
    """(keep..., s, n): stretches of bases as bytes, of at least k bases and about ``piece`` at most."""
    stretch = reads.select(*keep, F.explode(F.split("seq", "[^ACGT]+")).alias("s")).where(F.length("s") >= k)
    stretch = stretch.select(*keep, F.col("s").cast("binary").alias("s"))
    cut = stretch.select(*keep, "s", F.explode(F.sequence(F.lit(0), F.octet_length("s") - k, F.lit(piece))).alias("at"))
    return cut.select(*keep, F.substring("s", F.col("at") + 1, F.lit(piece + k - 1)).alias("s")).withColumn("n", F.octet_length("s"))


def reversed_complement(s: Column) -> Column:
    return F.reverse(F.translate(s.cast("string"), "ACGT", "TGCA")).cast("binary")


def kmers(reads: DataFrame, k: int, *keep: str, canonical: bool = True, piece: int = PIECE) -> DataFrame:
    """(keep..., kmer as bytes): one row per occurrence. The reverse complement is made once per piece."""
    cut = pieces(reads, k, *keep, piece=piece)
    if canonical:
        cut = cut.withColumn("r", reversed_complement(F.col("s")))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("i"))
    kmer = F.substring("s", F.col("i") + 1, F.lit(k))
    if canonical:
        kmer = F.least(kmer, F.substring("r", F.col("n") - k - F.col("i") + 1, F.lit(k)))
    return each.select(*keep, kmer.alias("kmer"))


def count_kmers(reads: DataFrame, k: int, canonical: bool = True, piece: int = PIECE) -> DataFrame:
    """(kmer, n): exact counts, partly summed before the only shuffle. Short k-mers are summed where the read is."""
    if k < LONG:
        return count_short(reads, k, canonical=canonical)
    counted = kmers(reads, k, canonical=canonical, piece=piece).groupBy("kmer").agg(F.count("*").alias("n"))
    return counted.select(F.col("kmer").cast("string").alias("kmer"), "n")


def packed_kmers(reads: DataFrame, k: int, *keep: str, canonical: bool = True, piece: int = PIECE) -> DataFrame:
    """(keep..., hi and, beyond 31 bases, lo): one row per occurrence, as numbers that are cut from words of 31 bases."""
    if k > packed.LONGEST:
        raise ValueError(f"packed k-mers have at most {packed.LONGEST} bases")
    many, names = (2, ["hi"]) if k <= PER_WORD else (3, ["hi", "lo"])
    cut = pieces(reads, k, *keep, piece=piece)
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - k, F.lit(PER_WORD))).alias("at"))
    each = each.select(*keep, *[packed.word_at(F.col("s"), F.col("at") + PER_WORD * j).alias(f"w{j}") for j in range(many)], F.least(F.lit(PER_WORD - 1), F.col("n") - k - F.col("at")).alias("last"))
    return windows_of_words(each, many, k, names, *keep, canonical=canonical)


def count_packed(reads: DataFrame, k: int, canonical: bool = True, piece: int = PIECE) -> DataFrame:
    """(kmer, n) of k-mers of up to 62 bases, which are numbers until they are counted and texts only then.

    Canonical ones of LONG bases and more are mostly different and come as packed super-k-mers to where they are counted.
    """
    if canonical and LONG <= k <= packed.LONGEST:
        return count_long(reads, k)
    rows = packed_kmers(reads, k, canonical=canonical, piece=piece)
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return counted.select(packed.text([F.col(c) for c in rows.columns], k).alias("kmer"), "n")


def count_by_tag(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(seq_tag, kmer, n)."""
    if k <= MOST_BASES and dict(reads.dtypes)["seq_tag"] == "string":
        return count_short(reads, k, "seq_tag", canonical=canonical)
    counted = kmers(reads, k, "seq_tag", canonical=canonical).groupBy("seq_tag", "kmer").agg(F.count("*").alias("n"))
    return counted.select("seq_tag", F.col("kmer").cast("string").alias("kmer"), "n")


def windows(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, seq_tag, i, kmer): every window of k characters, valid or not."""
    each = reads.where(F.length("seq") >= k).select("read_id", "seq_tag", F.col("seq").cast("binary").alias("s"), F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("i"))
    return each.select("read_id", "seq_tag", "i", F.substring("s", F.col("i") + 1, F.lit(k)).cast("string").alias("kmer"))


def invalid_bounds(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, chunk_start, i, first_bad, last_bad): windows of ``chunk_reads`` that hold something else than bases, and where its first and last one lies."""

    def rows_of(seq: bytes):
        bad = codes_of(seq) > 3
        place = np.arange(len(bad))
        n = len(bad) - k + 1
        following = np.minimum.accumulate(np.where(bad, place, len(bad) + k)[::-1])[::-1][:n]
        before = np.maximum.accumulate(np.where(bad, place, -1))[k - 1 :]
        i = np.flatnonzero(before >= place[:n])
        return i, following[i] - i, before[i] - i

    return mapped(reads, rows_of, "i int, first_bad int, last_bad int", ("read_id", "chunk_start"))


def valid_segments(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, start, len): maximal stretches of bases that hold a k-mer, found where the read is."""

    def rows_of(seq: bytes):
        inside = np.concatenate([[False], codes_of(seq) < 4, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2]
        return start[length >= k], length[length >= k]

    return mapped(reads, rows_of, "start int, len int", ("read_id",))
