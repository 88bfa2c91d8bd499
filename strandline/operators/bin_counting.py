"""Counting inside bins: packed super-k-mers are what is shuffled, and a bin is counted where it lands.

1. Tasks cut their reads into super-k-mers, of 31 k-mers at most, and pack them into words of 31 bases. A row
   is a slot (the bin, and a part of it), the words, and how often the super-k-mer was met in its batch, so copies of a
   read shrink before they are sent.
2. One exchange by slot moves the rows: some ten k-mers a row, where a table of k-mers has one.
3. Behind it the words are cut into canonical k-mers as numbers and counted by slot and k-mer. That
   grouping is served by the exchange by slot, so nothing is moved again; Spark's aggregate spills where a bin is large.

A k-mer and its reverse complement have one signature, so one bin. Bins that a sample shows to be
large are split into parts by a second minimizer: the least hash of a k-mer's short words, each
taken with its reverse complement. It is a k-mer's own too, so a part is final as a bin is; super-k-mers of such
bins are cut where its place changes. ``slots_of`` needs a row per bin only, of which there are at most ``max_bins``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import packed
from strandline.functions.bases import PER_WORD
from strandline.functions.packed import windows_of_words
from strandline.operators.minimizers import AT_ONCE, BLOCK, codes_of, least_of_windows, norms, signatures, stretches, windows_of
from strandline.operators.short_counting import short_words
from strandline.operators.sizes import bin_sizes, sampled
from strandline.runtime import UNKNOWN_BYTES, bytes_of, dealt

#: Bases of a word of the second minimizer.
SECOND = 11
#: k-mers that a part of a bin should hold at most.
MOST = 1 << 24
#: Reads of which one in so many shows the sizes of bins.
SAMPLE_ONE_IN = 100
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Bits of a place in a block.
_PLACE = np.uint64((1 << 24) - 1)


def bin_numbers(signature: np.ndarray, bins: int) -> np.ndarray:
    """``functions.bases.bin_of`` on an array."""
    # fixed values: the constants of Thomas Wang's 32-bit integer mix
    cut, s = 0xFFFFFFFF, signature.astype(np.int64)
    v = s ^ 61 ^ (s >> 16)
    v = (v * 9) & cut
    v ^= v >> 4
    v = (v * 0x27D4EB2D) & cut
    v ^= v >> 15
    return (v & 0x7FFFFFFF) % bins


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h.astype(np.uint64) + _ODD) * _MIX
    return (h ^ (h >> np.uint64(31))) * _ODD


def second_minimizers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of k codes the least hash of its short words (its upper bits), the same on both strands, and the leftmost place of it."""
    width = min(SECOND, k)
    h = mixed(np.minimum(windows_of(codes, width), windows_of(codes, width, turned=True)))
    least = least_of_windows(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), k - width + 1)
    return least & ~_PLACE, (least & _PLACE).astype(np.int64)


def runs(codes: np.ndarray, k: int, m: int, bins: int, parts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of k-mers, slot) of the super-k-mers of a block, cut at 31 k-mers and in split bins by second minimizer."""
    place, sig, pos = signatures(codes, k, m)
    if not len(place):
        return place, place, place
    slot = bin_numbers(sig, bins) << 32
    fresh = np.concatenate([[True], (pos[1:] != pos[:-1]) | (place[1:] != place[:-1] + 1)])
    if parts is not None and (many := parts[slot >> 32]).max() > 1:
        value, at = (x[place] for x in second_minimizers(codes, k))
        split = many > 1
        slot += np.where(split, (mixed(value) % np.maximum(many, 1).astype(np.uint64)).astype(np.int64), 0)
        fresh[1:] |= split[1:] & (at[1:] != at[:-1])
    begin = np.flatnonzero(fresh)
    rank = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
    first = np.flatnonzero(rank % PER_WORD == 0)
    return place[first], np.diff(np.append(first, len(place))), slot[first]


def words_at(codes: np.ndarray, start: np.ndarray, length: np.ndarray, many: int) -> list[np.ndarray]:
    """The words of the stretches that begin at ``start``; what lies behind their ends is zero."""
    c = np.concatenate([codes & 3, np.zeros(PER_WORD * many + 1, dtype=codes.dtype)]).astype(np.int64)
    two = c[:-1] << 2 | c[1:]
    four = two[:-2] << 4 | two[2:]
    eight = four[:-4] << 8 | four[4:]
    out = []
    for j in range(many):
        a = start + PER_WORD * j
        inside = a < len(codes)
        a = np.where(inside, a, 0)
        word = eight[a] << 46 | eight[a + 8] << 30 | eight[a + 16] << 14 | four[a + 24] << 6 | two[a + 28] << 2 | c[a + 30]
        surplus = 2 * (PER_WORD - np.clip(length - PER_WORD * j, 0, PER_WORD))
        out.append(np.where(inside, word >> surplus << surplus, 0))
    return out


def merged(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns, and how often each occurs. Rows are put in order of a hash; equal ones lie side by side."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = mixed(h ^ c.view(np.uint64))
    order = np.argsort(h)
    columns = [c[order] for c in columns]
    fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    first = np.flatnonzero(fresh)
    return [c[first] for c in columns], np.diff(np.append(first, len(order)))


def packed_super_kmers(reads: DataFrame, k: int, m: int, bins: int, parts: np.ndarray | None = None) -> DataFrame:
    """(slot, w0..., last, times): super-k-mers of all reads; ``last``: the place of the last k-mer; slot: bin * 2^32 + part."""
    if not m <= k <= packed.LONGEST:
        raise ValueError(f"k must lie between m and {packed.LONGEST}")
    many = 2 if k <= PER_WORD else 3
    names = ["slot", *(f"w{j}" for j in range(many)), "last", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = b"N".join(batch.column(0).to_pylist())  # no k-mer reaches over the end of a read
            for a in range(0, len(seq) - k + 1, BLOCK):
                codes = stretches(codes_of(seq[a : a + BLOCK + k - 1]), k)
                start, n, slot = runs(codes, k, m, bins, parts)
                if not len(start):
                    continue
                rows, times = merged([slot, *words_at(codes, start, n + (k - 1), many), n - 1])
                yield pa.RecordBatch.from_arrays([*map(pa.array, rows[:-1]), pa.array(rows[-1], pa.int32()), pa.array(times, pa.int64())], names)

    rows = reads.select(F.encode(F.coalesce("seq", F.lit("")), "utf-8").alias("seq"))
    return rows.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'last' else 'long'}" for c in names))


def slots_of(sizes: DataFrame, bins: int, most: int = MOST, scale: int = 1) -> np.ndarray:
    """The number of parts of each bin, from (bin, n_kmers) of a sample of one in ``scale``."""
    parts = np.ones(bins, dtype=np.int64)
    for row in sizes.select("bin", "n_kmers").collect():  # a row per bin
        parts[row["bin"]] = -(-row["n_kmers"] * scale // most)
    return parts


def counted_words(rows: DataFrame, k: int, *placed: str) -> DataFrame:
    """(slot, hi and, beyond 31 bases, lo, n) of ``packed_super_kmers`` that lie together by slot, or by the column ``placed``."""
    many, names = (2, ["hi"]) if k <= PER_WORD else (3, ["hi", "lo"])
    each = windows_of_words(rows, many, k, names, *placed, "slot", "times")
    return each.groupBy(*placed, "slot", *names).agg(F.sum("times").alias("n")).select("slot", *names, "n")


def counted_slots(rows: DataFrame, k: int, *placed: str) -> DataFrame:
    """(bin, kmer, n) of ``packed_super_kmers`` that lie together by slot, or by the column ``placed``."""
    counted = counted_words(rows, k, *placed)
    return counted.select(F.shiftright("slot", 32).cast("int").alias("bin"), packed.text([F.col(c) for c in counted.columns[1:-1]], k).alias("kmer"), "n")


def counts_in_bins(reads: DataFrame, k: int, m: int, bins: int, parts: np.ndarray | None = None) -> DataFrame:
    """(bin, kmer, n): exact counts of canonical k-mers of up to 62 bases by one exchange of packed super-k-mers."""
    return counted_slots(dealt(packed_super_kmers(reads, k, m, bins, parts), reads, "slot"), k)


def short_counts_in_bins(reads: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, kmer, n) as of ``counts_in_bins``, of short k-mers: added up as numbers where the read is, and given their bins when they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                codes = (some.column(0).to_numpy()[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3).astype(np.uint8)
                norm = np.append(norms(codes.ravel(), m), np.zeros(m - 1, dtype=np.int64)).reshape(codes.shape)[:, : k - m + 1]
                yield pa.RecordBatch.from_arrays([pa.array(bin_numbers(norm.min(axis=1), bins), pa.int32()), *some.columns], ["bin", "hi", "n"])

    counted = short_words(reads, k).mapInArrow(run, "bin int, hi long, n long")
    return counted.select("bin", packed.text([F.col("hi")], k).alias("kmer"), "n")


def long_words(reads: DataFrame, k: int, m: int = 10, bins: int = 2048) -> DataFrame:
    """(hi and, beyond 31 bases, lo, n): exact counts of canonical k-mers as numbers, counted in bins, large ones in parts.

    For k-mers that are mostly different a table of them is many times its text: so neither they are sent, nor sums of
    tasks, and a task counts a bounded share of the input. Inputs smaller than a part need no look at the sizes of bins.
    """
    parts = None
    if MOST < bytes_of(reads) < UNKNOWN_BYTES:
        parts = slots_of(bin_sizes(sampled(reads, SAMPLE_ONE_IN), k, m, bins), bins, MOST // 4, SAMPLE_ONE_IN)
    return counted_words(dealt(packed_super_kmers(reads, k, m, bins, parts), reads, "slot"), k).drop("slot")


def count_long(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of ``long_words``."""
    counted = long_words(reads, k)
    return counted.select(packed.text([F.col(c) for c in counted.columns[:-1]], k).alias("kmer"), "n")
