"""Super-k-mers and k-mers by bin, of all reads or of a sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.bases import bin_of, unpack
from strandline.functions.minimizer import DEFAULT
from strandline.operators.minimizers import counted_super_kmers


def super_kmer_counts(reads: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, sig, n, n_kmers): super-k-mers and their k-mers by bin and signature.

    Reads with a ``chunk_start`` are chunks of long sequences that overlap by k - 1. A super-k-mer that
    reaches over the border of chunks is known by its signature's place in the sequence and counts once;
    only such pieces, two per chunk at most, are grouped by place.
    """
    each = counted_super_kmers(reads, k, m)
    if "chunk_start" in reads.columns:
        each = each.groupBy("sig_number", "read_id", "at").agg(F.sum("n").alias("n"), F.sum("n_kmers").alias("n_kmers"))
        each = each.withColumn("n", F.when(F.col("at").isNull(), F.col("n")).otherwise(1))
    counted = each.groupBy("sig_number").agg(F.sum("n").alias("n"), F.sum("n_kmers").alias("n_kmers"))
    sig = F.when(F.col("sig_number") == 4**m, DEFAULT).otherwise(unpack(F.col("sig_number"), m))
    return counted.select(bin_of(F.col("sig_number"), bins).alias("bin"), sig.alias("sig"), "n", "n_kmers")


def bin_sizes(reads: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, n_super, n_kmers)."""
    return super_kmer_counts(reads, k, m, bins).groupBy("bin").agg(F.sum("n").alias("n_super"), F.sum("n_kmers").alias("n_kmers"))


def sampled(reads: DataFrame, one_in: int) -> DataFrame:
    """Every ``one_in``-th read by id, or chunk by a hash of id and place: a sample that does not change when a task runs again."""
    key = F.xxhash64("read_id", "chunk_start") if "chunk_start" in reads.columns else F.col("read_id")
    return reads.where(F.pmod(key, F.lit(one_in)) == 0)
