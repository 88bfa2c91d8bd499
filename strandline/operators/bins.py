"""Bins, their sizes, signature histograms, and counts by way of super-k-mers and (k,x)-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.bases import bin_of
from strandline.functions.minimizer import signature, signature_number
from strandline.operators.kmers import count_kmers
from strandline.operators.minimizers import kx_mers, super_kmers
from strandline.operators.sizes import bin_sizes, sampled, super_kmer_counts  # noqa: F401


def signature_histogram(reads: DataFrame, k: int, m: int, bins: int, totals: bool = True) -> DataFrame:
    """(bin, sig, n): super-k-mers by bin and signature; with a total per bin under a null signature."""
    each = super_kmer_counts(reads, k, m, bins).select("bin", "sig", "n")
    if not totals:
        return each
    return each.unionByName(each.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", F.lit(None).cast("string").alias("sig"), "n"))


def bin_totals(reads: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, n_super, n_sigs)."""
    return super_kmer_counts(reads, k, m, bins).groupBy("bin").agg(F.sum("n").alias("n_super"), F.count("*").alias("n_sigs"))


def counts_via_super_kmers(reads: DataFrame, k: int, m: int) -> DataFrame:
    """(kmer, n) by way of super-k-mers, each a short read of its own."""
    return count_kmers(super_kmers(reads, k, m).select("read_id", F.col("super_kmer").alias("seq")), k)


def counts_via_kx_mers(reads: DataFrame, k: int, m: int, x: int) -> DataFrame:
    """(kmer, n) by way of (k,x)-mers, whose k-mers are canonical as they stand."""
    return count_kmers(kx_mers(reads, k, m, x).select("read_id", F.col("kxmer").alias("seq")), k, canonical=False)


def binned_counts(counts: DataFrame, k: int, m: int, bins: int) -> DataFrame:
    """(bin, kmer, n) from (kmer, n). A k-mer and its reverse complement have one signature, so one bin."""
    sig = signature(F.col("kmer"), k, m)["v"]
    return counts.select(bin_of(signature_number(sig, m), bins).alias("bin"), "kmer", "n")


def top_kmers(counts: DataFrame, most: int) -> DataFrame:
    """(bin, rank, kmer, n): the ``most`` most frequent k-mers of each bin, ties by k-mer. Each task keeps its own first ones before anything is moved."""
    order = Window.partitionBy("bin").orderBy(F.desc("n"), "kmer")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("bin", "rank", "kmer", "n")
