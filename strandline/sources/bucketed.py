"""A count table in buckets of bins: each run's counts are added by one exchange, all are merged and compared by none.

A table holds (source, bin, kmer, n), a folder per source, dealt to its buckets by bin and in order of bin and k-mer
within a file. All sources lie alike, so a grouping by bin and k-mer finds its rows where they are, and so does one by bin behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def add_counts(counts: DataFrame, name: str, source: str, path: str, buckets: int = BUCKETS) -> None:
    """Add (bin, kmer, n) as ``source`` to the table ``name``, which is made with its files below ``path`` if there is none."""
    spark = counts.sparkSession
    if spark.catalog.tableExists(name) and not spark.table(name).where(F.col("source") == source).isEmpty():
        raise ValueError(f"{name} has counts of {source} already")
    dealt = counts.select("bin", "kmer", "n", F.lit(source).alias("source")).repartition(buckets, "bin")
    dealt.write.mode("append").partitionBy("source").bucketBy(buckets, "bin").sortBy("bin", "kmer").option("path", path).option("compression", "zstd").saveAsTable(name)


def open_counts(spark: SparkSession, name: str) -> DataFrame:
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    return spark.table(name)


def merged_counts(spark: SparkSession, name: str) -> DataFrame:
    """(bin, kmer, n): the sums over all sources."""
    return open_counts(spark, name).groupBy("bin", "kmer").agg(F.sum("n").alias("n"))


def compared_bins(spark: SparkSession, name: str, one: str, other: str) -> DataFrame:
    """(bin, n_one, n_other, n_both, kmers_both): by bin, occurrences in each source, in both (the smaller number), and common k-mers."""
    rows = open_counts(spark, name).where(F.col("source").isin(one, other))
    n = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)) for s in (one, other)]
    sides = rows.groupBy("bin", "kmer").agg(n[0].alias("a"), n[1].alias("b"))
    both = F.least("a", "b")
    return sides.groupBy("bin").agg(F.sum("a").alias("n_one"), F.sum("b").alias("n_other"), F.sum(both).alias("n_both"), F.count(F.when(both > 0, 1)).alias("kmers_both"))
