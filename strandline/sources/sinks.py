"""Writers of counts, signatures and balances. All use Spark's committer: a repeated task leaves no half file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_counts(counts: DataFrame, path: str, sort: bool = True, binary: bool = False, placed: bool = False, by_range: bool = False, seen: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """(bin, kmer, n) below ``path``, a folder per bin; lines of k-mer, tab, count, or Parquet if ``binary``.

    ``placed``: each bin lies in as few partitions as it should be written by, and nothing is shuffled again.
    ``by_range``, with ``sort``: rows go to tasks by ranges of bin and k-mer, so a large bin becomes several files
    whose names are in the order of their k-mers. ``seen`` gets the rows as they go to the files, so it can observe them: ranges
    are found by a look at the rows before, which would count twice.
    """
    if sort and by_range:
        dealt = counts.repartitionByRange("bin", "kmer")
    else:
        dealt = counts if placed else counts.repartition("bin")
    dealt = seen(dealt) if seen else dealt
    if sort:
        dealt = dealt.sortWithinPartitions("bin", "kmer")
    out = dealt.select("bin", "kmer", "n").write.mode("overwrite").partitionBy("bin")
    if binary:
        out.option("compression", "zstd").parquet(path)
    else:
        out.option("sep", "\t").csv(path)


def read_counts(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """(bin, kmer, n) as written by ``write_counts``."""
    kind = "kmer string, n bigint, bin int"
    rows = spark.read.schema(kind).parquet(path) if binary else spark.read.schema(kind).option("sep", "\t").csv(path)
    return rows.select("bin", "kmer", "n")


def write_totals(counts: DataFrame, path: str) -> None:
    """Lines of k-mer, tab, sum over all sequences, from (kmer, n) with any number of rows of a k-mer, as (seq_tag, kmer, n) has."""
    totals = counts.groupBy("kmer").agg(F.sum("n").alias("n"))
    totals.select("kmer", "n").write.mode("overwrite").option("sep", "\t").csv(path)


def write_nothing(result: DataFrame) -> None:
    """All the work, no output."""
    result.write.format("noop").mode("overwrite").save()


def write_signatures(histogram: DataFrame, path: str) -> None:
    """(bin, sig, n) below ``path``, a folder per bin; the row without a signature is written as Total, last."""
    rows = histogram.select("bin", F.coalesce("sig", F.lit("Total")).alias("sig"), "n", F.col("sig").isNull().alias("last"))
    rows.repartition("bin").sortWithinPartitions("bin", "last", "sig").select("bin", "sig", "n").write.mode("overwrite").partitionBy("bin").option("sep", "\t").csv(path)


def write_balance(balance: DataFrame, path: str) -> None:
    """(slot, bin, n) below ``path``, a folder per slot, ascending by n, with a Total line."""
    total = balance.groupBy("slot").agg(F.sum("n").alias("n")).select("slot", F.lit("Total").alias("bin"), "n", F.lit(1).alias("last"))
    rows = balance.select("slot", F.col("bin").cast("string").alias("bin"), "n", F.lit(0).alias("last")).unionByName(total)
    rows.repartition("slot").sortWithinPartitions("slot", "last", "n").select("slot", "bin", "n").write.mode("overwrite").partitionBy("slot").csv(path)


def write_distances(distances: DataFrame, path: str) -> None:
    distances.write.mode("overwrite").option("sep", "\t").csv(path)
