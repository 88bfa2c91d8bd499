"""Balanced placement of bins: longest processing time first, and rows dealt by it.

Only bins and their sizes, a number bounded by 4^m and ``max_bins``, come to the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lpt(sizes: list[tuple[int, int]], slots: int) -> dict[int, int]:
    """Slot of each bin: items (bin, size) in falling order of size, ties by bin, each to the least loaded slot, ties by slot."""
    heap = [(0, s) for s in range(slots)]
    placed = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, slot = heapq.heappop(heap)
        placed[item] = slot
        heapq.heappush(heap, (load + size, slot))
    return placed


def assign(sizes: DataFrame, slots: int, size_col: str = "n_kmers") -> DataFrame:
    """(bin, slot) for the bins of ``sizes``."""
    placed = lpt([(r["bin"], r["n"]) for r in sizes.select("bin", F.col(size_col).alias("n")).collect()], slots)
    return sizes.sparkSession.createDataFrame(sorted(placed.items()), "bin int, slot int")


def deal(rows: DataFrame, assignment: DataFrame, slots: int) -> DataFrame:
    """``rows`` with their ``place``, each place a partition; bins without one go by their number."""
    placed = rows.join(F.broadcast(assignment.withColumnRenamed("slot", "place")), "bin", "left").withColumn("place", F.coalesce("place", F.pmod("bin", F.lit(slots))))
    return placed.repartitionById(slots, F.col("place"))


def balance(rows: DataFrame, assignment: DataFrame, slots: int) -> DataFrame:
    """(slot, bin, n): how many of ``rows`` (with a bin) of each bin lie in each partition once they are dealt.

    The partition is the one that a row is met in behind the exchange, not the one that it was meant for.
    """
    met = deal(rows, assignment, slots).select(F.spark_partition_id().alias("slot"), "bin")
    return met.groupBy("slot", "bin").agg(F.count("*").alias("n"))
