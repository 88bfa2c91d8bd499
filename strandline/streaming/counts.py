"""Counts of reads that arrive as files: the batch plan on a stream.

Counts are state by k-mer, kept by Spark in RocksDB, so the state of a task is bounded by its disk and
not by its heap, and only what a batch changed is written to the checkpoint. There is no event time, so
nothing is ever dropped. Where even that state is too much, ``start_batch_counts`` keeps none: every
batch writes its own counts, by bin, and ``merged_batches`` adds them up when they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from strandline.operators.bin_counting import counts_in_bins, short_counts_in_bins
from strandline.operators.kmers import LONG, count_kmers

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_reads(spark: SparkSession, path: str, schema: str = "read_id bigint, seq_tag string, seq string", most_files: int = 1000) -> DataFrame:
    """Reads from Parquet files as they appear in a folder, at most so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def stream_counts(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(kmer, n) so far, of a stream of reads."""
    return count_kmers(reads, k, canonical=canonical)


def with_settings(spark: SparkSession, settings: dict[str, str], start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query, which keeps the session's settings of that moment, with these among them."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        return start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def by_batch(rows: DataFrame, path: str, checkpoint: str, of_batch: Callable[[DataFrame], DataFrame], available_now: bool) -> DataStreamWriter:
    """Write what ``of_batch`` makes of each batch to a folder of its own; a batch that runs again writes that folder again."""

    def write(batch_rows: DataFrame, batch: int) -> None:
        of_batch(batch_rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if available_now else writer


def start_counts(reads: DataFrame, k: int, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append the counts that each batch changes below ``path``, a folder per batch; ``latest_counts`` reads them.

    Counts are exact after a failure: state and input go back to the same batch, which writes its own folder again.
    With ``available_now`` the query ends when it has read what was there.
    """
    writer = by_batch(stream_counts(reads, k), path, checkpoint, lambda changed: changed, available_now).outputMode("update")
    return with_settings(reads.sparkSession, STATE, writer.start)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, n) so far: each k-mer as the last batch that changed it has it."""
    rows = spark.read.schema("kmer string, n bigint, batch bigint").parquet(path)
    return rows.groupBy("kmer").agg(F.max_by("n", "batch").alias("n"))


def start_batch_counts(reads: DataFrame, k: int, m: int, max_bins: int, path: str, checkpoint: str, parts: np.ndarray | None = None, available_now: bool = False) -> StreamingQuery:
    """Write the counts of each batch alone, by bin, below ``path``: no state, whatever the number of k-mers.

    Short k-mers are added up where the read is, others are counted inside bins. ``parts`` says into how many parts a batch's
    large bins go, as for ``counts_in_bins``; short k-mers need none.
    """

    def of_batch(batch: DataFrame) -> DataFrame:
        return short_counts_in_bins(batch, k, m, max_bins) if m <= k < LONG else counts_in_bins(batch, k, m, max_bins, parts)

    return by_batch(reads, path, checkpoint, of_batch, available_now).start()


def merged_batches(spark: SparkSession, path: str, bins: list[int] | None = None) -> DataFrame:
    """(bin, kmer, n) so far: the sums over all batches, or of some bins only."""
    rows = spark.read.schema("bin int, kmer string, n bigint").parquet(path)
    rows = rows if bins is None else rows.where(F.col("bin").isin(bins))
    return rows.groupBy("bin", "kmer").agg(F.sum("n").alias("n"))
