"""Jobs from a configuration to files: counting, signature histogram, balance of bins, counts of many sequences, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline.config import CounterConfig, DistanceConfig
from strandline.operators.bin_counting import MOST, counted_slots, counts_in_bins, packed_super_kmers, slots_of
from strandline.operators.bins import bin_sizes, binned_counts, sampled, signature_histogram
from strandline.operators.distance import distances, normalized
from strandline.operators.kmers import count_by_tag, count_kmers
from strandline.operators.minimizers import super_kmers
from strandline.operators.partitioning import assign, balance, deal
from strandline.functions.packed import LONGEST
from strandline.runtime import bytes_of, shared_root, ship, spread
from strandline.sources.ranges import COMPRESSED, STORES, qualified, read_fastq, read_sequences, sampled_sizes
from strandline.sources.reads import read_fasta
from strandline.sources.sinks import write_balance, write_counts, write_distances, write_nothing, write_signatures, write_totals

SAMPLE_ONE_IN = 100
#: Bytes of input for each of a job's ``tasks``. Of a larger one bins are counted in parts by more tasks than were asked for.
BYTES_OF_TASK = 128 << 20


#: Endings of FASTQ files, compressed or not.
FASTQ_NAMES = (".fastq", ".fq")


def open_reads(spark: SparkSession, config: CounterConfig | DistanceConfig, places: bool = True) -> DataFrame:
    """The reads of a job. Without ``places`` chunks of long sequences need not know where they lie."""
    ship(spark)
    if config.long_sequences:
        return read_sequences(spark, config.input_path, config.k, places)
    if config.input_path.rstrip("/").removesuffix(".gz").endswith(FASTQ_NAMES):
        return read_fastq(spark, config.input_path)
    return spread(read_fasta(spark, config.input_path))


def sample_sizes(spark: SparkSession, reads: DataFrame, config: CounterConfig) -> DataFrame:
    """(bin, n_kmers) by a sample: of byte ranges, which are read alone, where the input is FASTA that can be cut; else of reads."""
    path, k, m = config.input_path, config.k, config.m
    fasta = not path.rstrip("/").endswith((*FASTQ_NAMES, *(f".{c}" for c in COMPRESSED)))
    if fasta and not config.uppercase and qualified(spark, path).split(":")[0] in STORES:
        return sampled_sizes(spark, path, k, m, config.bins, SAMPLE_ONE_IN).select("bin", "n_kmers")
    return bin_sizes(sampled(reads, SAMPLE_ONE_IN), k, m, config.bins).select("bin", (F.col("n_kmers") * SAMPLE_ONE_IN).alias("n_kmers"))


def placement(spark: SparkSession, reads: DataFrame, config: CounterConfig) -> tuple[DataFrame, int]:
    """(bin, slot) by the sizes of bins in a sample, and the number of slots."""
    slots = config.tasks or spark.sparkContext.defaultParallelism
    return assign(sample_sizes(spark, reads, config), slots), slots


def asked_tasks(reads: DataFrame, config: CounterConfig) -> bool:
    """Whether the tasks that were asked for are given, or too few for the input."""
    return bool(config.tasks) and bytes_of(reads) <= config.tasks * BYTES_OF_TASK


def made_counts(spark: SparkSession, config: CounterConfig) -> tuple[DataFrame, bool, bool]:
    """(bin, kmer, n) of a count job, whether bins lie in as few partitions as they should be written by, and whether they may lie in several.

    Canonical k-mers of up to 62 bases are counted inside their bins, and counts lie by bin as they come. With
    ``balance`` super-k-mers go to the task that the placement names. Else bins that a sample shows to be
    large are counted in parts; the sample is left out where the whole input is smaller than a part.
    """
    reads = open_reads(spark, config, places=False)
    if config.uppercase:
        reads = reads.withColumn("seq", F.upper("seq"))
    placed, k, m = bool(config.balance or config.tasks), config.k, config.m
    if not config.canonical or k > LONGEST:
        counts = binned_counts(count_kmers(reads, k, config.canonical), k, m, config.bins)
        if config.balance:
            counts = deal(counts, *placement(spark, reads, config)).drop("place")
        elif config.tasks:
            counts = counts.repartition(config.tasks, "bin")
    elif config.balance:
        rows = packed_super_kmers(reads, k, m, config.bins).withColumn("bin", F.shiftright("slot", 32).cast("int"))
        counts = counted_slots(deal(rows, *placement(spark, reads, config)), k, "place")
    elif asked_tasks(reads, config):
        counts = counted_slots(packed_super_kmers(reads, k, m, config.bins).repartition(config.tasks, "slot"), k)
    else:
        parts = None
        if bytes_of(reads) > MOST:
            parts = slots_of(sample_sizes(spark, reads, config), config.bins)
        counts, placed = counts_in_bins(reads, k, m, config.bins, parts), True
    split = k <= LONGEST and config.canonical and not asked_tasks(reads, config) or not config.tasks
    return counts, placed, split and not config.balance


def count_job(spark: SparkSession, config: CounterConfig, observation: Observation | None = None) -> DataFrame:
    """(bin, kmer, n), written below ``config.output_dir()`` unless ``write`` is off. ``use_hash`` off: in order in each bin.

    An ``observation`` gets n_kmers, n and most (distinct k-mers, occurrences, and those of the most frequent one) of the run itself.
    """
    counts, placed, split = made_counts(spark, config)
    seen = lambda rows: rows if observation is None else rows.observe(observation, F.count("*").alias("n_kmers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    if config.write:
        write_counts(counts, config.output_dir(), sort=not config.use_hash, binary=config.binary, placed=placed, by_range=split, seen=seen)
    else:
        write_nothing(seen(counts))
    return counts


def balance_job(spark: SparkSession, config: CounterConfig) -> DataFrame:
    """(slot, bin, n): the super-k-mers of each bin in each task, as they arrive there by the sample's placement, written as text with totals."""
    reads = open_reads(spark, config)
    assignment, slots = placement(spark, reads, config)
    report = balance(super_kmers(reads, config.k, config.m, config.bins).select("bin"), assignment, slots)
    if config.write:
        write_balance(report, config.output_dir())
    return report


def totals_job(spark: SparkSession, config: CounterConfig) -> DataFrame:
    """(seq_tag, kmer, n) of many sequences; the sums over all of them are written as text."""
    reads = open_reads(spark, config)
    if config.write:
        write_totals(count_kmers(reads, config.k), config.output_dir())  # the sums need no counts by sequence
    return count_by_tag(reads, config.k)


def signature_job(spark: SparkSession, config: CounterConfig) -> DataFrame:
    """(bin, sig, n) with totals, written as text."""
    histogram = signature_histogram(open_reads(spark, config), config.k, config.m, config.bins)
    if config.write:
        write_signatures(histogram, config.output_dir(debug=not config.output_path, root=shared_root(spark)))
    return histogram


def distance_job(spark: SparkSession, config: DistanceConfig) -> DataFrame:
    """(s1, s2, distance) over the sequences that the headers' tags name."""
    reads = open_reads(spark, config)
    counts = count_by_tag(reads, config.k)
    if config.normalize:
        counts = normalized(counts, reads, config.k)
    found = distances(counts, config.measure)
    if config.write:
        write_distances(found, config.output_dir())
    return found
