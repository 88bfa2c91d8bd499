"""The catalogue of queries over the driver's tables, each with its SQL for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.cli import JOBS, config_of, parser
from strandline.config import CounterConfig, DistanceConfig, n_bins
from strandline.functions import bases, minimizer, packed
from strandline.operators import bin_counting as bc
from strandline.operators import bins as b
from strandline.operators import distance as d
from strandline.operators import kmers as km
from strandline.operators import minimizers as mz
from strandline.operators import partitioning as pt
from strandline.plans import jobs
from strandline.runtime import TASK_BYTES, UNKNOWN_BYTES, bytes_of, scratch, ship, spread
from strandline.sources import sinks
from strandline.sources.bucketed import add_counts, compared_bins, merged_counts
from strandline.sources.ranges import read_fasta_ranges, read_fastq, sampled_sizes
from strandline.sources.reads import LETTER_BASES, LETTERS, chunk_reads, read_fasta, read_long_fasta, reads_from_text, tag_of
from strandline.sources.tables import register_functions
from strandline.streaming.counts import latest_counts, merged_batches, start_batch_counts, start_counts, stream_reads

K, M, X, SLOTS, SAMPLE = 11, 4, 3, 8, 10
BINS = n_bins(M, 2000)


def reads_of(spark: SparkSession, sf_dir: str, tag_col: str = "source") -> DataFrame:
    ship(spark)
    return reads_from_text(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tag_col, "text")), tag_col=tag_col)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return km.count_kmers(reads_of(spark, sf_dir), K)


def window_invalid_bounds(reads: DataFrame) -> DataFrame:
    """Windows with characters that are no bases, and the places of the first and the last one."""
    found = km.invalid_bounds(chunk_reads(reads, K), K)
    return found.select("read_id", (F.col("chunk_start") + F.col("i")).cast("int").alias("i"), "first_bad", "last_bad")


def kmer_scalars(counted: DataFrame) -> DataFrame:
    k = F.col("kmer")
    packed = bases.pack(k)
    return counted.select(
        "kmer", packed.alias("packed"), bases.unpack(packed, K).alias("unpacked"), bases.first_m(k, M).alias("first_m"), bases.last_m(k, M).alias("last_m"),
        bases.base_at(k, 5).alias("base_5"), bases.reverse_complement(k).alias("rc"), minimizer.norm(bases.last_m(k, M), M).alias("last_norm"),
    )


def bit_helpers(reads: DataFrame) -> DataFrame:
    """Masks, non-negative remainders and orientation bits, of each read's id and its first bases."""
    bit = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(bases.base_at(F.col("seq"), i).isin("G", "T"), 1).otherwise(0))
    return reads.select(
        "read_id", bases.ones_mask(F.pmod("read_id", F.lit(40))).alias("mask"), F.pmod(-F.col("read_id"), F.lit(7)).alias("slot"),
        bases.orientations_to_number(bit).alias("bits"), bases.bin_of(F.col("read_id"), BINS).alias("bin"),
    )


def super_kmer_sizes(reads: DataFrame) -> DataFrame:
    return b.bin_sizes(reads, K, M, BINS)


def lpt_assignment(reads: DataFrame) -> DataFrame:
    return pt.assign(super_kmer_sizes(reads), SLOTS)


def partition_balance(reads: DataFrame) -> DataFrame:
    """Bins and super-k-mers that each task meets behind the exchange by the placement."""
    met = pt.balance(mz.super_kmers(reads, K, M, BINS).select("bin"), lpt_assignment(reads), SLOTS)
    return met.groupBy("slot").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_super"))


def dealt_counts(reads: DataFrame) -> DataFrame:
    """Counts by the task that made them, where super-k-mers are dealt by the placement."""
    rows = bc.packed_super_kmers(reads, K, M, BINS).withColumn("bin", F.shiftright("slot", 32).cast("int"))
    counted = bc.counted_slots(pt.deal(rows, lpt_assignment(reads), SLOTS), K, "place")
    return counted.groupBy(F.spark_partition_id().alias("slot")).agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n"))


def split_bin_counts(reads: DataFrame) -> DataFrame:
    """k-mers of 28 bases counted in bins, those of more than 20,000 k-mers by a sample in parts."""
    sizes = b.bin_sizes(b.sampled(reads, SAMPLE), 28, 10, 2048)
    return bc.counts_in_bins(reads, 28, 10, 2048, bc.slots_of(sizes, 2048, most=20_000, scale=SAMPLE)).select("kmer", "n")


def observed_norms(reads: DataFrame) -> DataFrame:
    """The m-mers that occur in reads, how often, and their norms."""
    met = km.count_kmers(reads, M, canonical=False).withColumnRenamed("kmer", "mmer")
    sig = minimizer.norm(F.col("mmer"), M)
    return met.select("mmer", "n", sig.alias("norm"), minimizer.signature_number(sig, M).alias("norm_number"), minimizer.is_allowed(F.col("mmer"), M).alias("allowed"))


LANGUAGES = ("en", "de", "fr", "es")


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language, those of all other languages together."""
    counted = km.count_by_tag(reads_of(spark, sf_dir, "lang"), K)
    named = F.when(F.col("seq_tag").isin(*LANGUAGES), F.col("seq_tag")).otherwise("other")
    wide = counted.withColumn("seq_tag", named).groupBy("kmer").pivot("seq_tag", [*LANGUAGES, "other"]).agg(F.sum("n"))
    return wide.select("kmer", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in (*LANGUAGES, "other")])


def write_fasta(reads: DataFrame, path: str, width: int, same_header: bool = False) -> None:
    """Records with lines of ``width`` characters; each third one ends its lines with a carriage return too."""
    header = F.lit("chr1 copied") if same_header else F.concat(F.coalesce("seq_tag", F.lit("")), F.lit("."), F.col("read_id").cast("string"))
    end = F.when(F.pmod("read_id", F.lit(3)) == 0, "\r\n").otherwise("\n")
    body = F.regexp_replace(F.coalesce("seq", F.lit("")), f"(.{{{width}}})(?=.)", "$1\n") if width < 1 << 20 else F.coalesce("seq", F.lit(""))
    reads.select(F.concat(F.lit(">"), header, end, F.when(end == "\n", body).otherwise(F.replace(body, F.lit("\n"), F.lit("\r\n")))).alias("value")).write.text(path)


def fasta_of(spark: SparkSession, sf_dir: str, long: bool = False) -> str:
    path = scratch(spark, "fasta")
    write_fasta(reads_of(spark, sf_dir), path, 70, same_header=long)
    return path


def fasta_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the reads written as FASTA: by tag, their number and length."""
    back = read_fasta(spark, fasta_of(spark, sf_dir))
    return back.groupBy("seq_tag").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("chars"), F.countDistinct("read_id").alias("ids"))


def long_fasta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of long sequences that all have one header, read in chunks of 500."""
    return km.count_kmers(read_long_fasta(spark, fasta_of(spark, sf_dir, long=True), K, chunk=500), K)


def long_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-k-mers by bin and signature of chunks of long sequences: those over a border count once."""
    chunks = read_long_fasta(spark, fasta_of(spark, sf_dir, long=True), K, chunk=500)
    return b.signature_histogram(chunks, K, M, BINS, totals=False)


def ranged_counts(width: int) -> Callable[[SparkSession, str], DataFrame]:
    """Counts of long sequences read by byte ranges, in lines of ``width`` characters; nothing but k-mers is shuffled."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "fasta")
        write_fasta(reads_of(spark, sf_dir), path, width, same_header=True)
        return km.count_kmers(read_fasta_ranges(spark, path, K, chunk=500, size=50_000, places=False), K)

    return made


def ranged_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-k-mers by bin and signature of sequences read by byte ranges: those over a border count once."""
    chunks = read_fasta_ranges(spark, fasta_of(spark, sf_dir, long=True), K, chunk=500, size=50_000)
    return b.signature_histogram(chunks, K, M, BINS, totals=False)


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four-line records; the qualities go through all values of 0 to 40, among them those of @ and +."""
    seq = F.coalesce("seq", F.lit(""))
    quality = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.char(F.pmod((i - 1) * 7 + F.col("read_id"), F.lit(41)) + 33))
    quality = F.when(F.length(seq) > 0, F.array_join(quality, "")).otherwise("")
    reads.select(F.concat(F.lit("@"), F.coalesce("seq_tag", F.lit("")), F.lit("."), F.col("read_id").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), quality).alias("value")).write.text(path)


def fastq_counts(least_quality: int) -> Callable[[SparkSession, str], DataFrame]:
    """Counts of reads as FASTQ, read by byte ranges; bases below the quality are no bases."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "fastq")
        write_fastq(reads_of(spark, sf_dir), path)
        return km.count_kmers(read_fastq(spark, path, least_quality, size=100_000), K)

    return made


def config_for(spark: SparkSession, sf_dir: str, **more) -> CounterConfig:
    return CounterConfig(k=K, m=M, x=X, max_bins=2000, input_path=fasta_of(spark, sf_dir), output_path=scratch(spark, "job") + "/", **more)


def counted_files(binary: bool, **more) -> Callable[[SparkSession, str], DataFrame]:
    """The count job from FASTA to files, and what the files hold."""

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        config = config_for(spark, sf_dir, binary=binary, **more)
        jobs.count_job(spark, config)
        return sinks.read_counts(spark, config.output_dir(), binary)

    return made


def counted_by_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = parser().parse_args(["count", str(K), str(M), str(X), "2000", "0", "0", fasta_of(spark, sf_dir), scratch(spark, "job") + "/", "p_", "1", "0", "1", str(SLOTS)])
    config = config_of(args)
    JOBS[args.job](spark, config)
    return sinks.read_counts(spark, config.output_dir())


def arriving(spark: SparkSession, sf_dir: str, path: str, batches: int = 4) -> DataFrame:
    """A stream of the reads, which come in files that are read in four batches, of two files each or of as many as make tasks for the input."""
    reads = reads_of(spark, sf_dir)
    size = bytes_of(reads)
    files = max(2, size // (batches * TASK_BYTES) if size < UNKNOWN_BYTES else 0)
    reads.repartition(batches * files, "read_id").write.parquet(f"{path}/in")
    return stream_reads(spark, f"{path}/in", most_files=files)


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of reads that arrive in files of a folder, batch after batch, with the counts so far as state."""
    path = scratch(spark, "stream")
    start_counts(arriving(spark, sf_dir, path), K, f"{path}/out", f"{path}/checkpoint", available_now=True).awaitTermination()
    return latest_counts(spark, f"{path}/out")


def streamed_bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by bin of reads that arrive in files of a folder, from the counts of each batch, without state."""
    path = scratch(spark, "stream")
    start_batch_counts(arriving(spark, sf_dir, path), K, M, BINS, f"{path}/out", f"{path}/checkpoint", available_now=True).awaitTermination()
    return merged_batches(spark, f"{path}/out")


def compute_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count job without output, run once: what it made, by bin, with the most frequent and the last k-mer, which needs all of them as texts."""
    made, *_ = jobs.made_counts(spark, config_for(spark, sf_dir, write=False))
    return made.groupBy("bin").agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max("kmer").alias("last"))


def long_by_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of long sequences, type 1 of the command line."""
    args = parser().parse_args(["count", str(K), str(M), str(X), "2000", "1", "1", fasta_of(spark, sf_dir, long=True), scratch(spark, "job") + "/"])
    config = config_of(args)
    JOBS[args.job](spark, config)
    return sinks.read_counts(spark, config.output_dir())


def distance_by_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = parser().parse_args(["distance", str(K), str(M), str(X), "2000", "1", "0", fasta_of(spark, sf_dir), scratch(spark, "job") + "/", "--measure", "kld_ln"])
    config = config_of(args)
    JOBS[args.job](spark, config)
    rows = spark.read.option("sep", "\t").schema("s1 string, s2 string, distance double").csv(config.output_dir())
    return rows.select("s1", "s2", (F.round("distance", 4) + 0.0).alias("distance"))


def bucketed_halves(spark: SparkSession, sf_dir: str) -> str:
    """A count table in buckets, with the reads of even and of odd ids as its sources."""
    reads, name, path = reads_of(spark, sf_dir), f"strandline_{uuid.uuid4().hex}", scratch(spark, "counts")
    for half in (0, 1):
        add_counts(bc.counts_in_bins(reads.where(F.pmod("read_id", F.lit(2)) == half), K, M, BINS), name, f"half_{half}", path, buckets=16)
    return name


def ranged_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-mers by bin, estimated from all byte ranges of a file, which leaves no error."""
    return sampled_sizes(spark, fasta_of(spark, sf_dir), K, M, BINS, one_in=1, size=100_000)


def totals_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_for(spark, sf_dir)
    jobs.totals_job(spark, config)
    return spark.read.option("sep", "\t").schema("kmer string, n bigint").csv(config.output_dir())


def signature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = config_for(spark, sf_dir)
    jobs.signature_job(spark, config)
    return spark.read.option("sep", "\t").schema("sig string, n bigint, bin int").csv(config.output_dir()).select("bin", "sig", "n")


def balance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance report by bin: its super-k-mers, all met in one task, and the task's total as far as the report's lines say so."""
    config = config_for(spark, sf_dir, balance=True, tasks=SLOTS)
    jobs.balance_job(spark, config)
    rows = spark.read.schema("bin string, n bigint, slot int").csv(config.output_dir())
    whole = rows.where("bin = 'Total'").select("slot", F.col("n").alias("whole"))
    sums = rows.where("bin <> 'Total'").groupBy("slot").agg(F.sum("n").alias("s")).join(whole, "slot")
    each = rows.where("bin <> 'Total'").groupBy(F.col("bin").cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("n_tasks"), F.max("slot").alias("slot"))
    return each.join(sums, "slot").select("bin", "n", "n_tasks", (F.col("s") == F.col("whole")).alias("total_agrees"))


def distance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = DistanceConfig(k=K, m=M, x=X, max_bins=2000, input_path=fasta_of(spark, sf_dir), output_path=scratch(spark, "job") + "/")
    jobs.distance_job(spark, config)
    rows = spark.read.option("sep", "\t").schema("s1 string, s2 string, distance double").csv(config.output_dir())
    return rows.select("s1", "s2", F.round("distance", 4).alias("distance"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that jobs with the parameters of each line of orders would write to."""
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") + 3).cast("int").alias("m"), F.pmod("l_partkey", F.lit(5)).cast("int").alias("x"), (F.lit(10) * F.pmod("l_suppkey", F.lit(300)) + 1).cast("int").alias("max_bins"), F.pmod("l_orderkey", F.lit(2)).cast("int").alias("kind")).distinct()

    def named(batches):
        for batch in batches:
            rows = batch.to_pylist()
            names = [CounterConfig(k=28, m=r["m"], x=r["x"], max_bins=r["max_bins"], long_sequences=bool(r["kind"]), output_path="/out/", prefix="p_").output_dir() for r in rows]
            yield batch.append_column("folder", pa.array(names, pa.string()))

    return wanted.mapInArrow(named, "m int, x int, max_bins int, kind int, folder string")


def long_kmer_words(reads: DataFrame) -> DataFrame:
    """k-mers of 40 bases as two numbers."""
    w = [F.col("hi"), F.col("lo")]
    return bc.long_words(reads, 40).select(packed.text(w, 40).alias("kmer"), "n", w[0].alias("word_0"), w[1].alias("word_1"))


def sql_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers of reads by the function that SQL users get."""
    register_functions(spark)
    reads = reads_of(spark, sf_dir)
    return spark.sql("SELECT kmer, count(*) AS n FROM (SELECT explode(all) AS kmer FROM (SELECT kmers(seq, 11) AS all FROM {reads})) GROUP BY kmer", reads=reads)


def sql_table_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers of reads by the table function that SQL users get."""
    register_functions(spark)
    return spark.sql("SELECT kmer, count(*) AS n FROM {reads}, LATERAL kmers_of(seq, 11) GROUP BY kmer", reads=reads_of(spark, sf_dir))


def distance_of(measure: str, normalize: bool = False, **how) -> Callable[[DataFrame], DataFrame]:
    def made(reads: DataFrame) -> DataFrame:
        counted = km.count_by_tag(reads, K)
        found = d.distances(d.normalized(counted, reads, K) if normalize else counted, measure, **how)
        return found.select("s1", "s2", (F.round("distance", 12 if normalize else 4) + 0.0).alias("distance"))  # no negative zero

    return made


def header_tags(reads: DataFrame) -> DataFrame:
    header = F.concat("seq_tag", F.lit("."), F.col("read_id").cast("string"), F.lit(" length="), F.length("seq").cast("string"))
    return reads.select(tag_of(header).alias("seq_tag")).groupBy("seq_tag").agg(F.count("*").alias("n"))


def _reads(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(reads_of(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "canonical_kmer_counts": counts,
    "canonical_kmer_counts_k28": _reads(lambda r: bc.count_long(r, 28)),
    "forward_kmer_counts": _reads(lambda r: km.count_kmers(r, K, canonical=False)),
    "sort_path_counts": _reads(lambda r: b.binned_counts(km.count_kmers(r, K), K, M, BINS).repartition("bin").sortWithinPartitions("bin", "kmer")),
    "window_invalid_bounds": _reads(window_invalid_bounds),
    "valid_segments": _reads(lambda r: km.valid_segments(r, K)),
    "kmer_orientation": _reads(lambda r: km.count_kmers(r, K, canonical=False).groupBy(bases.orientation(F.col("kmer")).alias("orientation")).agg(F.sum("n").alias("n"))),
    "kmer_packed": lambda spark, sf_dir: kmer_scalars(counts(spark, sf_dir)),
    "bit_helpers": _reads(bit_helpers),
    "norm_table": _reads(observed_norms),
    "kmer_signatures": _reads(lambda r: mz.kmer_signatures(r, K, M)),
    "kmer_signature_values": lambda spark, sf_dir: counts(spark, sf_dir).select("kmer", minimizer.signature(F.col("kmer"), K, M).alias("s")).select("kmer", F.col("s.v").alias("sig"), F.col("s.p").alias("sig_pos")),
    "super_kmers": _reads(lambda r: mz.super_kmers(r, K, M).select("read_id", "start", "sig", "sig_pos", "super_kmer", "n_kmers")),
    "super_kmer_bins": _reads(lambda r: mz.super_kmers(r, K, M, BINS, "seq_tag").groupBy("seq_tag", "bin").agg(F.count("*").alias("n_super"), F.sum("n_kmers").alias("n_kmers"))),
    "bin_sizes": _reads(super_kmer_sizes),
    "bin_sizes_sampled": _reads(lambda r: super_kmer_sizes(b.sampled(r, SAMPLE)).orderBy(F.desc("n_kmers"), "bin")),
    "bin_signature_histogram": _reads(lambda r: b.signature_histogram(r, K, M, BINS)),
    "bin_totals": _reads(lambda r: b.bin_totals(r, K, M, BINS)),
    "kx_mers": _reads(lambda r: mz.kx_mers(r, K, M, X)),
    "counts_via_kxmers": _reads(lambda r: b.counts_via_kx_mers(r, K, M, X)),
    "counts_via_superkmers": _reads(lambda r: b.counts_via_super_kmers(r, K, M)),
    "chunked_counts": _reads(lambda r: km.count_kmers(chunk_reads(r, K, 500), K)),
    "lpt_assignment": _reads(lpt_assignment),
    "partition_balance": _reads(partition_balance),
    "dealt_counts": _reads(dealt_counts),
    "header_tags": _reads(header_tags),
    "multiseq_counts": _reads(lambda r: km.count_by_tag(r, K)),
    "multiseq_totals": _reads(lambda r: km.count_by_tag(r, K).groupBy("kmer").agg(F.sum("n").alias("n"))),
    "multiseq_pivot": by_language,
    "dist_sqeuclid": _reads(distance_of("squared_euclidean")),
    "dist_kld2": _reads(distance_of("kld_log2")),
    "dist_kldn": _reads(distance_of("kld_ln")),
    "dist_sqeuclid_norm": _reads(distance_of("squared_euclidean", True)),
    "dist_mean_square": _reads(distance_of("mean_square")),
    "dist_tiled": _reads(distance_of("squared_euclidean", most_tags=0, tile=8)),
    "dist_tiled_kld2": _reads(distance_of("kld_log2", most_tags=0, tile=6)),
    "dist_file": distance_file,
    "fasta_reads": fasta_reads,
    "fasta_counts": lambda spark, sf_dir: km.count_kmers(read_fasta(spark, fasta_of(spark, sf_dir)), K),
    "long_fasta_counts": long_fasta_counts,
    "long_signature_histogram": long_histogram,
    "long_fasta_ranges": ranged_counts(70),
    "long_fasta_one_line": ranged_counts(1 << 30),
    "range_signature_histogram": ranged_histogram,
    "fastq_counts": fastq_counts(0),
    "fastq_counts_masked": fastq_counts(4),
    "count_files_text": counted_files(False),
    "count_files_sorted": counted_files(False, use_hash=False, tasks=5),
    "count_files_binary": counted_files(True),
    "count_files_balanced": counted_files(False, balance=True, tasks=SLOTS),
    "count_compute_only": compute_only,
    "count_command_line": counted_by_command_line,
    "streamed_counts": streamed_counts,
    "streamed_bin_counts": streamed_bin_counts,
    "totals_file": totals_file,
    "signature_file": signature_file,
    "balance_file": balance_file,
    "output_names": output_names,
    "counts_in_bins": _reads(lambda r: bc.counts_in_bins(r, K, M, BINS)),
    "counts_in_split_bins_k28": _reads(split_bin_counts),
    "packed_counts": _reads(lambda r: km.count_packed(r, K)),
    "packed_counts_k28": _reads(lambda r: km.count_packed(r, 28)),
    "packed_counts_k40": _reads(lambda r: km.count_packed(r, 40)),
    "kmer_words_k40": _reads(long_kmer_words),
    "kmer_signatures_k28_m10": _reads(lambda r: mz.signatures_of_kmers(km.count_packed(r, 28), 28, 10)),
    "sql_kmers": sql_kmers,
    "sql_table_kmers": sql_table_kmers,
    "top_kmers": _reads(lambda r: b.top_kmers(bc.counts_in_bins(r, K, M, BINS), 5)),
    "merged_counts": lambda spark, sf_dir: merged_counts(spark, bucketed_halves(spark, sf_dir)),
    "compared_bins": lambda spark, sf_dir: compared_bins(spark, bucketed_halves(spark, sf_dir), "half_0", "half_1"),
    "bin_sizes_by_ranges": ranged_sizes,
    "long_command_line": long_by_command_line,
    "dist_command_line": distance_by_command_line,
}

# ---- the same in SQL --------------------------------------------------------------------------

_RC = "reverse(translate({0},'ACGT','TGCA'))"


def _reads_sql(tag: str = "source") -> str:
    return f"reads AS (SELECT doc_id AS read_id, {tag} AS seq_tag, regexp_replace(translate(replace(text, chr(10), ''), '{LETTERS}', '{LETTER_BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM documents)"


def _kmers_sql(k: int = K, tag: str = "source", where: str = "true") -> str:
    return f"""{_reads_sql(tag)},
w AS (SELECT read_id, seq_tag, i, substring(seq, i + 1, {k}) AS f FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS i FROM reads WHERE length(seq) >= {k} AND {where})),
k AS (SELECT *, least(f, {_RC.format("f")}) AS kmer FROM w WHERE NOT contains(f, 'N'))"""


def _allowed(c: str) -> str:
    return f"NOT (contains({c}, 'AA') OR starts_with({c}, 'ACA'))"


def _norm(c: str) -> str:
    r = _RC.format(c)
    return f"least(CASE WHEN {_allowed(c)} THEN {c} ELSE '~' END, CASE WHEN {_allowed(r)} THEN {r} ELSE '~' END)"


def _number(c: str, n: int) -> str:
    digit = lambda j: f"(strpos('ACGT', substring({c}, {j + 1}, 1)) - 1)"
    return "CAST(" + " + ".join(f"{digit(j)} * {4 ** (n - 1 - j)}" for j in range(n)) + " AS BIGINT)"


def _bin(s: str) -> str:
    """Nested sub-expressions of the 32-bit mix."""
    v = f"xor(xor({s}, 61), {s} >> 16)"
    v = f"(({v}) * 9) & 4294967295"
    v = f"list_transform([{v}], lambda a: xor(a, a >> 4))[1]"
    v = f"(({v}) * 668265261) & 4294967295"
    v = f"list_transform([{v}], lambda c: xor(c, c >> 15))[1]"
    return f"CAST((({v}) & 2147483647) % {BINS} AS INTEGER)"


def _supers_sql(where: str = "true") -> str:
    return f"""{_kmers_sql(where=where)},
mm AS (SELECT read_id, seq_tag, i, i + j AS p, substring(f, j + 1, {M}) AS q FROM (SELECT *, unnest(range(0, {K - M + 1})) AS j FROM k)),
s AS (SELECT read_id, seq_tag, i, min({{'v': {_norm("q")}, 'p': p}}) AS s FROM mm GROUP BY ALL),
u AS (SELECT read_id, seq_tag, s.p AS sig_pos, s.v AS sig, min(i) AS start, count(*) AS n_kmers FROM s GROUP BY ALL),
ub AS (SELECT u.*, {_bin("nr")} AS bin FROM (SELECT *, CASE WHEN sig = '~' THEN {4**M} ELSE {_number("sig", M)} END AS nr FROM u) u)"""


_COUNTS = f"WITH {_kmers_sql()} SELECT kmer, count(*) AS n FROM k GROUP BY kmer"
_SIZES = "SELECT bin, count(*) AS n_super, CAST(sum(n_kmers) AS BIGINT) AS n_kmers FROM ub GROUP BY bin"
_LPT = f""",
sz AS MATERIALIZED ({_SIZES}),
o AS MATERIALIZED (SELECT bin, n_kmers, n_super, row_number() OVER (ORDER BY n_kmers DESC, bin) AS r FROM sz),
l AS (
  SELECT CAST(0 AS BIGINT) AS r, [CAST(0 AS BIGINT) FOR x IN range({SLOTS})] AS loads, -1 AS bin, CAST(0 AS BIGINT) AS slot
  UNION ALL
  SELECT o.r, list_transform(l.loads, lambda v, i: CASE WHEN i = list_position(l.loads, list_min(l.loads)) THEN v + o.n_kmers ELSE v END), o.bin, list_position(l.loads, list_min(l.loads)) - 1
  FROM l JOIN o ON o.r = l.r + 1)"""
_TAGGED = f"{_kmers_sql()}, c AS (SELECT seq_tag, kmer, count(*) AS n FROM k GROUP BY ALL)"


def _distance_sql(term: str, symmetric: bool, digits: int = 4, values: str = "SELECT seq_tag, kmer, CAST(n AS DOUBLE) AS n FROM c", fold: str = "{0}") -> str:
    """Every pair of sequences with all k-mers that either of them has."""
    compare = "<" if symmetric else "<>"
    return f"""WITH {_TAGGED},
v AS ({values}),
t AS (SELECT DISTINCT seq_tag FROM v),
g AS (SELECT a.seq_tag AS s1, b.seq_tag AS s2 FROM t a JOIN t b ON a.seq_tag {compare} b.seq_tag),
e AS (
  SELECT s1, s2, kmer, n AS p, CAST(0 AS DOUBLE) AS q FROM g JOIN v ON v.seq_tag = g.s1
  UNION ALL SELECT s1, s2, kmer, 0, n FROM g JOIN v ON v.seq_tag = g.s2),
f AS (SELECT s1, s2, kmer, sum(p) AS p, sum(q) AS q FROM e GROUP BY ALL)
SELECT s1, s2, round({fold.format(f"sum({term})")}, {digits}) AS distance FROM f GROUP BY ALL"""


_NORMALIZED = f"SELECT seq_tag, kmer, CASE WHEN len - {K} + 1 > 0 THEN n / CAST(len - {K} + 1 AS DOUBLE) ELSE 0 END AS n FROM c JOIN (SELECT seq_tag, sum(length(seq)) AS len FROM reads GROUP BY ALL) USING (seq_tag)"
_KX = f"""{_supers_sql()},
m AS (SELECT s.read_id, s.s.p AS sig_pos, s.i, k.f, CASE WHEN k.f < {_RC.format("k.f")} THEN 0 ELSE 1 END AS o FROM s JOIN k USING (read_id, i)),
c AS (SELECT *, CASE WHEN o = lag(o) OVER w THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY read_id, sig_pos ORDER BY i)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, sig_pos ORDER BY i) AS run FROM c),
z AS (SELECT *, (row_number() OVER (PARTITION BY read_id, sig_pos, run ORDER BY i) - 1) // {X + 1} AS part FROM r),
kx AS (SELECT read_id, min(i) AS start, count(*) - 1 AS x, o AS orientation FROM z GROUP BY read_id, sig_pos, run, part, o)"""

_BINNED = f"WITH {_supers_sql()}, b AS (SELECT DISTINCT kmer, bin FROM s JOIN k USING (read_id, i) JOIN ub ON ub.read_id = s.read_id AND ub.sig_pos = s.s.p) SELECT bin, kmer, n FROM (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) JOIN b USING (kmer)"

ORACLES: dict[str, str] = {
    "canonical_kmer_counts": _COUNTS,
    "canonical_kmer_counts_k28": f"WITH {_kmers_sql(28)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    "forward_kmer_counts": f"WITH {_kmers_sql()} SELECT f AS kmer, count(*) AS n FROM k GROUP BY f",
    "sort_path_counts": _BINNED,
    "window_invalid_bounds": f"WITH {_kmers_sql()} SELECT read_id, CAST(i AS INTEGER) AS i, CAST(strpos(f, 'N') - 1 AS INTEGER) AS first_bad, CAST({K} - strpos(reverse(f), 'N') AS INTEGER) AS last_bad FROM w WHERE contains(f, 'N')",
    "valid_segments": f"""WITH {_reads_sql()}, c AS (SELECT read_id, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM reads WHERE length(seq) >= {K}),
g AS (SELECT read_id, i, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS run FROM c WHERE ch <> 'N')
SELECT read_id, CAST(min(i) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS len FROM g GROUP BY read_id, run HAVING count(*) >= {K}""",
    "kmer_orientation": f"WITH {_kmers_sql()} SELECT CASE WHEN f < {_RC.format('f')} THEN 0 ELSE 1 END AS orientation, count(*) AS n FROM k GROUP BY 1",
    "kmer_packed": f"WITH {_kmers_sql()}, c AS (SELECT DISTINCT kmer FROM k) SELECT kmer, {_number('kmer', K)} AS packed, kmer AS unpacked, left(kmer, {M}) AS first_m, right(kmer, {M}) AS last_m, substring(kmer, 6, 1) AS base_5, {_RC.format('kmer')} AS rc, {_norm(f'right(kmer, {M})')} AS last_norm FROM c",
    "bit_helpers": f"WITH {_reads_sql()} SELECT read_id, (CAST(1 AS BIGINT) << CAST(read_id % 40 AS INTEGER)) - 1 AS mask, (7 - read_id % 7) % 7 AS slot, CAST(" + " + ".join(f"CASE WHEN substring(seq, {i + 1}, 1) IN ('G', 'T') THEN {2**i} ELSE 0 END" for i in range(8)) + f" AS BIGINT) AS bits, {_bin('read_id')} AS bin FROM reads",
    "norm_table": f"WITH {_kmers_sql(M)}, c AS (SELECT f AS mmer, count(*) AS n FROM k GROUP BY f), n AS (SELECT mmer, n, {_norm('mmer')} AS norm FROM c) SELECT mmer, n, norm, CASE WHEN norm = '~' THEN {4**M} ELSE {_number('norm', M)} END AS norm_number, {_allowed('mmer')} AS allowed FROM n",
    "kmer_signatures": f"WITH {_supers_sql()} SELECT read_id, i, s.v AS sig, s.p AS sig_pos FROM s",
    "kmer_signature_values": f"WITH {_kmers_sql()}, c AS (SELECT DISTINCT kmer FROM k), m AS (SELECT kmer, j, substring(kmer, j + 1, {M}) AS q FROM (SELECT kmer, unnest(range(0, {K - M + 1})) AS j FROM c)), s AS (SELECT kmer, min({{'v': {_norm('q')}, 'p': j}}) AS s FROM m GROUP BY kmer) SELECT kmer, s.v AS sig, CAST(s.p AS INTEGER) AS sig_pos FROM s",
    "super_kmers": f"WITH {_supers_sql()} SELECT u.read_id, start, sig, sig_pos, substring(seq, start + 1, n_kmers + {K - 1}) AS super_kmer, n_kmers FROM u JOIN reads USING (read_id)",
    "super_kmer_bins": f"WITH {_supers_sql()} SELECT seq_tag, bin, count(*) AS n_super, CAST(sum(n_kmers) AS BIGINT) AS n_kmers FROM ub GROUP BY ALL",
    "bin_sizes": f"WITH {_supers_sql()} {_SIZES}",
    "bin_sizes_sampled": f"WITH {_supers_sql(f'read_id % {SAMPLE} = 0')} {_SIZES}",
    "bin_signature_histogram": f"WITH {_supers_sql()} SELECT bin, sig, count(*) AS n FROM ub GROUP BY GROUPING SETS ((bin, sig), (bin))",
    "bin_totals": f"WITH {_supers_sql()} SELECT bin, count(*) AS n_super, count(DISTINCT sig) AS n_sigs FROM ub GROUP BY bin",
    "kx_mers": f"WITH {_KX} SELECT kx.read_id, start, x, orientation, CASE WHEN orientation = 0 THEN substring(seq, start + 1, x + {K}) ELSE {_RC.format(f'substring(seq, start + 1, x + {K})')} END AS kxmer FROM kx JOIN reads USING (read_id)",
    "counts_via_kxmers": _COUNTS,
    "counts_via_superkmers": _COUNTS,
    "chunked_counts": _COUNTS,
    "lpt_assignment": f"WITH RECURSIVE {_supers_sql()}{_LPT} SELECT bin, CAST(slot AS INTEGER) AS slot FROM l WHERE r > 0",
    "partition_balance": f"WITH RECURSIVE {_supers_sql()}{_LPT} SELECT CAST(slot AS INTEGER) AS slot, count(*) AS n_bins, CAST(sum(n_super) AS BIGINT) AS n_super FROM l JOIN sz USING (bin) WHERE r > 0 GROUP BY slot",
    "dealt_counts": f"WITH RECURSIVE {_supers_sql()}{_LPT}, b AS (SELECT DISTINCT kmer, bin FROM s JOIN k USING (read_id, i) JOIN ub ON ub.read_id = s.read_id AND ub.sig_pos = s.s.p) SELECT CAST(slot AS INTEGER) AS slot, count(*) AS n_kmers, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kmer, count(*) AS n FROM k GROUP BY kmer) JOIN b USING (kmer) JOIN l USING (bin) WHERE r > 0 GROUP BY slot",
    "header_tags": "SELECT regexp_extract(source || '.' || doc_id, '^(\\w+)', 1) AS seq_tag, count(*) AS n FROM documents GROUP BY 1",
    "multiseq_counts": f"WITH {_TAGGED} SELECT seq_tag, kmer, n FROM c",
    "multiseq_totals": _COUNTS,
    "multiseq_pivot": f"WITH {_kmers_sql(tag='lang')} SELECT kmer, " + ", ".join(f"count(*) FILTER (WHERE seq_tag = '{c}') AS n_{c}" for c in LANGUAGES) + ", count(*) FILTER (WHERE seq_tag IS NULL OR seq_tag NOT IN (" + ", ".join(f"'{c}'" for c in LANGUAGES) + ")) AS n_other FROM k GROUP BY kmer",
    "dist_sqeuclid": _distance_sql("(p - q) * (p - q)", True),
    "dist_kld2": _distance_sql("CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END", False),
    "dist_kldn": _distance_sql("CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END", False),
    "dist_sqeuclid_norm": _distance_sql("(p - q) * (p - q)", True, 12, _NORMALIZED),
    "dist_mean_square": _distance_sql("(p - q) * (p - q)", True, fold="{0} / count(*)"),
    "dist_tiled": _distance_sql("(p - q) * (p - q)", True),
    "dist_tiled_kld2": _distance_sql("CASE WHEN p > 0 AND q > 0 THEN p * log2(p / q) ELSE 0 END", False),
    "dist_file": _distance_sql("(p - q) * (p - q)", True),
    "fasta_reads": f"WITH {_reads_sql()} SELECT seq_tag, count(*) AS n, CAST(sum(length(coalesce(seq, ''))) AS BIGINT) AS chars, count(DISTINCT read_id) AS ids FROM reads GROUP BY seq_tag",
    "fasta_counts": _COUNTS,
    "long_fasta_counts": _COUNTS,
    "long_signature_histogram": f"WITH {_supers_sql()} SELECT bin, sig, count(*) AS n FROM ub GROUP BY bin, sig",
    "long_fasta_ranges": _COUNTS,
    "long_fasta_one_line": _COUNTS,
    "range_signature_histogram": f"WITH {_supers_sql()} SELECT bin, sig, count(*) AS n FROM ub GROUP BY bin, sig",
    "fastq_counts": _COUNTS,
    "fastq_counts_masked": f"""WITH {_reads_sql()},
m AS (SELECT read_id, array_to_string(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN ((i - 1) * 7 + read_id) % 41 < 4 THEN 'N' ELSE c END), '') AS seq FROM reads WHERE length(seq) > 0),
w AS (SELECT substring(seq, i + 1, {K}) AS f FROM (SELECT seq, unnest(range(0, length(seq) - {K} + 1)) AS i FROM m WHERE length(seq) >= {K}))
SELECT least(f, {_RC.format("f")}) AS kmer, count(*) AS n FROM w WHERE NOT contains(f, 'N') GROUP BY 1""",
    "count_files_text": _BINNED,
    "count_files_sorted": _BINNED,
    "count_files_binary": _BINNED,
    "count_files_balanced": _BINNED,
    "count_command_line": _BINNED,
    "streamed_counts": _COUNTS,
    "streamed_bin_counts": _BINNED,
    "count_compute_only": f"SELECT bin, count(*) AS n_kmers, CAST(sum(n) AS BIGINT) AS n, max(n) AS most, max(kmer) AS last FROM ({_BINNED}) GROUP BY bin",
    "totals_file": _COUNTS,
    "signature_file": f"WITH {_supers_sql()} SELECT bin, coalesce(sig, 'Total') AS sig, count(*) AS n FROM ub GROUP BY GROUPING SETS ((bin, sig), (bin))",
    "balance_file": f"WITH {_supers_sql()} SELECT bin, count(*) AS n, CAST(1 AS BIGINT) AS n_tasks, true AS total_agrees FROM ub GROUP BY bin",
    "output_names": "SELECT m, x, max_bins, kind, '/out/p_k28_m' || m || '_x' || x || '_b' || least(CAST(4 ** m AS INTEGER), max_bins) || '_s' || kind AS folder FROM (SELECT DISTINCT CAST(l_linenumber + 3 AS INTEGER) AS m, CAST(l_partkey % 5 AS INTEGER) AS x, CAST(10 * (l_suppkey % 300) + 1 AS INTEGER) AS max_bins, CAST(l_orderkey % 2 AS INTEGER) AS kind FROM lineitem)",
    "counts_in_bins": _BINNED,
    "counts_in_split_bins_k28": f"WITH {_kmers_sql(28)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    "packed_counts": _COUNTS,
    "packed_counts_k28": f"WITH {_kmers_sql(28)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    "packed_counts_k40": f"WITH {_kmers_sql(40)} SELECT kmer, count(*) AS n FROM k GROUP BY kmer",
    "kmer_words_k40": f"WITH {_kmers_sql(40)} SELECT kmer, count(*) AS n, {_number('left(kmer, 31)', 31)} AS word_0, {_number('right(kmer, 9)', 9)} AS word_1 FROM k GROUP BY kmer",
    "kmer_signatures_k28_m10": f"WITH {_kmers_sql(28)}, c AS (SELECT DISTINCT kmer FROM k), m AS (SELECT kmer, j, substring(kmer, j + 1, 10) AS q FROM (SELECT kmer, unnest(range(0, 19)) AS j FROM c)), s AS (SELECT kmer, min({{'v': {_norm('q')}, 'p': j}}) AS s FROM m GROUP BY kmer) SELECT kmer, s.v AS sig, CAST(s.p AS INTEGER) AS sig_pos FROM s",
    "sql_kmers": _COUNTS,
    "sql_table_kmers": _COUNTS,
    "top_kmers": f"SELECT bin, CAST(rank AS INTEGER) AS rank, kmer, n FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, kmer) AS rank FROM ({_BINNED})) WHERE rank <= 5",
    "merged_counts": _BINNED,
    "compared_bins": f"""WITH {_supers_sql()}, b AS (SELECT DISTINCT kmer, bin FROM s JOIN k USING (read_id, i) JOIN ub ON ub.read_id = s.read_id AND ub.sig_pos = s.s.p),
h AS (SELECT kmer, count(*) FILTER (WHERE read_id % 2 = 0) AS x, count(*) FILTER (WHERE read_id % 2 <> 0) AS y FROM k GROUP BY kmer)
SELECT bin, CAST(sum(x) AS BIGINT) AS n_one, CAST(sum(y) AS BIGINT) AS n_other, CAST(sum(least(x, y)) AS BIGINT) AS n_both, count(*) FILTER (WHERE x > 0 AND y > 0) AS kmers_both FROM h JOIN b USING (kmer) GROUP BY bin""",
    "bin_sizes_by_ranges": f"WITH {_supers_sql()} SELECT bin, CAST(sum(n_kmers) AS BIGINT) AS n_kmers, CAST(0 AS DOUBLE) AS error FROM ub GROUP BY bin",
    "long_command_line": _BINNED,
    "dist_command_line": _distance_sql("CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END", False),
}
