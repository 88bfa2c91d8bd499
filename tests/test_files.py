"""Readers, writers, jobs, command line and stream."""

from __future__ import annotations

import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from strandline import runtime
from strandline.cli import config_of, main, parser
from strandline.config import CounterConfig, n_bins
from strandline.operators import kmers as km
from strandline.operators.bins import sampled, super_kmer_counts
from strandline.sources import sinks
from strandline.sources.reads import read_fasta, read_long_fasta, tag_of
from strandline.streaming.counts import STATE, latest_counts, merged_batches, start_batch_counts, start_counts, stream_reads
from tests import brute
from tests.test_kmers import as_dict, noisy


def wrapped(seq: str, width: int, end: str = "\n") -> str:
    return end.join(seq[i : i + width] for i in range(0, len(seq), width))


@pytest.fixture
def seqs():
    return [noisy(s, n) for s, n in ((21, 350), (22, 90), (23, 5))]


def test_fasta_of_short_reads(spark, tmp_path, seqs):
    text = "".join(f">SRR{i}.1 a > b length={len(s)}\n{wrapped(s, 60)}\n" for i, s in enumerate(seqs))
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa").write_text(">X.1\r\n" + wrapped(seqs[0], 50, "\r\n") + "\r\n>empty\n")
    reads = read_fasta(spark, str(tmp_path))
    assert {(r["seq_tag"], r["seq"]) for r in reads.collect()} == {("SRR0", seqs[0]), ("SRR1", seqs[1]), ("SRR2", seqs[2]), ("X", seqs[0]), ("empty", "")}
    assert as_dict(km.count_kmers(reads, 11)) == brute.counts([*seqs, seqs[0]], 11)
    assert reads.select("read_id").distinct().count() == 5


def test_fasta_of_long_sequences(spark, tmp_path, seqs):
    r = random.Random(3)
    long = {"chr1 x": "".join(r.choice("ACGTN") for _ in range(5000)), "chr2": seqs[0], "chr3": "ACG"}
    (tmp_path / "l.fa").write_text("".join(f">{h}\n{wrapped(s, 61)}\n" for h, s in long.items()))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits of one file
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        chunks = read_long_fasta(spark, str(tmp_path), 9, chunk=200)
        assert chunks.select("chunk_start").distinct().count() >= 25
        for row in chunks.collect():
            assert row["seq"] == long[row["header"]][row["chunk_start"] : row["chunk_start"] + 208]
        assert as_dict(km.count_kmers(chunks, 9)) == brute.counts(long.values(), 9)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_sequences_with_the_same_header(spark, tmp_path):
    a, b = "ACGTTGCAGGATTC", "TTTTCCCCGAGAGA"
    (tmp_path / "l.fa").write_text(f">chr1\n{a[:8]}\n{a[8:]}\n>chr1\n{b[:8]}\n{b[8:]}\n>chr2\n>chr1\n{a}\n")
    chunks = read_long_fasta(spark, str(tmp_path), 5, chunk=50).collect()
    assert sorted(r["seq"] for r in chunks) == sorted([a, b, a]) and len({r["read_id"] for r in chunks}) == 3


def test_super_kmers_over_borders_of_chunks_count_once(spark, tmp_path, seqs):
    long = [seqs[0] * 5, seqs[1] + "N" + seqs[0], "ACGTACGTAC"]
    (tmp_path / "l.fa").write_text("".join(f">c\n{wrapped(s, 50)}\n" for s in long))
    want: dict = {}
    for s in long:
        for _, n, sig, _ in brute.super_kmers(s, 9, 4):
            have = want.get(sig, (0, 0))
            want[sig] = (have[0] + 1, have[1] + n)
    for chunk in (9, 31, 100):
        got = super_kmer_counts(read_long_fasta(spark, str(tmp_path), 9, chunk=chunk), 9, 4, 64).collect()
        number = lambda sig: 4**4 if sig == "~" else brute.number(sig)
        assert {number(r["sig"]): (r["n"], r["n_kmers"]) for r in got} == want
    assert 0 < sampled(read_long_fasta(spark, str(tmp_path), 9, chunk=9), 5).count() < 100


def test_tags(spark):
    rows = spark.createDataFrame([("SRR197985.1 HWUSI",), ("",), (".x",), (None,)], "h string").select(tag_of(F.col("h"))).collect()
    assert [r[0] for r in rows] == ["SRR197985", "", "", None]


def test_count_files(spark, tmp_path):
    counts = spark.createDataFrame([(0, "AC", 2), (0, "AA", 1), (3, "GT", 5)], "bin int, kmer string, n long")
    sinks.write_counts(counts, f"{tmp_path}/text")
    lines = [line for f in sorted((tmp_path / "text/bin=0").glob("part*")) for line in f.read_text().splitlines()]
    assert lines == ["AA\t1", "AC\t2"]
    sinks.write_counts(counts, f"{tmp_path}/packed", binary=True)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/packed").select("bin", "kmer", "n").collect()} == {(0, "AC", 2), (0, "AA", 1), (3, "GT", 5)}
    sinks.write_signatures(spark.createDataFrame([(1, "ACG", 2), (1, None, 2)], "bin int, sig string, n long"), f"{tmp_path}/sig")
    assert [line for f in (tmp_path / "sig/bin=1").glob("part*") for line in f.read_text().splitlines()] == ["ACG\t2", "Total\t2"]
    sinks.write_balance(spark.createDataFrame([(0, 5, 9), (0, 2, 3)], "slot int, bin int, n long"), f"{tmp_path}/bal")
    assert [line for f in (tmp_path / "bal/slot=0").glob("part*") for line in f.read_text().splitlines()] == ["2,3", "5,9", "Total,12"]


def test_config():
    assert n_bins(3, 2048) == 64 and n_bins(10, 2048) == 2048
    assert CounterConfig(k=28, m=10, x=3, output_path="/out/", prefix="p_").output_dir() == "/out/p_k28_m10_x3_b2048_s0"
    assert CounterConfig(k=28, m=10).output_dir(debug=True, root="/shared") == "/shared/k28_m10_x3_b2048"
    for bad in ({"m": 0}, {"m": 16}, {"k": 3, "m": 4}, {"x": -1}, {"max_bins": 0}):
        with pytest.raises(ValueError):
            CounterConfig(**bad)
    c = config_of(parser().parse_args(["count", "28", "10", "3", "2048", "0", "0", "in", "out/", "p", "1", "0", "1", "7"]))
    assert (c.use_hash, c.balance, c.tasks, c.prefix) == (False, True, 7, "p")


@pytest.mark.parametrize("options", [("0", "0"), ("1", "1")])
def test_jobs_by_command_line(spark, tmp_path, seqs, options):
    (tmp_path / "in.fa").write_text("".join(f">t{i}.1\n{s}\n" for i, s in enumerate(seqs)))
    use_hash, balance = options
    main(["count", "7", "3", "2", "20", use_hash, "0", f"{tmp_path}/in.fa", f"{tmp_path}/out/", "p_", "1", "0", balance, "3"])
    out = f"{tmp_path}/out/p_k7_m3_x2_b20_s0"
    rows = spark.read.option("sep", "\t").schema("kmer string, n long, bin int").csv(out)
    assert max(len(list(b.glob("part*.csv"))) for b in Path(out).glob("bin=*")) == 1  # each bin is the work of one task
    assert as_dict(rows) == brute.counts(seqs, 7)
    main(["signatures", "7", "3", "2", "20", "1", "0", f"{tmp_path}/in.fa", f"{tmp_path}/sig/"])
    assert spark.read.text(f"{tmp_path}/sig/k7_m3_x2_b20_s0").where("value like 'Total%'").count() > 0
    main(["balance", "7", "3", "2", "20", "1", "0", f"{tmp_path}/in.fa", f"{tmp_path}/bal/", "", "1", "0", "0", "3"])
    lines = spark.read.schema("bin string, n long, slot int").csv(f"{tmp_path}/bal/k7_m3_x2_b20_s0")
    assert lines.where("bin = 'Total'").agg(F.sum("n")).first()[0] == sum(len(brute.super_kmers(s, 7, 3)) for s in seqs)
    main(["totals", "7", "3", "2", "20", "1", "0", f"{tmp_path}/in.fa", f"{tmp_path}/tot/"])
    assert as_dict(spark.read.option("sep", "\t").schema("kmer string, n long").csv(f"{tmp_path}/tot/k7_m3_x2_b20_s0")) == brute.counts(seqs, 7)
    main(["distance", "7", "3", "2", "20", "1", "0", f"{tmp_path}/in.fa", f"{tmp_path}/dist/", "--measure", "kld_ln"])
    assert spark.read.text(f"{tmp_path}/dist/k7_m3_x2_b20_s0").count() == 2  # the third read is shorter than k


def test_stream_matches_batch(spark, tmp_path, seqs):
    frame = lambda *s: spark.createDataFrame([(i, "t", x) for i, x in enumerate(s)], "read_id long, seq_tag string, seq string")
    frame(seqs[0]).write.parquet(f"{tmp_path}/in/a")
    query = start_counts(stream_reads(spark, f"{tmp_path}/in/*"), 6, f"{tmp_path}/so_far", f"{tmp_path}/checkpoint")
    try:
        query.processAllAvailable()
        assert as_dict(latest_counts(spark, f"{tmp_path}/so_far")) == brute.counts(seqs[:1], 6)
        frame(*seqs[1:]).write.parquet(f"{tmp_path}/in/b")
        query.processAllAvailable()
        assert as_dict(latest_counts(spark, f"{tmp_path}/so_far")) == brute.counts(seqs, 6)
    finally:
        query.stop()


def test_streams_go_on_where_they_ended(spark, tmp_path, seqs):
    """Both ways are stopped between batches and go on from their checkpoint; a batch that is written again changes nothing."""
    frame = lambda i, x: spark.createDataFrame([(i, "t", x)], "read_id long, seq_tag string, seq string").coalesce(1)
    key = next(iter(STATE))
    before = spark.conf.get(key, None)
    for upto in range(1, len(seqs) + 1):
        frame(upto, seqs[upto - 1]).write.parquet(f"{tmp_path}/in/{upto}")
        reads = stream_reads(spark, f"{tmp_path}/in/*", most_files=1)
        start_counts(reads, 6, f"{tmp_path}/so_far", f"{tmp_path}/c1", available_now=True).awaitTermination()
        start_batch_counts(reads, 6, 3, 20, f"{tmp_path}/bins", f"{tmp_path}/c2", available_now=True).awaitTermination()
        want = brute.counts(seqs[:upto], 6)
        assert as_dict(latest_counts(spark, f"{tmp_path}/so_far")) == want
        merged = merged_batches(spark, f"{tmp_path}/bins")
        assert as_dict(merged.select("kmer", "n")) == want
    assert spark.conf.get(key, None) == before  # the session's own settings are as they were
    some = [r["bin"] for r in merged.select("bin").distinct().limit(2).collect()]
    assert sorted(map(tuple, merged_batches(spark, f"{tmp_path}/bins", some).collect())) == sorted(map(tuple, merged.where(merged["bin"].isin(some)).collect()))
    assert any(p.name.endswith(".zip") or p.name.endswith(".changelog") for p in (tmp_path / "c1" / "state").rglob("*"))  # RocksDB keeps it


def test_a_cluster_must_name_a_shared_folder(spark):
    context = SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=dict)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError):
        runtime.shared_root(session)
    context.getConf = lambda: {"spark.checkpoint.dir": "hdfs://shared/"}
    assert runtime.shared_root(session) == "hdfs://shared"


def test_only_small_tables_are_spread(spark, monkeypatch, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert runtime.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(runtime, "SPREAD_BYTES", 10)
    assert runtime.spread(table) is table
