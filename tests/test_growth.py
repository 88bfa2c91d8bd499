"""What must not grow faster than the input: rows sent, work by place in a text, copies of vectors."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline import runtime
from strandline.config import CounterConfig
from strandline.functions import minimizer
from strandline.llm import embedding_dups as ed
from strandline.operators import bin_counting as bc
from strandline.operators import bins as b
from strandline.operators import kmers as km
from strandline.operators import minimizers as mz
from strandline.plans import jobs
from strandline.plans import queries as q
from strandline.sources.reads import chunk_reads
from strandline.sources.sinks import read_counts
from strandline.sources.tables import register_functions

SF = "/root/testdata/sf0.001"


def reads_of(spark, n: int, length: int):
    r = random.Random(5)
    return spark.createDataFrame([(i, "t", "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=length))) for i in range(n)], "read_id bigint, seq_tag string, seq string")


def test_f1_groups_are_as_large_as_a_task_takes_and_guests_bring_the_bits_of_one_group():
    rng = np.random.default_rng(1)
    made = ed.Quantiser(rng.normal(size=(2_000, 64)), 1_000, 0.9)
    group_of = made.groups({c: 600 for c in range(1_000)})  # 600,000 vectors
    assert group_of.max() + 1 <= 24
    layout, near = ed.ListBits(group_of), rng.random((5, 1_000)) < 0.2
    packed = layout.packed(near)
    for g in range(group_of.max() + 1):
        bits = np.stack([np.frombuffer(layout.of(row, g), dtype=np.uint8) for row in packed])
        assert bits.shape[1] <= -(-(group_of == g).sum() // 8)
        for c in np.flatnonzero(group_of == g).tolist():
            assert (ed.has_bit(bits, np.arange(5), int(layout.place[c])) == near[:, c]).all()


def test_f7_f14_super_kmers_are_added_up_before_they_are_sent(spark):
    reads = reads_of(spark, 40, 3_000).coalesce(1)
    sent = mz.counted_super_kmers(chunk_reads(reads, 11, 500), 11, 4)
    supers = mz.super_kmers(reads, 11, 4, 256)
    assert sent.count() < supers.count() / 5
    want = {tuple(r) for r in supers.groupBy("bin", "sig").agg(F.count("*"), F.sum("n_kmers")).collect()}
    for some in (reads, chunk_reads(reads, 11, 500), chunk_reads(reads, 11, 20)):
        assert {tuple(r) for r in b.super_kmer_counts(some, 11, 4, 256).collect()} == want


def test_f2_signatures_of_kmers_run_many_at_once(spark):
    kmers = km.count_kmers(reads_of(spark, 20, 200), 12).select("kmer").union(spark.createDataFrame([("A" * 12,), ("T" * 12,)], "kmer string"))
    for m in (1, 2, 4, 10):
        want = kmers.select("kmer", minimizer.signature(F.col("kmer"), 12, m).alias("s")).select("kmer", "s.v", "s.p")
        assert sorted(map(tuple, mz.signatures_of_kmers(kmers, 12, m).collect())) == sorted(map(tuple, want.collect()))
    assert "MapInArrow" in entry.queries()["kmer_signatures_k28_m10"](spark, SF)._jdf.queryExecution().toString()


def test_f3_compute_only_says_what_each_bin_has(spark):
    got = {r["bin"]: (r["n_kmers"], r["n"], r["most"], r["last"]) for r in q.compute_only(spark, SF).collect()}
    counted = b.binned_counts(q.counts(spark, SF), q.K, q.M, q.BINS).groupBy("bin").agg(F.count("*"), F.sum("n"), F.max("n"), F.max("kmer"))
    assert len(got) > 1 and got == {r[0]: tuple(r[1:]) for r in counted.collect()}


def test_f8_f12_functions_for_sql_take_places_from_bytes_and_run_no_python(spark):
    register_functions(spark)
    reads = reads_of(spark, 10, 300).union(spark.createDataFrame([(99, "t", None), (98, "t", "ACG")], "read_id bigint, seq_tag string, seq string"))
    want = sorted(map(tuple, km.count_kmers(reads, 11).collect()))
    for text in ("FROM {reads}, LATERAL kmers_of(seq, 11)", "FROM {reads}, LATERAL kmers_of_long(seq, 11)", "FROM (SELECT explode(all) AS kmer FROM (SELECT kmers(seq, 11) AS all FROM {reads}))"):
        assert sorted(map(tuple, spark.sql(f"SELECT kmer, count(*) AS n {text} GROUP BY kmer", reads=reads).collect())) == want
    plan = spark.sql("SELECT kmer FROM {reads}, LATERAL kmers_of(seq, 11)", reads=reads)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "as binary" in plan


def test_f21_bounds_of_windows_come_from_the_read(spark):
    reads = reads_of(spark, 8, 150)
    want = {(r["read_id"], i, s.find("N"), s.rfind("N")) for r in reads.collect() for i in range(150 - q.K + 1) if "N" in (s := r["seq"][i : i + q.K])}
    assert {tuple(r) for r in q.window_invalid_bounds(reads).collect()} == want
    assert {(r["read_id"], r["chunk_start"] + r["i"], r["first_bad"], r["last_bad"]) for r in km.invalid_bounds(chunk_reads(reads, q.K, 20), q.K).collect()} == want


def test_f11_more_tasks_than_asked_for_where_these_are_too_few(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{''.join(r.choices('ACGT', k=2_000))}\n" for i in range(20)))
    config = CounterConfig(k=11, m=4, max_bins=64, use_hash=False, tasks=2, input_path=str(tmp_path / "a.fa"), output_path=f"{tmp_path}/out/")
    for size in (1 << 30, 1_000):
        monkeypatch.setattr(jobs, "BYTES_OF_TASK", size)
        made, _, split = jobs.made_counts(spark, config)
        assert split == (size == 1_000) and (made.rdd.getNumPartitions() == 2) == (size == 1 << 30)
        jobs.count_job(spark, config)
        want = b.binned_counts(km.count_kmers(jobs.open_reads(spark, config), 11), 11, 4, 64).collect()
        assert sorted(map(tuple, read_counts(spark, config.output_dir()).collect())) == sorted(map(tuple, want))


def test_f20_a_task_counts_a_bounded_share(spark, tmp_path, monkeypatch):
    reads_of(spark, 40, 500).write.parquet(f"{tmp_path}/reads")
    reads = spark.read.parquet(f"{tmp_path}/reads")
    want = sorted(map(tuple, bc.counts_in_bins(reads, 28, 10, 2048).collect()))
    monkeypatch.setattr(runtime, "TASK_BYTES", max(1, runtime.bytes_of(reads) // 50))
    many = bc.counts_in_bins(reads, 28, 10, 2048)
    assert many.rdd.getNumPartitions() >= 50 and sorted(map(tuple, many.collect())) == want
