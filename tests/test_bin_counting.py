"""Packed k-mers, counting inside bins, dealing by placement, order of files."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import packed
from strandline.functions.bases import bin_of
from strandline.operators import bin_counting as bc
from strandline.operators import bins as b
from strandline.operators import kmers as km
from strandline.operators import minimizers as mz
from strandline.operators import partitioning as pt
from strandline.sources import sinks
from tests import brute
from tests.test_kmers import as_dict, noisy


def reads_of(spark, seqs):
    return spark.createDataFrame([(i, "t", s) for i, s in enumerate(seqs)], "read_id long, seq_tag string, seq string")


def written(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(7)
    copy = "".join(r.choice("ACGT") for _ in range(300))
    return [noisy(31, 700), noisy(32, 90), "ACG", "", None, "A" * 300, "ACGT" * 60, copy, copy, "N" + copy + "nA", "T" * 41]


@pytest.mark.parametrize("k", [1, 2, 11, 28, 31, 32, 40, 61, 62])
def test_packed_k_mers(spark, k):
    r = random.Random(k)
    rows = [("".join(r.choice("ACGT") for _ in range(k + 30)), i) for i in range(31)]
    many = 2 if k <= 31 else 3
    words = [F.col(f"w{j}") for j in range(many)]
    df = spark.createDataFrame(rows, "s string, r int").select("s", "r", *[packed.word_at(F.col("s").cast("binary"), F.lit(31 * j)).alias(f"w{j}") for j in range(many)])
    df = df.select("*", *[packed.reversed_number(w, 31).alias(f"u{j}") for j, w in enumerate(words)])
    forward, reverse = packed.window(words, F.col("r"), k), packed.reverse_window([F.col(f"u{j}") for j in range(many)], F.col("r"), k)
    for x in df.select("s", "r", packed.text(forward, k).alias("f"), packed.text(reverse, k).alias("b"), packed.text(packed.smaller(forward, reverse), k).alias("m")).collect():
        kmer = x["s"][x["r"] : x["r"] + k]
        assert (x["f"], x["b"], x["m"]) == (kmer, brute.reverse_complement(kmer), min(kmer, brute.reverse_complement(kmer)))


@pytest.mark.parametrize("k", [5, 11, 28, 40])
@pytest.mark.parametrize("canonical", [True, False])
def test_packed_counts(spark, seqs, k, canonical):
    reads = reads_of(spark, seqs)
    assert as_dict(km.count_packed(reads, k, canonical, piece=64)) == as_dict(km.count_kmers(reads, k, canonical))


def test_packed_counts_shuffle_less(spark):
    reads = reads_of(spark, [noisy(s, 3000) for s in range(40)]).repartition(4).cache()
    reads.count()
    sent = []
    for count in (km.count_kmers, km.count_packed):
        before = written(spark)
        count(reads, 28).count()
        sent.append(written(spark) - before)
    assert sent[1] < 0.75 * sent[0]


@pytest.mark.parametrize("k,m,bins", [(5, 3, 64), (11, 4, 256), (28, 10, 2048), (31, 2, 16), (40, 7, 1000), (62, 10, 64)])
@pytest.mark.parametrize("split", [False, True])
def test_counts_in_bins(spark, monkeypatch, seqs, k, m, bins, split):
    monkeypatch.setattr(bc, "BLOCK", 257)
    parts = np.random.default_rng(k).integers(1, 6, bins) if split else None
    got = bc.counts_in_bins(reads_of(spark, seqs), k, m, bins, parts)
    expected = b.binned_counts(km.count_kmers(reads_of(spark, seqs), k), k, m, bins)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected.collect()))
    if k <= 11:
        assert as_dict(got.select("kmer", "n")) == brute.counts([s for s in seqs if s], k)


def test_one_exchange_of_a_third_of_the_bytes(spark):
    reads = reads_of(spark, [noisy(s, 3000) for s in range(40)]).repartition(4).cache()
    reads.count()
    counted = bc.counts_in_bins(reads, 28, 10, 2048)
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1
    before = written(spark)
    bc.counts_in_bins(reads, 28, 10, 2048).count()
    binned = written(spark) - before
    km.count_kmers(reads, 28).count()
    assert 3 * binned < written(spark) - before - binned


def test_copies_shrink_before_they_are_sent(spark):
    copies = reads_of(spark, [noisy(1, 400)] * 500).coalesce(1)
    once = bc.packed_super_kmers(reads_of(spark, [noisy(1, 400)]), 28, 10, 2048).count()
    assert bc.packed_super_kmers(copies, 28, 10, 2048).count() <= 2 * once


def test_no_part_is_far_above_the_bound(spark):
    r = random.Random(4)
    reads = reads_of(spark, ["".join(r.choices("ACGT", k=4000)) for _ in range(30)])
    sizes, most = b.bin_sizes(reads, 28, 2, 4), 2_000
    parts = bc.slots_of(sizes, 4, most=most)
    assert parts.max() > 10
    largest = bc.packed_super_kmers(reads, 28, 2, 4, parts).groupBy("slot").agg(F.sum(F.col("times") * (F.col("last") + 1)).alias("n")).agg(F.max("n")).first()[0]
    assert largest < 4 * most < bc.packed_super_kmers(reads, 28, 2, 4).groupBy("slot").agg(F.sum(F.col("times") * (F.col("last") + 1)).alias("n")).agg(F.max("n")).first()[0]


def test_bin_numbers_are_the_column_function_s(spark):
    values = [0, 1, 256, 4**10, 12345, 2**20 + 7]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(bin_of(F.col("v"), 256).alias("b")).collect()
    assert [r["b"] for r in rows] == bc.bin_numbers(np.array(values), 256).tolist()


def test_rows_land_where_the_placement_says(spark, seqs):
    reads = reads_of(spark, seqs)
    assignment = pt.assign(b.bin_sizes(reads, 11, 4, 256), 5)
    placed = {r["bin"]: r["slot"] for r in assignment.collect()}
    met = pt.balance(mz.super_kmers(reads, 11, 4, 256), assignment, 5).collect()
    sizes = {r["bin"]: r["n_super"] for r in b.bin_sizes(reads, 11, 4, 256).collect()}
    assert {r["bin"]: (r["slot"], r["n"]) for r in met} == {k: (placed[k], n) for k, n in sizes.items()} and len(met) == len(placed)
    rows = bc.packed_super_kmers(reads, 11, 4, 256).withColumn("bin", F.shiftright("slot", 32).cast("int"))
    counted = bc.counted_slots(pt.deal(rows, assignment, 5), 11, "place").withColumn("p", F.spark_partition_id()).collect()  # no exchange behind the placement
    assert all(r["p"] == placed[r["bin"]] for r in counted) and as_dict(bc.counts_in_bins(reads, 11, 4, 256).select("kmer", "n")) == {r["kmer"]: r["n"] for r in counted}


def test_files_of_a_large_bin_are_in_order(spark, tmp_path):
    r = random.Random(3)
    rows = [(i % 2, "".join(r.choice("ACGT") for _ in range(12)), 1) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_counts(spark.createDataFrame(rows, "bin int, kmer string, n long").repartition(3), f"{tmp_path}/out", by_range=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for folder in (0, 1):
        files = sorted((tmp_path / "out" / f"bin={folder}").glob("part-*"))
        assert len(files) >= 2
        kmers = [line.split("\t")[0] for f in files for line in f.read_text().splitlines()]
        assert kmers == sorted(kmers) and len(kmers) == 3000
