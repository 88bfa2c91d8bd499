"""Places of possible k-mers: what tasks give on must not grow with their reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import bin_counting as bc
from strandline.operators import short_counting as sc
from strandline.sources.reads import LETTER_BASES, LETTERS, reads_from_text
from strandline.streaming import counts as st
from tests import brute
from tests.test_kmers import as_dict, noisy


@pytest.mark.parametrize("k", [1, 2, 4, 11, 12, 13])
@pytest.mark.parametrize("canonical", [True, False])
def test_f22_places_and_sums_agree(spark, monkeypatch, k, canonical):
    seqs = [noisy(1, 900), noisy(2, 90), "", "ACG", "N" * 30, "A" * 100, "ACGT" * 30, None, "acgtACGTTGCA", "T" * k]
    tags = ["a", "b", None, "a", "c", "", "b", "a", "é", None]
    reads = spark.createDataFrame(list(zip(range(len(seqs)), tags, seqs)), "read_id long, seq_tag string, seq string").coalesce(1)
    want = {(t, kmer, n) for t in set(tags) for kmer, n in brute.counts([s for s, u in zip(seqs, tags) if s and u == t], k, canonical).items()}
    whole = brute.counts([s for s in seqs if s], k, canonical)
    one = 4 * sc.Places.many(k, canonical)
    for places, placed, waiting, full in ((one, 64, 1 << 24, 1 << 31), (0, 64, 1, 1), (1 << 28, 2, 100, 1 << 31), (1 << 28, 64, 1, 300)):
        for name, value in (("PLACES", places), ("PLACED_TAGS", placed), ("WAITING", waiting), ("FULL", full), ("BLOCK", 101)):
            monkeypatch.setattr(sc, name, value)
        assert as_dict(sc.count_short(reads, k, canonical=canonical)) == whole
        assert {tuple(r) for r in sc.count_short(reads, k, "seq_tag", canonical=canonical).collect()} == want


def test_f22_a_task_gives_each_kmer_of_a_tag_on_once(spark, monkeypatch):
    monkeypatch.setattr(sc, "HELD", 1_000)
    monkeypatch.setattr(sc, "AT_ONCE", 1_000)
    r = random.Random(22)
    rows = [(i, "abc"[i % 3], "".join(r.choices("ACGT", k=2_000))) for i in range(60)]
    reads = spark.createDataFrame(rows, "read_id long, seq_tag string, seq string").coalesce(1)
    assert sc.task_sums(reads, 7, True).count() == sum(len(brute.counts([s for _, t, s in rows if t == tag], 7)) for tag in "abc")


def test_f19_texts_become_reads_as_bytes(spark):
    texts = ["", None, "\n", "ab cd\nef\r\tgh-ACGTN", "über straße é", "漢字 a\U0001f600b", "NNN\x00zZ ", "x" * 5_000, LETTERS, "a\n\nb"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    old = F.regexp_replace(F.translate(F.replace("text", F.lit("\n"), F.lit("")), LETTERS, LETTER_BASES), "[^ACGT]", "N")
    want = {r[0]: r[1] for r in rows.select("doc_id", old).collect()}
    got = reads_from_text(rows)
    assert {r["read_id"]: r["seq"] for r in got.collect()} == want and "translate(" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("k, m", [(2, 2), (6, 3), (11, 4), (15, 10), (5, 1)])
def test_f19_short_kmers_get_their_bins_when_they_are_counted(spark, k, m):
    seqs = [noisy(1, 900), noisy(2, 90), "", "ACG", "A" * 100, "ACGT" * 30, None, "acgtACGTTGCA", "T" * k]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    want = sorted(map(tuple, bc.counts_in_bins(reads, k, m, 20).collect()))
    assert want and sorted(map(tuple, bc.short_counts_in_bins(reads, k, m, 20).collect())) == want


def test_f19_a_batch_sends_sums_and_no_super_kmers(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "t", noisy(1, 900))], "read_id long, seq_tag string, seq string").write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(bc, "packed_super_kmers", None)
    st.start_batch_counts(st.stream_reads(spark, f"{tmp_path}/in"), 11, 4, 20, f"{tmp_path}/out", f"{tmp_path}/c", available_now=True).awaitTermination()
    assert as_dict(st.merged_batches(spark, f"{tmp_path}/out").select("kmer", "n")) == brute.counts([noisy(1, 900)], 11)
