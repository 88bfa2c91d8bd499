"""What long k-mers, tags and streams send and hold must not grow faster than the input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.functions.bases import pack_words
from strandline.operators import bin_counting as bc
from strandline.operators import kmers as km
from strandline.operators import short_counting as sc
from strandline.plans import queries as q
from tests import brute
from tests.test_bin_counting import reads_of, written
from tests.test_kmers import as_dict, noisy

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [16, 28, 31, 32, 40, 62])
def test_f10_long_kmers_are_counted_in_bins_and_their_parts(spark, monkeypatch, k):
    r = random.Random(k)
    copy = "".join(r.choices("ACGT", k=200))
    seqs = [noisy(1, 900), copy, copy, "N" + copy + "N", "A" * 150, "ACGT" * 40, "ACG", "", None, "N" * 70, copy[:k], copy[: k - 1]]
    reads = reads_of(spark, seqs)
    want = brute.counts([s for s in seqs if s], k)
    assert as_dict(bc.count_long(reads, k)) == want
    monkeypatch.setattr(bc, "MOST", 200)  # large bins go in parts
    monkeypatch.setattr(bc, "SAMPLE_ONE_IN", 1)
    assert as_dict(bc.count_long(reads, k)) == want
    assert as_dict(bc.count_long(reads.where("false"), k)) == {}


def test_f10_the_query_sends_super_kmers(spark):
    plan = plan_of(entry.queries()["canonical_kmer_counts_k28"](spark, SF))
    assert "MapInArrow" in plan and "hashpartitioning(slot" in plan and "hashpartitioning(kmer" not in plan


def test_f13_words_are_the_numbers_that_were_counted(spark):
    rows = entry.queries()["kmer_words_k40"](spark, SF)
    plan = plan_of(rows)
    assert "hashpartitioning(slot" in plan and "conv(" not in plan
    some = rows.limit(500).withColumn("w", pack_words(F.col("kmer"))).collect()
    assert some and all([r["word_0"], r["word_1"]] == r["w"] for r in some)


@pytest.mark.parametrize("k", [28, 40])
def test_f16_f23_packed_counts_send_less_than_a_table_of_kmers(spark, k):
    r = random.Random(9)
    reads = reads_of(spark, ["".join(r.choices("ACGT", k=3_000)) for _ in range(30)]).repartition(4).cache()
    reads.count()
    sent = []
    for count in (lambda: km.count_packed(reads, k), lambda: (rows := km.packed_kmers(reads, k)).groupBy(*rows.columns).agg(F.count("*").alias("n"))):
        before = written(spark)
        count().write.format("noop").mode("overwrite").save()
        sent.append(written(spark) - before)
    assert 2 * sent[0] < sent[1]


@pytest.mark.parametrize("k", [1, 4, 11, 15, 16, 24])
@pytest.mark.parametrize("canonical", [True, False])
def test_f18_f22_short_kmers_are_added_up_where_the_read_is(spark, monkeypatch, k, canonical):
    seqs = [noisy(1, 900), noisy(2, 90), "", "ACG", "N" * 30, "A" * 100, "ACGT" * 30, None, "acgtACGTTGCA", "T" * k]
    tags = ["a", "b", None, "a", "c", "", "b", "a", "é", None]
    reads = spark.createDataFrame(list(zip(range(len(seqs)), tags, seqs)), "read_id long, seq_tag string, seq string").coalesce(1)
    want = {(t, kmer, n) for t in set(tags) for kmer, n in brute.counts([s for s, u in zip(seqs, tags) if s and u == t], k, canonical).items()}
    whole = brute.counts([s for s in seqs if s], k, canonical)
    assert sc.task_sums(reads, k, False, canonical).count() == len(whole)  # each once, not each occurrence
    assert sc.task_sums(reads, k, True, canonical).count() == len(want)
    monkeypatch.setattr(sc, "BLOCK", 101)
    for at_once, held, held_tags in ((1 << 22, 1 << 22, 1 << 14), (50, 60, 1)):
        monkeypatch.setattr(sc, "AT_ONCE", at_once)
        monkeypatch.setattr(sc, "HELD", held)
        monkeypatch.setattr(sc, "HELD_TAGS", held_tags)
        assert as_dict(sc.count_short(reads, k, canonical=canonical)) == whole
        assert {tuple(r) for r in sc.count_short(reads, k, "seq_tag", canonical=canonical).collect()} == want
    assert "MapInArrow" in plan_of(km.count_by_tag(reads, k, canonical)) and ("MapInArrow" in plan_of(km.count_kmers(reads, k, canonical))) == (k < km.LONG)


def test_f17_f19_files_that_arrive_make_tasks_for_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q, "TASK_BYTES", max(1, q.bytes_of(q.reads_of(spark, SF)) // 40))
    reads = q.arriving(spark, SF, f"file://{tmp_path}")
    files = list((tmp_path / "in").glob("part-*"))
    assert len(files) >= 36
    sizes = []
    query = reads.writeStream.foreachBatch(lambda batch, i: sizes.append(batch.count())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(sizes) == 4 and sum(sizes) == q.reads_of(spark, SF).count()
