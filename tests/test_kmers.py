"""Counts, windows and scalar functions against the spelled-out rules and hand-checked answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import bases, minimizer
from strandline.operators import kmers as km
from strandline.sources.reads import chunk_reads
from tests import brute

M1 = "ACGTACGTNNGATTACAGATTACA"
M3 = "ACGTNacgtACGGT"


def reads(spark, *seqs):
    return spark.createDataFrame([(i, f"t{i % 2}", s) for i, s in enumerate(seqs)], "read_id long, seq_tag string, seq string")


def as_dict(df):
    return {r["kmer"]: r["n"] for r in df.collect()}


def noisy(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("ACGTACGTACGTACGTN") for _ in range(n))


def test_known_counts(spark):
    assert as_dict(km.count_kmers(reads(spark, M1), 5)) == {"AATCT": 1, "ACAGA": 1, "ACGTA": 2, "ATCTG": 1, "ATTAC": 2, "CGTAC": 2, "CTGTA": 1, "GATTA": 2, "TGTAA": 2}
    assert as_dict(km.count_kmers(reads(spark, "T" * 9), 4)) == {"AAAA": 6}
    assert as_dict(km.count_kmers(reads(spark, M3), 4)) == {"ACCG": 1, "ACGG": 1, "ACGT": 1}
    assert sum(as_dict(km.count_kmers(reads(spark, "GGCGTCGGCCTGCC"), 5)).values()) == 10


@pytest.mark.parametrize("k", [1, 4, 11, 31, 32, 40, 63])
def test_counts_match_brute_force(spark, k):
    seqs = [noisy(1, 700), noisy(2, 90), "", "ACG", "N" * 50, "A" * 200, "ACGT" * 30]
    for canonical in (True, False):
        assert as_dict(km.count_kmers(reads(spark, *seqs), k, canonical)) == brute.counts(seqs, k, canonical)


def test_edges_give_nothing(spark):
    assert km.count_kmers(reads(spark, "", "ACG", "NNNNNNNN", "acgtacgt", None), 5).count() == 0
    assert as_dict(km.count_kmers(reads(spark, "GATTA"), 5)) == {"GATTA": 1}
    assert km.count_kmers(reads(spark, "ACGT").where("false"), 2).count() == 0


def test_strands_and_pieces_do_not_matter(spark):
    s = noisy(3, 900).replace("N", "A")
    one = as_dict(km.count_kmers(reads(spark, s), 9))
    assert one == as_dict(km.count_kmers(reads(spark, brute.reverse_complement(s)), 9))
    assert one == as_dict(km.count_kmers(reads(spark, s), 9, piece=9)) == as_dict(km.count_kmers(reads(spark, s), 9, piece=50))
    assert one == as_dict(km.count_kmers(chunk_reads(reads(spark, s), 9, 64), 9))


def test_extra_columns_and_repeated_rows(spark):
    r = reads(spark, "GATTACA", "GATTACA").withColumn("n", F.lit(7)).withColumn("kmer", F.lit("x"))
    assert as_dict(km.count_kmers(r, 7)) == {"GATTACA": 2}


def test_valid_segments(spark):
    found = {tuple(r) for r in km.valid_segments(reads(spark, "NNACGTNACGTACNNA", "ACG", "ACGT"), 4).collect()}
    assert found == {(0, 2, 4), (0, 7, 6), (2, 0, 4)}


def test_invalid_bounds(spark):
    rows = spark.createDataFrame([("ACGT",), ("NACG",), ("ANGn",), ("ACGN",)], "s string").select("s", bases.first_invalid(F.col("s")).alias("a"), bases.last_invalid(F.col("s")).alias("b"))
    assert {r["s"]: (r["a"], r["b"]) for r in rows.collect()} == {"ACGT": (-1, -1), "NACG": (0, 0), "ANGn": (1, 3), "ACGN": (3, 3)}


def test_scalars(spark):
    long = noisy(5, 45).replace("N", "C")
    rows = spark.createDataFrame([("GATTACA",), ("ACGT",), ("T",), (long,)], "s string")
    s = F.col("s")
    got = rows.select("s", bases.reverse_complement(s).alias("rc"), bases.orientation(s).alias("o"), bases.canonical(s).alias("c"), bases.pack_words(s).alias("w"), bases.base_at(s, 3).alias("b"), bases.is_valid(s).alias("v"), bases.complement(F.concat(s, F.lit("x"))).alias("x")).collect()
    for r in got:
        rc = brute.reverse_complement(r["s"])
        assert (r["rc"], r["o"], r["c"]) == (rc, 0 if r["s"] < rc else 1, min(rc, r["s"]))
        assert r["w"] == [brute.number(r["s"][i : i + 31]) for i in range(0, len(r["s"]), 31)]
        assert r["b"] == (r["s"][3] if len(r["s"]) > 3 else None) and r["v"] and r["x"].endswith("x")
    one = spark.range(1)
    assert one.select(bases.unpack(bases.pack(F.lit("AAGATTACA")), 9)).first()[0] == "AAGATTACA"
    assert one.select(bases.orientations_to_number(F.array(F.lit(1), F.lit(0), F.lit(1), F.lit(1)))).first()[0] == 13
    assert one.select(bases.ones_mask(5)).first()[0] == 31
    assert one.select(bases.strip_line_ends(F.lit("AC\r\nGT\n"))).first()[0] == "ACGT"


def test_bin_hash(spark):
    rows = spark.createDataFrame([(0,), (1,), (256,), (4**15,)], "s long").select("s", bases.bin_of(F.col("s"), 256).alias("b"))
    got = {r["s"]: r["b"] for r in rows.collect()}
    assert (got[0], got[1], got[256]) == (106, 157, 232) and got[4**15] == brute.bin_of(4**15, 256)


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_norms(spark, m):
    rows = spark.range(4**m).select(bases.unpack(F.col("id"), m).alias("q")).select("q", minimizer.signature_number(minimizer.norm(F.col("q"), m), m).alias("v"), minimizer.is_allowed(F.col("q"), m).alias("a"))
    for r in rows.collect():
        assert (r["v"], r["a"]) == (brute.norm(r["q"]), brute.allowed(r["q"]))
