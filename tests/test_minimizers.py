"""Super-k-mers, (k,x)-mers and bins: hand-checked fixtures, brute force, and routes to the same counts."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import minimizer
from strandline.functions.minimizer import signature, signature_number
from strandline.operators import bins as b
from strandline.operators import kmers as km
from strandline.operators import minimizers as mz
from tests import brute
from tests.test_kmers import M1, M3, as_dict, noisy, reads

M4 = "GGCGTCGGCCTGCC"


def supers(seq: str, k: int, m: int, block: int = mz.BLOCK):
    s = mz.super_kmers_of(seq.encode(), k, m, block)
    return list(zip(s.start.tolist(), s.n.tolist(), s.sig.tolist(), s.pos.tolist()))


def test_known_super_kmers(spark):
    found = {(r["start"], r["super_kmer"], r["n_kmers"], r["sig"], r["sig_number"], r["sig_pos"], r["bin"]) for r in mz.super_kmers(reads(spark, M1), 5, 3, 64).collect()}
    assert found == {
        (0, "ACGTA", 1, "ACG", 6, 0, 18), (1, "CGTAC", 1, "ACG", 6, 1, 18), (2, "GTACGT", 2, "ACG", 6, 4, 18), (10, "GATTA", 1, "ATC", 13, 10, 7),
        (11, "ATTAC", 1, "ATT", 15, 11, 24), (12, "TTACA", 1, "GTA", 44, 13, 24), (13, "TACAG", 1, "CAG", 18, 15, 0), (14, "ACAGATT", 3, "AGA", 8, 16, 55),
        (17, "GATTA", 1, "ATC", 13, 17, 7), (18, "ATTAC", 1, "ATT", 15, 18, 24), (19, "TTACA", 1, "GTA", 44, 20, 24),
    }
    assert supers("T" * 9, 4, 3) == [(i, 1, 63, i) for i in range(6)]
    assert supers(M3, 4, 3) == [(0, 1, 6, 0), (9, 1, 6, 9), (10, 1, 5, 11)]
    assert supers(M4, 5, 3) == [(0, 3, 6, 2), (3, 3, 22, 5), (6, 3, 10, 8), (9, 1, 18, 9)]


def test_known_kx_mers(spark):
    found = [tuple(r)[2:] for r in mz.kx_mers(reads(spark, M1), 5, 3, 2).orderBy("start").collect()]
    assert found == [(0, 0, "ACGTA"), (0, 0, "CGTAC"), (1, 1, "ACGTAC"), (0, 0, "GATTA"), (0, 0, "ATTAC"), (0, 1, "TGTAA"), (0, 1, "CTGTA"), (0, 0, "ACAGA"), (1, 1, "AATCTG"), (0, 0, "GATTA"), (0, 0, "ATTAC"), (0, 1, "TGTAA")]
    found = [tuple(r)[2:] for r in mz.kx_mers(reads(spark, M4), 5, 3, 2).orderBy("start").collect()]
    assert found == [(2, 1, "CGACGCC"), (1, 1, "GCCGAC"), (0, 0, "CGGCC"), (1, 1, "CAGGCC"), (0, 0, "CCTGC"), (0, 0, "CTGCC")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ACGTACGTN", max_size=120), st.integers(1, 40), st.integers(1, 8), st.integers(0, 4))
def test_kernels_match_brute_force(seq, k, m, x):
    m = min(m, k)
    expected = brute.super_kmers(seq, k, m)
    assert supers(seq, k, m) == expected
    assert supers(seq, k, m, block=max(k, 17)) == expected  # block borders heal
    start, n, turn = mz.kx_mers_of(seq.encode(), mz.super_kmers_of(seq.encode(), k, m), k, x)
    assert list(zip(start.tolist(), (n - 1).tolist(), turn.tolist())) == [r[:3] for r in brute.kx_mers(seq, k, m, x)]


@pytest.mark.parametrize(("k", "m", "x"), [(7, 3, 2), (11, 4, 0), (35, 6, 3)])
def test_all_routes_give_the_same_counts(spark, k, m, x):
    r = reads(spark, noisy(11, 800), noisy(12, 400), "", None, "A" * 90)
    direct = as_dict(km.count_kmers(r, k))
    assert direct == as_dict(b.counts_via_super_kmers(r, k, m)) == as_dict(b.counts_via_kx_mers(r, k, m, x))
    s = mz.super_kmers(r, k, m, 64)
    assert s.agg(F.sum("n_kmers")).first()[0] == sum(direct.values()) == mz.kx_mers(r, k, m, x).agg(F.sum(F.col("x") + 1)).first()[0]
    assert s.where(F.length("super_kmer") > 2 * k - m).count() == 0


def test_signature_of_a_kmer_is_that_of_its_super_kmer(spark):
    r = reads(spark, noisy(13, 500))
    k, m, bins = 9, 4, 100
    by_kmer = {x["kmer"]: x["bin"] for x in b.binned_counts(km.count_kmers(r, k), k, m, bins).collect()}
    for s in mz.super_kmers(r, k, m, bins).collect():
        for i in range(s["n_kmers"]):
            w = s["super_kmer"][i : i + k]
            assert by_kmer[min(w, brute.reverse_complement(w))] == s["bin"]
    got = mz.kmer_signatures(r, k, m)
    text = r.first()["seq"]
    for x in got.collect():
        assert x["sig_pos"] == x["i"] + min((brute.norm(text[x["i"] + j : x["i"] + j + m]), j) for j in range(k - m + 1))[1]
    row = spark.range(1).select(signature(F.lit("GATTACAGA"), k, m).alias("s")).select(signature_number(F.col("s.v"), m), "s.p").first()
    assert tuple(row) == min((brute.norm("GATTACAGA"[j : j + m]), j) for j in range(k - m + 1))


def test_signatures_of_long_kmers_are_not_unrolled(spark, monkeypatch):
    rows = spark.createDataFrame([(noisy(16, 60).replace("N", "A")[:50],)], "kmer string")
    one = lambda: rows.select(signature(F.col("kmer"), 50, 5).alias("s")).select("s.v", "s.p")
    folded = one().first()
    monkeypatch.setattr(minimizer, "UNROLLED", 100)
    assert folded == one().first() and one().schema["p"].dataType.simpleString() == "int"


def test_histogram_and_sizes(spark):
    r = reads(spark, noisy(14, 600), noisy(15, 300))
    h = b.signature_histogram(r, 9, 4, 32).collect()
    totals = {x["bin"]: x["n"] for x in h if x["sig"] is None}
    for bin_, n in totals.items():
        assert n == sum(x["n"] for x in h if x["bin"] == bin_ and x["sig"] is not None)
    assert {x["bin"]: x["n_super"] for x in b.bin_sizes(r, 9, 4, 32).collect()} == totals
    assert {(x["bin"], x["n_super"]) for x in b.bin_totals(r, 9, 4, 32).collect()} == set(totals.items())
    assert b.bin_sizes(b.sampled(r, 2), 9, 4, 32).agg(F.sum("n_kmers")).first()[0] == sum(brute.counts([noisy(14, 600)], 9).values())


def test_empty_input(spark):
    r = reads(spark, "ACGT").where("false")
    assert mz.super_kmers(r, 4, 2, 8).count() == mz.kx_mers(r, 4, 2, 1).count() == b.bin_sizes(r, 4, 2, 8).count() == 0
