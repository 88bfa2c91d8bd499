from __future__ import annotations

import dataclasses
import math

import pytest
from pyspark.sql import functions as F

from strandline.operators import distance as d
from strandline.operators import kmers as km
from strandline.operators import partitioning as pt
from tests import brute
from tests.test_kmers import noisy


def tagged(spark, **seqs):
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(seqs.items())], "read_id long, seq_tag string, seq string")


def found(df):
    return {(r["s1"], r["s2"]): r["distance"] for r in df.collect()}


def test_known_distances(spark):
    counts = km.count_by_tag(tagged(spark, A="GATTACAGATTACA", B="TGTAATCACGT"), 4)
    assert found(d.distances(counts)) == {("A", "B"): 11.0}
    ln, log2 = found(d.distances(counts, "kld_ln")), found(d.distances(counts, "kld_log2"))
    assert math.isclose(ln["A", "B"], 5.545177444, rel_tol=1e-9) and math.isclose(ln["B", "A"], -2.772588722, rel_tol=1e-9)
    assert {k: round(v, 9) for k, v in log2.items()} == {("A", "B"): 8.0, ("B", "A"): -4.0}


@pytest.mark.parametrize("normalize", [False, True])
def test_matches_direct_sum_also_for_disjoint_sequences(spark, normalize):
    seqs = {"a": noisy(1, 300), "b": noisy(2, 200), "c": "ACGTACCA", "d": "GGGGGGGG", "e": "TTTTTTT"}
    r = tagged(spark, **seqs)
    counts = km.count_by_tag(r, 7)
    values = {t: {w: n / (len(s) - 6 if normalize else 1) for w, n in brute.counts([s], 7).items()} for t, s in seqs.items()}
    got = found(d.distances(d.normalized(counts, r, 7) if normalize else counts))
    assert len(got) == 10
    for (s, t), value in got.items():
        assert math.isclose(value, sum((values[s].get(w, 0) - values[t].get(w, 0)) ** 2 for w in values[s].keys() | values[t].keys()), rel_tol=1e-9, abs_tol=1e-12)
    kld = found(d.distances(counts, "kld_ln"))
    assert len(kld) == 20 and kld["d", "e"] == 0.0


@pytest.mark.parametrize("measure", sorted(d.MEASURES))
def test_products_and_joins_agree(spark, monkeypatch, measure):
    monkeypatch.setattr(d, "BLOCK_VALUES", 40)
    base = noisy(4, 120)
    seqs = {f"s{i:02}": (base if i < 3 else "") + noisy(10 + i, 60) for i in range(30)}  # k-mers of few and of many sequences
    counts = km.count_by_tag(tagged(spark, **seqs), 3 if measure == "kld_ln" else 6)
    by_products = found(d.distances(counts, measure))
    by_joins = found(d.distances(counts, dataclasses.replace(d.MEASURES[measure], terms=())))
    assert by_products.keys() == by_joins.keys() and len(by_joins) in (30 * 29, 15 * 29)
    assert all(math.isclose(v, by_joins[k], rel_tol=1e-9, abs_tol=1e-9) for k, v in by_products.items())
    for tile in (1, 7, 15, 30):  # both sides of the limit
        by_tiles = found(d.distances(counts, measure, most_tags=29, tile=tile))
        assert by_tiles.keys() == by_joins.keys() and all(math.isclose(v, by_joins[k], rel_tol=1e-9, abs_tol=1e-9) for k, v in by_tiles.items())


def test_more_sequences_than_can_be_named(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_NAMES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        d.distances(km.count_by_tag(tagged(spark, a="ACGTA", b="ACGTT", c="ACGTC"), 3))


def test_a_measure_of_ones_own(spark):
    m = d.register(d.Measure("shared_product", lambda p, q: p * q, True, fold="product", finalize=lambda x, n: x + n))
    counts = spark.createDataFrame([("a", "AC", 2), ("a", "GG", 3), ("b", "AC", 5), ("b", "GG", 1), ("c", "TT", 1)], "seq_tag string, kmer string, n long")
    assert found(d.distances(counts, "shared_product")) == {("a", "b"): 32.0, ("a", "c"): 4.0, ("b", "c"): 4.0}
    assert d.MEASURES.pop(m.name) is m and m.internal_product and not d.SQUARED_EUCLIDEAN.internal_product
    assert found(d.distances(counts, "mean_square")) == {("a", "b"): 13 / 2, ("a", "c"): 14 / 3, ("b", "c"): 27 / 3}
    picky = d.Measure("picky", lambda p, q: p, True, compatible=lambda c: "weight" in c.columns)
    with pytest.raises(ValueError):
        d.distances(counts, picky)


def test_lpt():
    assert pt.lpt([(1, 10), (2, 7), (3, 6), (4, 5)], 3) == {1: 0, 2: 1, 3: 2, 4: 2}
    assert pt.lpt([], 2) == {} and pt.lpt([(5, 1), (4, 1)], 4) == {4: 0, 5: 1}


def test_rows_are_dealt_by_slot(spark):
    rows = spark.createDataFrame([(b, i) for b in range(6) for i in range(b + 1)], "bin int, i int")
    sizes = rows.where("bin < 5").groupBy("bin").agg(F.count("*").alias("n_kmers"))
    assignment = pt.assign(sizes, 3)
    dealt = pt.deal(rows, assignment, 3).withColumn("p", F.spark_partition_id()).collect()
    assert len(dealt) == 21 and all(r["p"] == r["place"] for r in dealt)
    assert {r["place"] for r in dealt if r["bin"] == 5} == {5 % 3}
    met = {(r["slot"], r["bin"]): r["n"] for r in pt.balance(rows, assignment, 3).collect()}
    assert sum(met.values()) == 21 and met[2, 5] == 6
