"""Tables in buckets, the table function, first k-mers of bins, samples of byte ranges, observed runs."""

from __future__ import annotations

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.config import CounterConfig
from strandline.operators import bin_counting as bc
from strandline.operators import bins as b
from strandline.plans import jobs
from strandline.sources import bucketed as bu
from strandline.sources import ranges as rg
from strandline.sources.tables import canonical_kmers, register_functions
from tests import brute
from tests.test_bin_counting import reads_of
from tests.test_kmers import as_dict, noisy


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_bucketed_tables_merge_without_an_exchange(spark, tmp_path):
    parts = [[noisy(61, 300), noisy(62, 90)], [noisy(61, 200)], [noisy(63, 50)]]
    name = f"t_{uuid.uuid4().hex}"
    for i, seqs in enumerate(parts):
        bu.add_counts(bc.counts_in_bins(reads_of(spark, seqs), 7, 3, 64), name, f"s{i}", f"{tmp_path}/t", buckets=4)
    with pytest.raises(ValueError, match="already"):
        bu.add_counts(bc.counts_in_bins(reads_of(spark, parts[0]), 7, 3, 64), name, "s0", f"{tmp_path}/t", buckets=4)
    merged = bu.merged_counts(spark, name)
    assert as_dict(merged.select("kmer", "n")) == brute.counts([s for seqs in parts for s in seqs], 7)
    compared = bu.compared_bins(spark, name, "s0", "s1")
    one, other = brute.counts(parts[0], 7), brute.counts(parts[1], 7)
    assert compared.agg(F.sum("n_one"), F.sum("n_other"), F.sum("n_both"), F.sum("kmers_both")).first() == (sum(one.values()), sum(other.values()), sum((one & other).values()), len(one & other))
    assert compared.select("bin").distinct().count() == compared.count()
    for df in (merged, compared):
        assert "Exchange" not in final_plan(df)
    spark.sql(f"DROP TABLE {name}")


def test_table_function(spark):
    seqs = [noisy(71, 200), "ACG", None, "N" * 20, "ACGTACGTAC"]
    register_functions(spark)
    reads_of(spark, seqs).createOrReplaceTempView("some_reads")
    got = spark.sql("SELECT read_id, kmer FROM some_reads, LATERAL kmers_of(seq, 5)").collect()
    assert Counter(r["kmer"] for r in got) == brute.counts([s for s in seqs if s], 5)
    assert spark.sql("SELECT * FROM kmers_of('ACGTTT', 4)").count() == 3 and spark.sql("SELECT * FROM kmers_of(NULL, 4)").count() == 0
    assert spark.sql("SELECT count(*) AS n FROM some_reads, LATERAL kmers_of(seq, 0)").first()[0] == 0


def test_long_reads_make_no_long_array():
    sizes = [len(a) for a in canonical_kmers(b"ACGTTGCA" * 125_000, 11)]
    assert sum(sizes) == 1_000_000 - 10 and max(sizes) <= 1 << 15


def test_first_k_mers_of_bins(spark):
    rows = [(bin_, f"{'ACGT'[i % 4]}{'ACGT'[i // 4 % 4]}{'ACGT'[i // 16]}", 5 if i % 3 else 9) for bin_ in range(3) for i in range(40)]
    got = b.top_kmers(spark.createDataFrame(rows, "bin int, kmer string, n long").repartition(3), 20)
    expected = [(k, i + 1, kmer, n) for k in range(3) for i, (n, kmer) in enumerate(sorted(((n, kmer) for x, kmer, n in rows if x == k), key=lambda x: (-x[0], x[1]))[:20])]
    assert sorted(map(tuple, got.collect())) == expected
    plan = final_plan(got)
    assert plan.index("Exchange hashpartitioning(bin") < plan.rindex("WindowGroupLimit")  # the limit lies below the exchange
    assert b.top_kmers(spark.createDataFrame([], "bin int, kmer string, n long"), 3).count() == 0


@pytest.fixture(scope="module")
def fasta(tmp_path_factory):
    r, folder = random.Random(5), tmp_path_factory.mktemp("fasta")
    (folder / "a.fa").write_text("".join(f">chr{i}\n{''.join(r.choices('ACGT', k=40_000))}\n" for i in range(10)))
    return str(folder)


def test_sizes_by_ranges(spark, fasta):
    true = {r["bin"]: r["n_kmers"] for r in b.bin_sizes(rg.read_fasta_ranges(spark, fasta, 11), 11, 4, 256).collect()}
    every = {r["bin"]: (r["n_kmers"], r["error"]) for r in rg.sampled_sizes(spark, fasta, 11, 4, 256, one_in=1, size=3000).collect()}
    assert every == {k: (n, 0.0) for k, n in true.items()}
    some = {r["bin"]: (r["n_kmers"], r["error"]) for r in rg.sampled_sizes(spark, fasta, 11, 4, 256, one_in=5, size=2000).collect()}
    inside = sum(abs(n - true[k]) <= error for k, (n, error) in some.items())
    assert inside > 0.85 * len(some) and all(error > 0 for _, error in some.values())


def test_a_sample_reads_its_own_bytes_only(fasta, monkeypatch):
    read = []
    real = rg.Bytes.blocks
    monkeypatch.setattr(rg, "READ", 1024)
    monkeypatch.setattr(rg.Bytes, "blocks", lambda self: (read.append(len(x)) or x for x in real(self)))
    reader = rg.FastaReader({"path": fasta, "k": "11", "range": "2048", "one_in": "20"})
    whole = sum(p.end - p.start for p in rg.ranges(fasta, 1 << 30))
    parts = reader.partitions()
    for p in parts:
        list(reader.read(p))
    assert 0.02 < len(parts) * 2048 / whole < 0.09 and sum(read) < 0.15 * whole
    assert reader.partitions() == parts and len(rg.some_of(rg.ranges(fasta, 1 << 30), 1000)) == 1


def test_large_bins_are_counted_in_parts_by_the_job(spark, fasta, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "MOST", 1000)
    monkeypatch.setattr(bc, "MOST", 1000)
    monkeypatch.setattr(jobs, "slots_of", lambda sizes, bins: seen.append(bc.slots_of(sizes, bins, most=2000)) or seen[-1])
    seen: list = []
    monkeypatch.setattr(jobs, "bytes_of", lambda reads: 1 << 30)
    seqs = ["".join(line.split("\n")[1:]) for line in open(f"{fasta}/a.fa").read().split(">")[1:]]
    for use_hash in (True, False):
        observed = Observation()
        config = CounterConfig(k=11, m=4, max_bins=64, long_sequences=True, use_hash=use_hash, input_path=fasta, output_path=f"{tmp_path}/{use_hash}/")
        jobs.count_job(spark, config, observed)
        rows = spark.read.option("sep", "\t").schema("kmer string, n long, bin int").csv(config.output_dir())
        expected = brute.counts(seqs, 11)
        assert as_dict(rows) == expected and rows.count() == len(expected)
        assert observed.get == {"n_kmers": len(expected), "n": sum(expected.values()), "most": max(expected.values())}
    assert max(seen[0]) > 1
