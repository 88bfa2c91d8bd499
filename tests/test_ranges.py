"""FASTA and FASTQ by byte ranges."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import kmers as km
from strandline.operators.bins import super_kmer_counts
from strandline.sources import ranges as rg
from tests import brute
from tests.test_files import wrapped
from tests.test_kmers import as_dict, noisy


class Memory(rg.Bytes):
    """A file in memory."""

    def __init__(self, data: bytes, start: int):
        import io

        self.file, self.start = io.BytesIO(data), start
        self.file.read_all = self.file.read


def cut(data: bytes, size: int):
    return [(a, min(a + size, len(data))) for a in range(0, len(data), size)]


SEQS = {"chr1 x > y": noisy(41, 400), "": "ACGTACGTTTGAC", "e": "", "one": "G", "chr1": noisy(42, 97)}


@pytest.mark.parametrize("layout", ["one line", "wrapped", "crlf", "no end", "blank lines"])
def test_every_way_to_cut_gives_the_same_k_mers(monkeypatch, layout):
    width, end = (10_000, "\n") if layout in ("one line", "no end") else (7, "\r\n" if layout == "crlf" else "\n")
    text = "".join(f">{h}{end}{wrapped(s, width, end)}{end}{end if layout == 'blank lines' else ''}" for h, s in SEQS.items())
    data = (text.rstrip() if layout == "no end" else text).encode()
    expected = {k: brute.counts(SEQS.values(), k) for k in (1, 5, 9)}
    for block in (1, 3, 50, 1 << 20):
        monkeypatch.setattr(rg, "READ", block)
        for size in (1, 2, 3, 7, 20, 111, len(data)):
            for k in (1, 5, 9):
                found, heads = [], []
                for a, b in cut(data, size):
                    for record, header, start, own, seq in rg.fasta_chunks(Memory(data, a), b, k, 30):
                        found.append(seq.decode())
                        assert len(seq) <= own + k - 1
                        if not seq:
                            heads.append(header)
                assert brute.counts(found, k) == expected[k], (block, size, k)
                assert heads == [h.strip() for h in SEQS]


def test_ranges_in_spark(spark, tmp_path):
    long = {"chr1 x": noisy(43, 3000), "chr2": noisy(44, 50), "chr1 y": noisy(45, 1500)}
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{wrapped(s, 61)}\n" for h, s in long.items()))
    (tmp_path / "b.fa").write_text("".join(f">{h}\n{s}\n" for h, s in long.items()))
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write("".join(f">{h}\n{s}\n" for h, s in long.items()))
    for size in (97, 500, 1 << 20):
        chunks = rg.read_fasta_ranges(spark, str(tmp_path), 9, chunk=200, size=size)
        rows = chunks.collect()
        for r in rows:
            assert r["seq"] == long[r["header"]][r["chunk_start"] :][: len(r["seq"])] and r["seq_tag"] == r["header"][:4]
        assert len({r["read_id"] for r in rows}) == 9
        bare = rg.read_fasta_ranges(spark, f"file://{tmp_path}", 9, chunk=200, size=size, places=False)
        assert as_dict(km.count_kmers(chunks, 9)) == as_dict(km.count_kmers(bare, 9)) == brute.counts([*long.values()] * 3, 9)
        assert "Exchange" not in bare._jdf.queryExecution().executedPlan().toString()
        want: dict = {}
        for s in [*long.values()] * 3:
            for _, n, sig, _ in brute.super_kmers(s, 9, 4):
                have = want.get(sig, (0, 0))
                want[sig] = (have[0] + 1, have[1] + n)
        number = lambda sig: 4**4 if sig == "~" else brute.number(sig)
        assert {number(r["sig"]): (r["n"], r["n_kmers"]) for r in super_kmer_counts(chunks, 9, 4, 64).collect()} == want
    with pytest.raises(Exception, match="No such|not found|missing|FileNotFound"):
        rg.read_fasta_ranges(spark, str(tmp_path / "missing"), 9).count()


def test_headers_that_are_too_long_are_an_error(monkeypatch):
    monkeypatch.setattr(rg, "HEADER_BYTES", 50)
    data = b">" + b"h" * 200 + b"\nACGT\n"
    with pytest.raises(ValueError, match="longer"):
        list(rg.fasta_chunks(Memory(data, 0), 20, 3, 30))
    data = b">ok\n" + b"ACGT" * 100 + b"\n"
    assert brute.counts([seq.decode() for a, b in cut(data, 60) for *_, seq in rg.fasta_chunks(Memory(data, a), b, 3, 30)], 3) == brute.counts(["ACGT" * 100], 3)


def fastq(n: int, seed: int, end: str = "\n"):
    """Records whose qualities often begin with @ or +, and whose headers hold both."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(r.choices("ACGTN", k=r.randrange(0, 30)))
        quality = "".join(r.choices("@+I#5", k=len(seq)))
        out.append((f"t{i % 3}.{i} @+{i}", seq, quality))
    return out, end.join(f"@{h}{end}{s}{end}+{h if i % 2 else ''}{end}{q}" for i, (h, s, q) in enumerate(out)) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_way_to_cut_gives_the_same_records(monkeypatch, end):
    records, text = fastq(25, 1, end)
    for data in (text.encode(), text.rstrip("\r\n").encode() if records[-1][1] else text.encode()):
        for block in (1, 5, 1 << 20):
            monkeypatch.setattr(rg, "READ", block)
            for size in (1, 3, 10, 40, len(data)):
                got = [(h.decode(), s.decode(), q.decode()) for a, b in cut(data, size) for _, h, s, q in rg.fastq_records(Memory(data, a), b)]
                assert got == records, (block, size)
    for broken in (b"@a\nACGT\n+\nII\n", b"@a\nACGT\n+\n"):
        with pytest.raises(ValueError):
            list(rg.fastq_records(Memory(broken, 0), len(broken)))


def test_fastq_in_spark(spark, tmp_path):
    records, text = fastq(200, 2)
    (tmp_path / "a.fq").write_text(text)
    for size in (50, 333, 1 << 20):
        reads = rg.read_fastq(spark, str(tmp_path), size=size)
        assert sorted((r["header"], r["seq"]) for r in reads.collect()) == sorted((h, s) for h, s, _ in records)
        assert as_dict(km.count_kmers(reads, 7)) == brute.counts([s for _, s, _ in records], 7)
        assert reads.select("read_id").distinct().count() == 200 and reads.where(F.col("seq_tag") == "t1").count() == 67
        masked = ["".join(c if ord(q) - 33 >= 11 else "N" for c, q in zip(s, quality)) for _, s, quality in records]
        assert as_dict(km.count_kmers(rg.read_fastq(spark, str(tmp_path), least_quality=11, size=size), 3)) == brute.counts(masked, 3)


def test_a_task_reads_many_small_ranges_and_little_more_than_their_bytes(tmp_path, monkeypatch):
    seqs = {"chr1": noisy(46, 300_000), "chr2": noisy(47, 90_000)}
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s}\n" for h, s in seqs.items()))
    (tmp_path / "b.fa").write_text("".join(f">{h}\n{wrapped(s, 70)}\n" for h, s in seqs.items()))
    read = []
    real = rg.Bytes.blocks
    monkeypatch.setattr(rg.Bytes, "blocks", lambda self: (read.append(len(x)) or x for x in real(self)))
    reader = rg.FastaReader({"path": str(tmp_path), "k": "11", "chunk": "500", "range": "5000", "cores": "2"})
    parts, whole = reader.partitions(), sum(p.end - p.start for p in rg.ranges(str(tmp_path), 5000))
    batches = [batch for p in parts for batch in reader.read(p)]
    assert len(parts) <= 2 * rg.WAVES + 1 and len(batches) == len(parts) and sum(read) < 2 * whole
    assert brute.counts([s for batch in batches for s in batch.column("seq").to_pylist()], 11) == brute.counts([*seqs.values()] * 2, 11)
