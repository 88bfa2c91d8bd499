"""Minimizer rules as column expressions: allowed m-mers, their norm, a k-mer's signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.bases import pack, reverse_complement

#: Stands for the default signature; sorts after every base.
DEFAULT = "~"
#: m-mers of a k-mer up to which a signature is one unrolled expression.
UNROLLED = 32


def is_allowed(mmer: Column, m: int) -> Column:
    """m-mers without AA that don't begin with ACA; shorter ones by what is left of these tests."""
    if m == 1:
        return F.lit(False)
    if m == 2:
        return ~mmer.startswith("A") & (mmer != "CA")
    return ~mmer.contains("AA") & ~mmer.startswith("ACA")


def norm(mmer: Column, m: int) -> Column:
    """The smaller allowed one of an m-mer and its reverse complement, DEFAULT if neither is."""
    rc = reverse_complement(mmer)
    return F.least(F.when(is_allowed(mmer, m), mmer).otherwise(DEFAULT), F.when(is_allowed(rc, m), rc).otherwise(DEFAULT))


def signature_number(signature: Column, m: int) -> Column:
    """The signature in base 4; 4**m for the default one."""
    return F.when(signature == DEFAULT, F.lit(4**m).cast("bigint")).otherwise(pack(signature))


def signature(kmer: Column, k: int, m: int) -> Column:
    """struct(v, p): the least norm of the k-mer's m-mers and the leftmost place that has it.

    Few m-mers are unrolled, which stays within generated code; many would make too large an expression.
    """
    if k - m + 1 > UNROLLED:
        every = F.transform(F.sequence(F.lit(0), F.lit(k - m)), lambda j: F.struct(norm(F.substring(kmer, j + 1, F.lit(m)), m).alias("v"), j.cast("int").alias("p")))
        return F.array_min(every)
    terms = [F.struct(norm(F.substring(kmer, j + 1, m), m).alias("v"), F.lit(j).alias("p")) for j in range(k - m + 1)]
    return F.least(*terms) if len(terms) > 1 else terms[0]
