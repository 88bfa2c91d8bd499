"""Scalar functions on bases and k-mers, as column expressions.

Only upper-case A, C, G and T are bases; anything else breaks a k-mer. Strings are compared by
bytes, which for bases is the order A < C < G < T.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS, DIGITS = "ACGT", "TGCA", "0123"
#: Bases that fit a 62-bit integer.
PER_WORD = 31


def strip_line_ends(seq: Column) -> Column:
    return F.regexp_replace(seq, "[\r\n]", "")


def complement(seq: Column) -> Column:
    """Base by base; other characters stay."""
    return F.translate(seq, BASES, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def orientation(kmer: Column) -> Column:
    """0 if the k-mer is smaller than its reverse complement, 1 if it is larger or a palindrome."""
    return F.when(kmer < reverse_complement(kmer), 0).otherwise(1)


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def is_valid(seq: Column) -> Column:
    return ~seq.rlike("[^ACGT]")


def first_invalid(seq: Column) -> Column:
    """Place of the first character that is no base, -1 if there is none."""
    return F.instr(F.regexp_replace(seq, "[^ACGT]", "N"), "N") - 1


def last_invalid(seq: Column) -> Column:
    at = F.instr(F.reverse(F.regexp_replace(seq, "[^ACGT]", "N")), "N")
    return F.when(at == 0, -1).otherwise(F.length(seq) - at)


def pack(kmer: Column) -> Column:
    """The k-mer (31 bases at most) as a number in base 4."""
    return F.conv(F.translate(kmer, BASES, DIGITS), 4, 10).cast("bigint")


def pack_words(kmer: Column) -> Column:
    """A k-mer of any length as numbers of 31 bases each, the last of what is left."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(kmer) - 1, F.lit(0)), F.lit(PER_WORD))
    return F.transform(starts, lambda s: pack(F.substring(kmer, s + 1, F.lit(PER_WORD))))


def unpack(value: Column, length: int) -> Column:
    """The inverse of ``pack`` for a k-mer of ``length`` bases."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), length, "0"), DIGITS, BASES)


def base_at(kmer: Column, pos: Column | int) -> Column:
    """The base at a place counted from 0; null outside."""
    base = F.substring(kmer, pos + 1 if isinstance(pos, Column) else F.lit(pos + 1), F.lit(1))
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.when((pos >= 0) & (pos < F.length(kmer)), base)


def first_m(kmer: Column, m: int) -> Column:
    return F.left(kmer, F.lit(m))


def last_m(kmer: Column, m: int) -> Column:
    return F.right(kmer, F.lit(m))


def ones_mask(n: Column | int) -> Column:
    """A number whose ``n`` lowest bits are set."""
    return F.expr(f"shiftleft(1L, {n}) - 1") if isinstance(n, int) else F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1


def orientations_to_number(orientations: Column) -> Column:
    """Bits of an array of orientations, the first one lowest."""
    return F.aggregate(F.reverse(orientations), F.lit(0).cast("bigint"), lambda a, v: a * 2 + v.cast("bigint"))


def bin_of(signature: Column, bins: int) -> Column:
    """The bin of a signature number: Thomas Wang's public 32-bit integer mix, modulo ``bins``.

    The mix works on 64-bit numbers cut to 32 bits, as 32-bit products would overflow.
    """
    cut = F.lit(0xFFFFFFFF)
    s = signature.cast("bigint")
    # fixed values: the constants of the mix
    v = s.bitwiseXOR(F.lit(61)).bitwiseXOR(F.shiftright(s, 16))
    v = (v * 9).bitwiseAND(cut)
    v = v.bitwiseXOR(F.shiftright(v, 4))
    v = (v * 0x27D4EB2D).bitwiseAND(cut)
    v = v.bitwiseXOR(F.shiftright(v, 15))
    return (v.bitwiseAND(F.lit(0x7FFFFFFF)) % bins).cast("int")
