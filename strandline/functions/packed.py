"""Bases as numbers: windows, reverse complements and texts of packed k-mers, as column expressions.

A word is a long of 31 bases, 2 bits each, the first base highest. A k-mer of up to 31 bases is one
number, right-aligned; one of up to 62 is a word and a second number of what is left. Numbers of k-mers of one
length are in the order of their texts. All is arithmetic on longs, within generated code.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.bases import BASES, PER_WORD, pack

WORD_BITS = 2 * PER_WORD
LONGEST = 2 * PER_WORD
#: Masks of every other group of 2, 4, 8, 16 and 32 bits.
_HALVES = [(2 * 2**i, int(("0" * (2 * 2**i) + "1" * (2 * 2**i)) * (16 // 2**i), 2)) for i in range(5)]
#: Bases that are decoded together.
_TEXT = 4


def _mask(bases: int) -> Column:
    return F.lit((1 << 2 * bases) - 1).cast("bigint")


def left(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", value, bits if isinstance(bits, Column) else F.lit(bits))


def right(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftrightunsigned", value, bits if isinstance(bits, Column) else F.lit(bits))


def word_at(s: Column, at: Column) -> Column:
    """The word of the bytes ``s`` from ``at`` on (counted from 0); after their end come As."""
    return pack(F.rpad(F.substring(s, at + 1, F.lit(PER_WORD)).cast("string"), PER_WORD, "A"))


def shifted(word: Column, following: Column, r: Column) -> Column:
    """The 31 bases from place ``r`` (0 to 30) of ``word`` on, which run into the ``following`` one."""
    return left(word, 2 * r).bitwiseAND(_mask(PER_WORD)).bitwiseOR(right(following, WORD_BITS - 2 * r))


def window(words: list[Column], r: Column, k: int) -> list[Column]:
    """The k-mer at place ``r`` (0 to 30) of consecutive words, as one or two numbers."""
    first = shifted(words[0], words[1], r)
    if k <= PER_WORD:
        return [right(first, WORD_BITS - 2 * k)]
    return [first, right(shifted(words[1], words[2], r), WORD_BITS - 2 * (k - PER_WORD))]


def reversed_number(value: Column, bases: int) -> Column:
    """The reverse complement of a number of so many bases."""
    value = value.bitwiseXOR(_mask(bases))
    for bits, mask in _HALVES:
        m = F.lit(mask).cast("bigint")
        value = right(value, bits).bitwiseAND(m).bitwiseOR(left(value.bitwiseAND(m), bits))
    return right(value, 64 - 2 * bases)


def reverse_window(reverse: list[Column], r: Column, k: int) -> list[Column]:
    """The reverse complement of the k-mer at place ``r`` of words, from their reverse complements, in the words' order."""

    def low(j: int) -> Column:
        return right(reverse[j], 2 * r).bitwiseOR(left(reverse[j + 1], WORD_BITS - 2 * r))

    if k <= PER_WORD:
        return [low(0).bitwiseAND(_mask(k))]
    rest = k - PER_WORD
    head, tail = low(1).bitwiseAND(_mask(rest)), low(0).bitwiseAND(_mask(PER_WORD))
    return [left(head, WORD_BITS - 2 * rest).bitwiseOR(right(tail, 2 * rest)), tail.bitwiseAND(_mask(rest))]


def smaller(a: list[Column], b: list[Column]) -> list[Column]:
    """The smaller one of two k-mers."""
    if len(a) == 1:
        return [F.least(a[0], b[0])]
    first = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))
    return [F.when(first, x).otherwise(y) for x, y in zip(a, b)]


def text(kmer: list[Column], k: int) -> Column:
    """The bases of a packed k-mer, four at a time from a table."""
    table = F.array(*[F.lit("".join(t)) for t in itertools.product(BASES, repeat=_TEXT)])
    parts = []
    for value, bases in zip(kmer, [k] if k <= PER_WORD else [PER_WORD, k - PER_WORD]):
        for low in range(-(-bases // _TEXT) - 1, -1, -1):
            group = table[right(value, 2 * _TEXT * low).bitwiseAND(F.lit(4**_TEXT - 1)).cast("int")]
            odd = bases - _TEXT * low
            parts.append(F.right(group, F.lit(odd)) if odd < _TEXT else group)
    return F.concat(*parts)


def windows_of_words(rows: DataFrame, many: int, k: int, names: list[str], *keep: str, canonical: bool = True) -> DataFrame:
    """(keep..., names...): the k-mers at the places 0 to ``last`` of the words w0, w1... of each row; words are turned once for all of them."""
    words, turned = [F.col(f"w{j}") for j in range(many)], [F.col(f"u{j}") for j in range(many)]
    if canonical:
        rows = rows.select("*", *[reversed_number(w, PER_WORD).alias(f"u{j}") for j, w in enumerate(words)])
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("r"))
    found = window(words, F.col("r"), k)
    if not canonical:
        return each.select(*keep, *[c.alias(name) for c, name in zip(found, names)])
    other = reverse_window(turned, F.col("r"), k)
    each = each.select(*keep, *[c.alias(name) for c, name in zip([*found, *other], [*names, *(f"{name}_" for name in names)])])
    best = smaller([F.col(name) for name in names], [F.col(f"{name}_") for name in names])
    return each.select(*keep, *[c.alias(name) for c, name in zip(best, names)])
