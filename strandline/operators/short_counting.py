"""Counting short k-mers where the read is: tasks add up numbers, and send each distinct one once.

There are fewer short k-mers than places in a task's reads. A task makes the canonical numbers of many reads at once and adds
them up, by tag too if that is asked for. Where there is room for a place for each possible k-mer, of all reads or of each of the
first tags, it counts there and gives each distinct k-mer on once, at its end. Other numbers are put in order and added to the
sums that it holds, which it gives on when they are many. So a task never holds more than a bounded number of sums; those of all
tasks are added up behind one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import packed
from strandline.operators.minimizers import BLOCK, bad_windows, codes_of, windows_of
from strandline.runtime import dealt

#: Bases of a k-mer that leave bits for the number of its tag.
MOST_BASES = 24
#: k-mers that are put in order together; distinct ones, and tags, that a task holds before it gives them on.
AT_ONCE, HELD, HELD_TAGS = 1 << 22, 1 << 22, 1 << 14
#: Bytes of the places of possible k-mers, four for each; k-mers that wait to be counted there; and that places hold before they are given on.
PLACES, WAITING, FULL = 192 << 20, 1 << 24, 1 << 31
#: Tags that have places at most, of which a batch of reads is taken one by one.
PLACED_TAGS = 64
#: Rows given on together.
ROWS = 1 << 17


class Sums:
    """How often each number was met; numbers are in order."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size >= AT_ONCE:
            self.settle()

    def settle(self) -> None:
        key = np.concatenate([np.zeros(0, dtype=np.int64), *self.waiting])
        self.waiting, self.size = [], 0
        if not len(key):
            return
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(np.append(first, len(key))), key[first]
        at = np.searchsorted(self.key, key)
        known = np.append(self.key, -1)[at] == key
        self.n[at[known]] += n[known]
        self.key, self.n = np.insert(self.key, at[~known], key[~known]), np.insert(self.n, at[~known], n[~known])


class Places:
    """How often each k-mer was met, at a place for each possible one.

    Canonical k-mers of odd length are named by that strand whose middle base is A or C, so one bit less tells them apart.
    """

    def __init__(self, k: int, canonical: bool) -> None:
        self.k, self.halved = k, canonical and k % 2 == 1
        self.n = np.zeros(self.many(k, canonical), dtype=np.uint32)
        self.waiting: list[np.ndarray] = []

    @staticmethod
    def many(k: int, canonical: bool) -> int:
        return 4**k >> (canonical and k % 2 == 1)

    @staticmethod
    def of(codes: np.ndarray, k: int, canonical: bool) -> np.ndarray:
        """The places of the k-mers among some codes."""
        value, valid = windows_of(codes, k), ~bad_windows(codes, k)
        if not canonical:
            return value[valid]
        turned = windows_of(codes, k, turned=True)
        if k % 2 == 0:
            return np.minimum(value, turned)[valid]
        value = np.where(value & 1 << k, turned, value)[valid]  # bit k is the upper one of the middle base
        return value >> k + 1 << k | value & (1 << k) - 1

    def settle(self) -> None:
        if self.waiting:
            self.n += np.bincount(np.concatenate(self.waiting), minlength=len(self.n)).astype(np.uint32)
            self.waiting = []

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers met, and how often."""
        key = np.flatnonzero(self.n)
        n = self.n[key].astype(np.int64)
        if self.halved:
            key = key >> self.k << self.k + 1 | key & (1 << self.k) - 1
            key = np.minimum(key, reversed_numbers(key, self.k))
        return key, n


def reversed_numbers(value: np.ndarray, k: int) -> np.ndarray:
    """The reverse complements of k-mers."""
    out = np.zeros_like(value)
    for j in range(k):
        out = out << 2 | 3 - (value >> 2 * j & 3)
    return out


def canonical_numbers(codes: np.ndarray, k: int, canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The number of each window, of the smaller strand if ``canonical``, and whether it is a k-mer."""
    value = windows_of(codes, k)
    return (np.minimum(value, windows_of(codes, k, turned=True)) if canonical else value), ~bad_windows(codes, k)


def task_sums(reads: DataFrame, k: int, tagged: bool, canonical: bool = True) -> DataFrame:
    """(seq_tag if ``tagged``, hi, n): the k-mers of each task's reads as numbers, added up."""
    if k > MOST_BASES:
        raise ValueError(f"short k-mers have at most {MOST_BASES} bases")
    rows = reads.select(F.encode(F.coalesce("seq", F.lit("")), "utf-8").alias("seq"), *(["seq_tag"] if tagged else []))
    room = min(PLACED_TAGS, PLACES // (4 * Places.many(k, canonical)))

    def made(key: np.ndarray, n: np.ndarray, tags: pa.Array | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*([tags] if tagged else []), pa.array(key), pa.array(n)], [*(["seq_tag"] if tagged else []), "hi", "n"])

    def given(sums: Sums, numbers: dict) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(numbers), pa.string())
        for a in range(0, len(sums.key), ROWS):
            key = sums.key[a : a + ROWS]
            yield made(key & (1 << 2 * k) - 1, sums.n[a : a + ROWS], names.take(pa.array(key >> 2 * k)) if tagged else None)

    def given_places(placed: dict[str | None, Places]) -> Iterator[pa.RecordBatch]:
        for tag, places in placed.items():
            places.settle()
            key, n = places.found()
            for a in range(0, len(key), ROWS):
                yield made(key[a : a + ROWS], n[a : a + ROWS], pa.repeat(pa.scalar(tag, pa.string()), len(key[a : a + ROWS])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = Sums(), {}  # the tags met that have no places, numbered
        placed: dict[str | None, Places] = {}  # by tag; all reads have one if tags don't count
        waiting = held = 0
        for batch in batches:
            seqs, of = batch.column(0).to_pylist(), batch.column(1).to_pylist() if tagged else [None] * batch.num_rows
            together: dict[str | None, list[bytes]] = {}
            for s, t in zip(seqs, of):
                if t not in placed and len(placed) < room:
                    placed[t] = Places(k, canonical)
                if t in placed:
                    together.setdefault(t, []).append(s)
            for t, some in together.items():
                seq = b"N".join(some)  # no k-mer reaches over the end of a read
                for a in range(0, len(seq) - k + 1, BLOCK):
                    key = Places.of(codes_of(seq[a : a + BLOCK + k - 1]), k, canonical)
                    placed[t].waiting.append(key)
                    waiting, held = waiting + len(key), held + len(key)
                    if waiting >= WAITING:
                        for places in placed.values():
                            places.settle()
                        waiting = 0
            if held >= FULL:
                yield from given_places(placed)
                placed, waiting, held = {}, 0, 0
            rest = [(s, t) for s, t in zip(seqs, of) if t not in together]
            if not rest:
                continue
            seqs = [s for s, _ in rest]
            tags = [numbers.setdefault(t, len(numbers)) for _, t in rest] if tagged else None
            seq = b"N".join(seqs)
            edge = np.cumsum([0, *(len(s) + 1 for s in seqs)])
            for a in range(0, len(seq) - k + 1, BLOCK):
                key, valid = canonical_numbers(codes_of(seq[a : a + BLOCK + k - 1]), k, canonical)
                key = key.astype(np.int64)
                if tagged:
                    key |= np.repeat(np.array(tags, dtype=np.int64) << 2 * k, np.diff(np.clip(edge, a, a + len(key))))
                sums.add(key[valid])
                if len(sums.key) > HELD:
                    yield from given(sums, numbers)
                    sums = Sums()
            if len(numbers) > HELD_TAGS:
                sums.settle()
                yield from given(sums, numbers)
                sums, numbers = Sums(), {}
        yield from given_places(placed)
        sums.settle()
        yield from given(sums, numbers)

    return rows.mapInArrow(run, "seq_tag string, hi long, n long" if tagged else "hi long, n long")


def short_words(reads: DataFrame, k: int, *keep: str, canonical: bool = True) -> DataFrame:
    """(keep..., hi, n), ``keep`` nothing or the tag: exact counts of k-mers as numbers, also of a stream of reads."""
    sums = task_sums(reads, k, bool(keep), canonical)
    if not reads.isStreaming:  # the sums of a task are all different, so Spark need not add them up before they are sent
        sums = dealt(sums, reads, *keep, "hi")
    return sums.groupBy(*keep, "hi").agg(F.sum("n").alias("n"))


def count_short(reads: DataFrame, k: int, *keep: str, canonical: bool = True) -> DataFrame:
    """(keep..., kmer, n) of ``short_words``."""
    return short_words(reads, k, *keep, canonical=canonical).select(*keep, packed.text([F.col("hi")], k).alias("kmer"), "n")
