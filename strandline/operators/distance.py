"""Distances between sequences from their k-mer counts, and the registry of measures.

A measure folds a partial value over k-mers. The pairs of a k-mer's sequences are added up before
anything is shuffled by pair; pairs without a common k-mer come from the grid of sequences.

Where a measure is a sum of products f(p) g(q), as all that come with this package are, k-mers are
grouped once with their sequences' values and each task adds up a matrix of sequences by sequences,
by matrix products for k-mers of many sequences. Beyond MOST_TAGS sequences the matrix is cut into tiles of
TILE by TILE: a k-mer goes to the tiles that its sequences fall into, each with those of its sequences that the
tile needs, and a task holds the matrix of one tile at a time. For other measures k-mers are joined with themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import scratch

#: Sequences up to which a task holds a matrix of them (two of 32 MB).
MOST_TAGS = 2_000
#: Sequences of a tile's side.
TILE = 512
#: Sequences of which distances can be asked: the result has a row for each pair of them, and their names go to every task.
MOST_NAMES = 200_000
#: Numbers in a block of k-mers by sequences, or of pairs.
BLOCK_VALUES = 1 << 20


def _same(d: Column, n: Column) -> Column:
    return d


def _any(counts: DataFrame) -> bool:
    return True


@dataclass(frozen=True)
class Measure:
    """``partial(p, q)`` of a k-mer with values p and q, folded by sum (from 0) or product (from 1), then ``finalize``.

    ``alone``: what a k-mer adds that only one of both sequences has; None if nothing. ``finalize(d, n)``
    gets the folded value and the number of k-mers that either sequence has. ``compatible(counts)`` says
    whether the measure can be taken of such counts. ``internal_product``: it needs common k-mers only.
    ``terms``: functions (f, g) of arrays without zeros, if the partial value is the sum of all f(p) g(q).
    """

    name: str
    partial: Callable[[Column, Column], Column]
    symmetric: bool
    fold: str = "sum"
    alone: Callable[[Column], Column] | None = None
    finalize: Callable[[Column, Column], Column] = _same
    compatible: Callable[[DataFrame], bool] = _any
    terms: tuple[tuple[Callable, Callable], ...] = ()

    @property
    def internal_product(self) -> bool:
        return self.alone is None


MEASURES: dict[str, Measure] = {}


def register(measure: Measure) -> Measure:
    MEASURES[measure.name] = measure
    return measure


# (p - q)^2 = p^2 + q^2 - 2pq: the squares are added up per sequence, the product over common k-mers
_PRODUCT = ((lambda p: -2 * p, lambda q: q),)
SQUARED_EUCLIDEAN = register(Measure("squared_euclidean", lambda p, q: -2 * p * q, True, alone=lambda p: p * p, terms=_PRODUCT))
# p log(p / q) = p log p - p log q
KLD_LOG2 = register(Measure("kld_log2", lambda p, q: p * F.log2(p / q), False, terms=((lambda p: p * np.log2(p), np.ones_like), (lambda p: -p, np.log2))))
KLD_LN = register(Measure("kld_ln", lambda p, q: p * F.log(p / q), False, terms=((lambda p: p * np.log(p), np.ones_like), (lambda p: -p, np.log))))
# squares over the number of k-mers that either has
MEAN_SQUARE = register(Measure("mean_square", lambda p, q: -2 * p * q, True, alone=lambda p: p * p, finalize=lambda d, n: F.when(n > 0, d / n).otherwise(0.0), terms=_PRODUCT))


def normalized(counts: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Counts divided by the number of windows, length - k + 1, of each sequence; 0 if that is not positive."""
    lengths = reads.groupBy("seq_tag").agg(F.sum(F.length("seq")).alias("len"))
    windows = F.col("len") - k + 1
    value = F.when((F.col("n") != 0) & (F.col("len") != 0) & (windows > 0), F.col("n") / windows).otherwise(F.lit(0.0))
    return counts.join(lengths, "seq_tag").select("seq_tag", "kmer", value.alias("n"))


def numbered_tags(counts: DataFrame) -> DataFrame:
    """(t, seq_tag): the sequences numbered in order of name, known once.

    The result has a row per pair of them, so their names are few enough for the driver.
    """
    names = sorted(r["seq_tag"] for r in counts.where("seq_tag is not null").select("seq_tag").distinct().limit(MOST_NAMES + 1).collect())
    if len(names) > MOST_NAMES:
        raise ValueError(f"distances of more than {MOST_NAMES} sequences would be more than {MOST_NAMES**2 // 2} rows")
    return counts.sparkSession.createDataFrame(list(enumerate(names)), "t int, seq_tag string")


def pair_grid(tags: DataFrame, symmetric: bool) -> DataFrame:
    """(t1, t2) of all sequences; the result itself has a row for each."""
    one = tags.agg(F.array_sort(F.collect_list("t")).alias("all")).select("all", F.explode("all").alias("t1"))
    if tags.count() > MOST_TAGS:
        one = one.repartition("t1")
    return one.select("t1", F.explode(F.filter("all", lambda t: t > F.col("t1") if symmetric else t != F.col("t1"))).alias("t2"))


def joined_pairs(values: DataFrame, measure: Measure) -> DataFrame:
    """(t1, t2, d, common) of sequences with common k-mers, by a join of (kmer, t, n) with itself."""
    a = values.select("kmer", F.col("t").alias("t1"), F.col("n").alias("p"))
    b = values.select("kmer", F.col("t").alias("t2"), F.col("n").alias("q"))
    met = a.join(b, "kmer").where("t1 < t2" if measure.symmetric else "t1 <> t2")
    fold = F.product if measure.fold == "product" else F.sum
    return met.groupBy("t1", "t2").agg(fold(measure.partial(F.col("p"), F.col("q"))).alias("d"), F.count("*").alias("common"))


class PairSums:
    """Sums over k-mers of a measure's terms for every two of some sequences, and the number of k-mers that both have."""

    def __init__(self, measure: Measure, tags: int):
        self.tags, self.symmetric = tags, measure.symmetric
        self.terms = (*measure.terms, (np.ones_like, np.ones_like))  # the last one counts
        self.total = np.zeros((2, tags, tags))

    def add(self, t: np.ndarray, n: np.ndarray, first: np.ndarray) -> None:
        """Add the pairs of k-mers whose sequences begin at ``first``."""
        have = np.diff(np.append(first, len(t)))
        for size in np.unique(have[have > 1]).tolist():
            many = first[have == size]
            dense = 4 * size >= self.tags
            step = max(1, BLOCK_VALUES // (self.tags if dense else size * size))
            for a in range(0, len(many), step):
                at = many[a : a + step, None] + np.arange(size)
                (self._add_dense if dense else self._add_pairs)(t[at], n[at])

    @staticmethod
    def _made(n: np.ndarray, of: Callable) -> np.ndarray:
        """A term's function where there is a value, else 0."""
        out = np.zeros(n.shape)
        out[n != 0] = of(n[n != 0])
        return out

    def _add_dense(self, t: np.ndarray, n: np.ndarray) -> None:
        whole = np.zeros((len(t), self.tags))
        whole[np.arange(len(t))[:, None], t] = n
        for k, (f, g) in enumerate(self.terms):
            self.total[int(k == len(self.terms) - 1)] += self._made(whole, f).T @ self._made(whole, g)

    def _add_pairs(self, t: np.ndarray, n: np.ndarray) -> None:
        pair = (t[:, :, None].astype(np.int64) * self.tags + t[:, None, :]).ravel()
        for k, (f, g) in enumerate(self.terms):
            weight = self._made(n, f)[:, :, None] * self._made(n, g)[:, None, :]
            self.total[int(k == len(self.terms) - 1)] += np.bincount(pair, weights=weight.ravel(), minlength=self.tags * self.tags).reshape(self.tags, self.tags)

    def rows(self, number: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """(t1, t2, d, common) of the pairs with common k-mers, in the sequences' ``number``s."""
        both = np.argwhere((self.total != 0).any(0))
        if wanted is not None:
            both = both[wanted(both[:, 0], both[:, 1])]
        x, y = number[both[:, 0]], number[both[:, 1]]
        both = both[x < y if self.symmetric else x != y]
        for a in range(0, len(both), 100_000):
            x, y = both[a : a + 100_000].T
            yield pa.RecordBatch.from_arrays([pa.array(number[x], pa.int32()), pa.array(number[y], pa.int32()), pa.array(self.total[0, x, y]), pa.array(self.total[1, x, y].astype(np.int64))], ["t1", "t2", "d", "common"])


PAIRS = "t1 int, t2 int, d double, common long"


def multiplied_pairs(values: DataFrame, measure: Measure, tags: int) -> DataFrame:
    """(t1, t2, d, common) of sequences with common k-mers, from products of their values."""
    rows = values.repartition("kmer").sortWithinPartitions("kmer").select(F.col("kmer").cast("binary").alias("kmer"), "t", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(measure, tags)
        last, held_t, held_n = None, np.zeros(0, dtype=np.int32), np.zeros(0)  # the k-mer that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            kmer = batch.column(0)
            new = np.concatenate([[kmer[0].as_py() != last], ~np.asarray(pc.equal(kmer[1:], kmer[:-1]))])
            t, n = np.concatenate([held_t, np.asarray(batch.column(1))]), np.concatenate([held_n, np.asarray(batch.column(2))])
            first = np.flatnonzero(np.concatenate([np.zeros(len(held_t), dtype=bool), new]))
            first = first if not len(held_t) else np.concatenate([[0], first])
            sums.add(t[: first[-1]], n[: first[-1]], first[:-1])
            last, held_t, held_n = kmer[-1].as_py(), t[first[-1] :], n[first[-1] :]
        if len(held_t):
            sums.add(held_t, held_n, np.zeros(1, dtype=np.int64))
        yield from sums.rows(np.arange(tags))

    found = rows.mapInArrow(run, PAIRS)
    return found.groupBy("t1", "t2").agg(F.sum("d").alias("d"), F.sum("common").alias("common"))


def tiled_pairs(values: DataFrame, measure: Measure, tags: int, tile: int | None = None) -> DataFrame:
    """As ``multiplied_pairs``, for any number of sequences: a tile of the matrix, or a part of its k-mers, is one task's work.

    A tile is known by two blocks of sequences. A k-mer's list is as long as it has sequences, and it is sent
    to as many tiles as it has pairs of blocks. Tiles get so many parts that their sums are no more rows than their k-mers.
    """
    tile = tile or TILE
    blocks = -(-tags // tile)
    parts = max(1, min(1 << 10, values.count() // (blocks * tile * tile)))
    block = lambda x: F.floor(x["t"] / tile).cast("int")
    lists = values.groupBy("kmer").agg(F.collect_list(F.struct("t", "n")).alias("all")).where(F.size("all") > 1)
    lists = lists.select(F.pmod(F.xxhash64("kmer"), F.lit(parts)).alias("part"), "all", F.array_sort(F.array_distinct(F.transform("all", block))).alias("in"))
    pairs = F.flatten(F.transform("in", lambda i: F.transform(F.filter("in", lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    sent = lists.select("part", "all", F.explode(pairs).alias("p")).select("part", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.filter("all", lambda x: (block(x) == F.col("p.i")) | (block(x) == F.col("p.j"))).alias("m"))
    sent = sent.where(F.size("m") > 1).select("i", "j", "part", F.transform("m", lambda x: x["t"]).alias("t"), F.transform("m", lambda x: x["n"]).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done() -> Iterator[pa.RecordBatch]:
            i, j = now
            number = np.concatenate([np.arange(i * tile, (i + 1) * tile), *([np.arange(j * tile, (j + 1) * tile)] if j != i else [])])
            # pairs within a block are those of its own tile
            yield from sums.rows(number, None if i == j else lambda x, y: (x < tile) != (y < tile))

        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [len(i)]])
            for a, b in zip(edge[:-1], edge[1:]):
                if a == b:
                    continue
                if now != (i[a], j[a]):
                    if now is not None:
                        yield from done()
                    now = (i[a], j[a])
                    sums = PairSums(measure, tile * (1 + int(i[a] != j[a])))
                lists = batch.column(3).slice(a, b - a)
                t, n = lists.flatten().to_numpy(), batch.column(4).slice(a, b - a).flatten().to_numpy()
                size = pc.list_value_length(lists).to_numpy()
                sums.add(np.where(t // tile == now[0], t - now[0] * tile, t - now[1] * tile + tile), n, np.cumsum(size) - size)
        if now is not None:
            yield from done()

    dealt = sent.repartition("i", "j", "part").sortWithinPartitions("i", "j")
    return dealt.mapInArrow(run, PAIRS).groupBy("t1", "t2").agg(F.sum("d").alias("d"), F.sum("common").alias("common"))


def distances(counts: DataFrame, measure: Measure | str = "squared_euclidean", most_tags: int | None = None, tile: int | None = None) -> DataFrame:
    """(s1, s2, distance) from (seq_tag, kmer, n); s1 < s2 for a symmetric measure, both directions otherwise.

    Sequences go by number from here on, so keys and groups are of fixed width. The counts are written to
    the shared folder, as they are read several times and counting is dear.
    """
    measure = MEASURES[measure] if isinstance(measure, str) else measure
    if not measure.compatible(counts):
        raise ValueError(f"{measure.name} cannot be taken of these counts")
    path = scratch(counts.sparkSession, "counts")
    counts.select("seq_tag", "kmer", "n").write.parquet(path)
    counts = counts.sparkSession.read.parquet(path)
    tags = numbered_tags(counts)
    many = tags.count()
    values = counts.join(F.broadcast(tags), "seq_tag").select("kmer", "t", F.col("n").cast("double").alias("n"))
    if measure.terms and measure.fold == "sum":
        met = multiplied_pairs(values, measure, many) if many <= (MOST_TAGS if most_tags is None else most_tags) else tiled_pairs(values, measure, many, tile)
    else:
        met = joined_pairs(values, measure)
    start = 1.0 if measure.fold == "product" else 0.0
    grid = pair_grid(tags, measure.symmetric).join(met, ["t1", "t2"], "left").withColumns({"d": F.coalesce("d", F.lit(start)), "common": F.coalesce("common", F.lit(0))})
    alone = measure.alone or (lambda p: F.lit(0.0))
    if measure.alone is not None or measure.finalize is not _same:
        own = values.groupBy("t").agg(F.sum(alone(F.col("n"))).alias("own"), F.count("*").alias("have"))
        for i in "12":
            grid = grid.join(own.select(F.col("t").alias(f"t{i}"), F.col("own").alias(f"o{i}"), F.col("have").alias(f"h{i}")), f"t{i}")
        d = F.col("d") + F.col("o1") + F.col("o2") if measure.alone is not None else F.col("d")
        grid = grid.withColumns({"d": d, "common": F.col("h1") + F.col("h2") - F.col("common")})
    names = lambda t, s: F.broadcast(tags.select(F.col("t").alias(t), F.col("seq_tag").alias(s)))
    return grid.join(names("t1", "s1"), "t1").join(names("t2", "s2"), "t2").select("s1", "s2", measure.finalize(F.col("d"), F.col("common")).alias("distance"))
