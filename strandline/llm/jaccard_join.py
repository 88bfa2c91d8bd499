"""Exact n-gram Jaccard self-join: prefix lists, set-relation skipping, components.

Two sets link when 100 * intersection >= 80 * union, that is 9 * intersection >= 4 * (sum of sizes).

1. Equal sets are one set from here on. A set is known by 128 bits of its shingles (``f1``, ``f2``);
   the smallest row number of its documents is its number (``set``).
2. Shingles are ordered by hash, the most frequent ones last. Frequencies are counted over all
   documents, added up per task before they are sent; how many count as frequent is bounded by
   ``FREQUENT``, so their list can be broadcast at any size of the input.
3. A set enters the index lists of its prefix, the first n - ceil(0.8 n) + 1 shingles: linked sets
   share one of these. Infrequent shingles are dealt to buckets of bounded size, where those of a
   single set are dropped and lists of up to ``SHORT`` entries give their pairs at once.
4. Index skipping: an entry at position i of a set of n shingles can only link with a set of at most
   ``reach`` = (5 n - 9 i) / 4 shingles, which is less than n late in the prefix. Long lists are cut
   into blocks by size class, and an entry is only sent to the blocks between 0.8 n and its
   reach, so that blocks of entries that cannot link by size and position never meet.
5. Answer skipping: in each block of a long list only the entry with the earliest position (the
   one with the fewest shingles of its own, the hub of near copies) is compared with the others,
   and hubs of neighbouring blocks with each other. The others' answers follow from the hub's: sets
   linked to the hub are one class, and a set whose distance to the hub differs by more than 0.2
   from another's cannot link with that one (the Jaccard distance is a metric). Only entries that
   stay outside their list's main class are compared with entries of other classes.
6. Each set has a parity bitmap: the bit of a shingle's hash is set if an odd number of shingles
   have it. Two bitmaps, the longer one folded, differ in at most as many bits as the sets differ
   in shingles, so most pairs that do not link are told apart by a few bytes, without error. The
   others are verified on the full sets, recomputed from the texts of the documents concerned.
   Links give components.

The result is exact but for collisions of hashes: see ``shingles`` for those of shingles; different
sets pass for equal with a probability of 2**-128 a pair.

``linked_pairs`` gives every link between distinct sets, and ``jaccard_links`` their number for each
document. There the hub's answers only decide pairs that they decide for certain: two sets whose
distances to the hub add up to no more than 0.2 link, those whose distances differ by more do
not, and all other pairs of a list are sieved and verified. As many rows are made as there are pairs
to report, which is the square of a group's size; components need none of them.

No list, set of pairs or component is collected on the driver or in one task.

Edge cases: null, empty and blank texts have no shingles and link with nothing, each its own
component; a text of fewer than ``width`` words is one shingle; very long texts are sets like any
other; repeated rows and ties are equal sets and link; a document without an id links like any
other, its null id is kept and gives no component its number; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace, most_frequent, text_of
from strandline.llm.components import connected_components
from strandline.llm.shingles import shingle_sets

WIDTH = 5
#: Most shingles that may be ordered last for their frequency; 8 bytes each are broadcast.
FREQUENT = 1_000_000
#: A shingle of no more sets than this is never called frequent.
RARE = 32
#: Lists up to this length are compared pair by pair.
SHORT = 12
#: Size classes in a factor of 1.25.
CLASSES = 2
BUCKET_ROWS = 400_000
#: Names by which a task leaves out copies that it has met; more of them are only more work.
REMEMBERED = 100_000
BROADCAST_IDS = 1_000_000  # 8 MB
#: The filter of documents to be read again has 16 bits for each, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27

SETS = "rid long, doc_id long, key long, n int, f1 long, f2 long, split int, prefix binary, parity binary"
ENTRY = "h long, f1 long, n int, reach int, g1 long"


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes as two signed numbers."""
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)), dtype="<i8").tolist())


def parity_bitmap(s: np.ndarray) -> bytes:
    """One to two times as many bits as shingles, at least 64, a power of two: the parity of the shingles at each."""
    bits = 1 << max(6, len(s).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that only one of two sets has."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Seen:
    """Remembers a bounded number of names."""

    def __init__(self) -> None:
        self.names: set = set()

    def first(self, name) -> bool:
        """Whether ``name`` has not been remembered before."""
        if name in self.names:
            return False
        if len(self.names) < REMEMBERED:
            self.names.add(name)
        return True


def frequent_shingles(docs: DataFrame, width: int, space: Workspace) -> tuple[int, np.ndarray]:
    """The shingles of more than RARE documents, at most FREQUENT of them (the most frequent), ascending.

    Tasks send the upper bits of their shingles, first those that name a bucket, then 24 more; a
    shingle is frequent if these bits are, which is an order all tasks agree on. (Any order gives
    the same links; it only decides speed.) What a task has met several times it sends once, with the
    number, so a line of all documents is a few bytes per task. There are as many buckets as the input
    needs for a value of these bits to stand for less than one shingle on average. Returned with
    the number of bits dropped.
    """
    bits = min(24, max(6, (2 * docs.rdd.getNumPartitions()).bit_length()))
    buckets = 1 << bits

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate(held) >> np.uint64(40 - bits)
        key.sort()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.flatnonzero(new)
        n, key = np.diff(np.append(at, len(key))), key[at]
        cuts = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24))
        low = (key & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)
        full = np.flatnonzero(np.diff(cuts))
        once, often = [], []
        for b in full:
            part, m = low[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]]
            once.append(part[m == 1, :3].tobytes())
            often.append(np.hstack([part[m > 1], m[m > 1].astype("<u4").view(np.uint8).reshape(-1, 4)]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(once, pa.binary()), pa.array(often, pa.binary())], ["bucket", "once", "often"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, Seen()
        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if len(s) and seen.first(fingerprint(s)):  # copies met by the same task count once
                    held.append(s)
                    size += len(s)
                if size > 1_000_000:
                    yield sent(held)
                    held, size = [], 0
        if held:
            yield sent(held)

    def count(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        once = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint8) for x in group.column("once")]).reshape(-1, 3)
        often = np.concatenate([np.frombuffer(x.as_buffer(), dtype="<u4") for x in group.column("often")]).reshape(-1, 2)
        value = np.concatenate([np.ascontiguousarray(np.pad(once, ((0, 0), (0, 1)))).view("<u4")[:, 0], often[:, 0]])
        value, at = np.unique(value, return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([np.ones(len(once)), often[:, 1]]), minlength=len(value)).astype(np.int64)
        much = n > RARE
        return pa.table({"key": (bucket << 24) | value[much].astype(np.int64), "n": n[much]})

    found = docs.select(text_of().alias("text")).mapInArrow(split, "bucket int, once binary, often binary").groupBy("bucket").applyInArrow(count, "key long, n long")
    found = space.save(found, "frequent")
    keys = most_frequent(found, FREQUENT).select("key").toPandas()["key"].to_numpy(dtype=np.int64, copy=True)
    space.drop("frequent")
    keys.sort()
    return 40 - bits, keys


def ordered_prefix(s: np.ndarray, dropped: int, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of an ascending set with its frequent shingles last; how many of it are not frequent."""
    n = prefix_length(len(s))
    if not len(frequent):
        return s[:n], n
    rare: list[np.ndarray] = []
    often: list[np.ndarray] = []
    have, at = 0, 0
    while have < n and at < len(s):  # looks no further than it must
        part = s[at : at + n - have + 16]
        at += len(part)
        key = (part >> np.uint64(dropped)).astype(np.int64)
        place = np.searchsorted(frequent, key)
        hit = frequent[np.minimum(place, len(frequent) - 1)] == key
        rare.append(part[~hit])
        often.append(part[hit])
        have += len(rare[-1])
    head = np.concatenate(rare)[:n]
    return np.concatenate([head, np.concatenate(often)[: n - len(head)]]), len(head)


def keyed(docs: DataFrame, id_col: str) -> DataFrame:
    """doc_id, text and a key of both, by which a row is found again."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def prefixes(docs: DataFrame, frequent, width: int, id_col: str) -> DataFrame:
    """One row per document: its number, size, fingerprint, prefix and bitmap. ``frequent`` is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for a in range(0, whole.num_rows, 2_000):
                batch = whole.slice(a, 2_000)
                n, f, split, prefix, parity = [], [], [], [], []
                for s in shingle_sets(batch.column(1), width):
                    head, rare = ordered_prefix(s, *frequent.value) if len(s) else (s, 0)
                    n.append(len(s))
                    f.append(fingerprint(s) if len(s) else (None, None))
                    split.append(rare)
                    prefix.append(head.tobytes())
                    parity.append(parity_bitmap(s))
                rid = pa.array(np.arange(row, row + batch.num_rows))
                row += batch.num_rows
                columns = [rid, batch.column(0), batch.column(2), pa.array(n, pa.int32()), *(pa.array([x[k] for x in f], pa.int64()) for k in (0, 1)), pa.array(split, pa.int32()), pa.array(prefix, pa.binary()), pa.array(parity, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SETS.split(", ")])

    return keyed(docs, id_col).mapInArrow(run, SETS)


def reach_of(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The most shingles of a set that can link with one of ``n``, if their first common shingle stands at ``pos`` of it."""
    return (5 * n.astype(np.int64) - 9 * pos) // 4


_KIND = np.dtype([("h", "<u8"), ("f1", "<i8"), ("n", "<i4"), ("reach", "<i4")])


def entry_table(rows: np.ndarray, partner: np.ndarray | None = None) -> pa.Table:
    other = pa.nulls(len(rows), pa.int64()) if partner is None else pa.array(partner)
    return pa.table({"h": rows["h"].astype(np.int64), "f1": rows["f1"].copy(), "n": rows["n"].copy(), "reach": rows["reach"].copy(), "g1": other})


def own_entries(f1: int, n: int, prefix: bytes, low: int, high: int) -> np.ndarray:
    """The entries of a set from position ``low`` to ``high`` of its prefix."""
    rows = np.empty(high - low, dtype=_KIND)
    rows["h"], rows["f1"], rows["n"] = np.frombuffer(prefix, dtype="<u8")[low:high], f1, n
    rows["reach"] = reach_of(rows["n"], np.arange(low, high))
    return rows


def shared_entries(rows: np.ndarray, short: int) -> pa.Table:
    """Of a bucket's entries, those of long lists, and the pairs of lists of up to ``short`` entries (``g1``: the partner)."""
    rows = rows[np.lexsort((rows["f1"], rows["h"]))]
    rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])]  # a set that two tasks sent
    start = np.flatnonzero(np.concatenate([[True], rows["h"][1:] != rows["h"][:-1]]))
    length = np.repeat(np.diff(np.append(start, len(rows))), np.diff(np.append(start, len(rows))))
    few = rows[(length > 1) & (length <= short)]
    made = [entry_table(rows[length > max(1, short)])]
    for d in range(1, min(short, len(few))):
        x, y = few[:-d], few[d:]
        at = np.flatnonzero((x["h"] == y["h"]) & (y["n"] <= x["reach"]) & (x["n"] <= y["reach"]))
        made.append(entry_table(x[at], y["f1"][at]))
    return pa.concat_tables(made)


def index_entries(sets: DataFrame) -> DataFrame:
    """(h, f1, n, reach, g1): entries of long lists, and with g1 the pairs of short ones."""
    rare = sets.where("n > 0").agg(F.sum("split")).first()[0] or 0
    buckets, short = int(rare) // BUCKET_ROWS + 1, SHORT

    def frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            out = [np.empty(0, dtype=_KIND)]
            for f1, f2, n, split, prefix in zip(*(c.to_pylist() for c in batch.columns)):
                if seen.first((f1, f2)):
                    out.append(own_entries(f1, n, prefix, split, len(prefix) // 8))
            yield from entry_table(np.concatenate(out)).to_batches()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, Seen()

        def sent() -> pa.RecordBatch:
            rows = np.concatenate(held)
            to = (rows["h"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rows, cuts = rows[order], np.searchsorted(to[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([rows[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())], ["bucket", "rows"])

        for batch in batches:
            for f1, f2, n, split, prefix in zip(*(c.to_pylist() for c in batch.columns)):
                if split and seen.first((f1, f2)):
                    held.append(own_entries(f1, n, prefix, 0, split))
                    size += split
                if size > 400_000:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    def shared(group: pa.Table) -> pa.Table:
        return shared_entries(np.concatenate([np.frombuffer(x.as_buffer(), dtype=_KIND) for x in group.column("rows")]), short)

    some = sets.where("n > 0").select("f1", "f2", "n", "split", "prefix")
    infrequent = some.mapInArrow(deal, "bucket int, rows binary").groupBy("bucket").applyInArrow(shared, ENTRY)
    frequent = some.where(F.octet_length("prefix") > 8 * F.col("split")).mapInArrow(frequent_part, ENTRY)
    return infrequent.unionByName(frequent.distinct())


def size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * CLASSES / F.log(F.lit(1.25)) + 1e-9).cast("int")


def partner_classes() -> Column:
    """The size classes in which an entry can find a partner; none late in a prefix, where the set itself is too large."""
    least, most = size_class(F.ceil(F.col("n") * 4 / 5)), size_class(F.col("reach"))
    return F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))


def viable(a: str, b: str) -> Column:
    """Whether sets that share a shingle at these positions can share enough: what is left behind it suffices."""
    return (F.col(f"{b}n") <= F.col(f"{a}reach")) & (F.col(f"{a}n") <= F.col(f"{b}reach"))


def side(entries: DataFrame, name: str) -> DataFrame:
    return entries.select(*[F.col(c) if c == "h" else F.col(c).alias(f"{name}{c}") for c in entries.columns])


def blocks_met(u: DataFrame, m: DataFrame) -> DataFrame:
    """The viable pairs of ``u`` and ``m`` (h, set, n, reach, k and more), whose blocks by size and position meet."""
    u = side(u.withColumn("to", F.explode(partner_classes())), "u_")
    m = side(m.withColumn("to", F.explode(partner_classes())), "m_").withColumnRenamed("h", "m_h")
    return u.join(m, (F.col("h") == F.col("m_h")) & (F.col("u_k") == F.col("m_to")) & (F.col("u_to") == F.col("m_k"))).where(viable("u_", "m_"))


def candidate_pairs(short_pairs: DataFrame, lists: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs (a, b) of short lists, of the hubs of blocks with their entries, and of hubs of neighbouring blocks."""
    ordered = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    inner = ordered(lists.where(viable("", "hub_")), "set", "hub_set")
    hubs = side(blocks.select("h", "k", F.col("hub_set").alias("set"), F.col("hub_n").alias("n"), F.col("hub_reach").alias("reach")), "x_")
    others = blocks.select("h", F.explode(F.array(*[F.col("k") - d for d in range(1, CLASSES + 1)])).alias("x_k"), F.col("hub_set").alias("y_set"), F.col("hub_n").alias("y_n"), F.col("hub_reach").alias("y_reach"))
    outer = ordered(hubs.join(others, ["h", "x_k"]).where(viable("x_", "y_")), "x_set", "y_set")
    return short_pairs.unionByName(inner).unionByName(outer).distinct()


def row_filter(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap of the long column ``key``: its size follows their number up to MOST_BITS, beyond which more rows pass it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * count).bit_length()))
    bit = F.pmod("key", F.lit(bits))
    words = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {bits}) & 63 as int))")).alias("set"))
    found = words.toPandas()
    made = np.zeros(bits // 64, dtype=np.int64)
    made[found["word"].to_numpy()] = found["set"].to_numpy()
    return made.view(np.uint8)


def has_key(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether keys pass the bitmap of ``row_filter``."""
    bit = key % (8 * len(bits))
    return bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str) -> DataFrame:
    """(set, hashes) of the sets in ``wanted`` (set, key, f1, f2), recomputed from the text of one document each.

    A filter made of all wanted keys keeps most other texts from being hashed; the fingerprint decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(row_filter(wanted.select("key"), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["f1", "f2", "hashes"])

        for batch in batches:
            rows, held = [], 0
            some = np.flatnonzero(has_key(shared.value, np.asarray(batch.column(1))))
            for s in shingle_sets(batch.column(0).take(pa.array(some)), width):
                if len(s) and seen.first(f := fingerprint(s)):
                    rows.append((*f, s.tobytes()))
                    held += len(s)
                if held > 500_000:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    found = keyed(docs, id_col).select("text", "key").mapInArrow(run, "f1 long, f2 long, hashes binary")
    return found.join(wanted.select("set", "f1", "f2"), ["f1", "f2"]).select("set", "hashes").dropDuplicates(["set"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes na, nb and the size of the intersection, both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, both = [], [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                na.append(len(p))
                nb.append(len(q))
                both.append(int((large[at] == small).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in (na, nb, both))], ["a", "b", "na", "nb", "both"])

    left = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a")
    rows = left.join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return rows.mapInArrow(run, "a long, b long, na long, nb long, both long")


def sieved(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sum of the sizes and a lower bound of the difference, from the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [least_difference(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(low, pa.int64())], ["a", "b", "total", "least"])

    of = lambda name: names.select(F.col("set").alias(name), F.col("n").alias(f"{name}_n"), F.col("parity").alias(f"{name}_parity"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b")
    return rows.select("a", "b", (F.col("a_n") + F.col("b_n")).cast("long").alias("total"), "a_parity", "b_parity").mapInArrow(run, "a long, b long, total long, least long")


LINKED = "9 * both >= 4 * (na + nb)"
#: The same said of the number of shingles that only one of both has, with a lower bound of it.
MAY_LINK = "9 * least <= total"


class Index:
    """The tables that both kinds of answers start from, each in the workspace.

    ids: a row per document. names: a row per distinct set. pairs: of short lists and hubs. lists: the
    entries of long lists, with the hub of their block. mains: the hub of the largest block of a list.
    """

    def __init__(self, docs: DataFrame, width: int, id_col: str, space: Workspace):
        self.docs, self.width, self.id_col, self.space = docs, width, id_col, space
        frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width, space))
        sets = space.save(prefixes(docs, frequent, width, id_col), "sets")
        frequent.unpersist()
        self.ids = space.save(sets.select("doc_id", "n", "f1", "f2"), "ids")
        by_set = sets.where("n > 0").groupBy("f1", "f2")
        self.names = space.save(by_set.agg(F.min("rid").alias("set"), F.min("doc_id").alias("doc_id"), F.min_by("key", "rid").alias("key"), F.first("n").alias("n"), F.first("parity").alias("parity")), "names")
        entries = space.save(index_entries(sets), "entries")
        space.drop("sets")
        number = self.names.select("f1", "set")
        found = entries.where("g1 is not null").select("f1", "g1").distinct().join(number, "f1")
        found = found.select(F.col("set").alias("x"), F.col("g1").alias("f1")).join(number, "f1").where("x <> set")
        short_pairs = found.select(F.least("x", "set").alias("a"), F.greatest("x", "set").alias("b"))
        long = entries.where("g1 is null").join(number, "f1").select("h", "set", "n", "reach", size_class(F.col("n")).alias("k"))
        hub = F.min(F.struct((-F.col("reach") / F.col("n")).alias("late"), "n", "reach", "set"))
        blocks = long.groupBy("h", "k").agg(F.count("*").alias("len"), hub.alias("hub")).select("h", "k", "len", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("set", "n", "reach")])
        blocks = space.save(blocks, "blocks")
        self.mains = blocks.groupBy("h").agg(F.max(F.struct("len", "hub_set")).alias("m"), F.sum("len").alias("len")).where("len > 1").select("h", F.col("m.hub_set").alias("main"))
        self.lists = space.save(long.join(blocks.drop("len"), ["h", "k"]), "lists")
        self.pairs = space.save(candidate_pairs(short_pairs, self.lists, blocks), "pairs")
        space.drop("entries")

    def answers(self, some: DataFrame, name: str) -> DataFrame:
        """(a, b, linked, low, high): whether they link, and bounds of their distance (both the same if verified)."""
        space, names = self.space, self.names
        passed = space.save(sieved(some, names), f"{name}-sieved")
        maybe = passed.where(MAY_LINK).select("a", "b")
        ends = maybe.select(F.col("a").alias("set")).unionByName(maybe.select(F.col("b").alias("set"))).distinct()
        ends = space.save(ends.join(names.select("set", "key", "f1", "f2"), "set"), f"{name}-ends")
        hashes = space.save(full_sets(self.docs, ends, self.width, self.id_col), f"{name}-hashes")
        exact = overlaps(maybe, hashes).withColumn("d", 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
        exact = space.save(exact.select("a", "b", F.expr(LINKED).alias("linked"), F.col("d").alias("low"), F.col("d").alias("high")), f"{name}-exact")
        space.drop(f"{name}-hashes", f"{name}-ends")
        apart = passed.where(f"not ({MAY_LINK})").select("a", "b", F.lit(False).alias("linked"), (2 * F.col("least") / (F.col("total") + F.col("least"))).alias("low"), F.lit(1.0).alias("high"))
        return exact.unionByName(apart)

    def with_hub_answers(self, first: DataFrame) -> DataFrame:
        """The lists with bounds of each entry's distance to its hub."""
        rows = self.lists.withColumns({"a": F.least("set", "hub_set"), "b": F.greatest("set", "hub_set")}).join(first.select("a", "b", "low", "high"), ["a", "b"], "left")
        bounds = [F.when(F.col("set") == F.col("hub_set"), 0.0).otherwise(F.coalesce(c, F.lit(v))).alias(c) for c, v in (("low", 0.0), ("high", 1.0))]
        return rows.select("h", "set", "n", "reach", "k", *bounds)


#: By the triangle over the hub, entries of one block may link.
MAY_MEET = "(u_k <> m_k or (u_low - m_high <= 0.2 + 1e-9 and m_low - u_high <= 0.2 + 1e-9))"


def open_pairs(index: Index, classes: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs of long lists that may link and whose classes are not yet one: an entry outside its list's main class, and any other."""
    of = classes.select(F.col("node").alias("set"), F.col("component").alias("class"))
    main = index.mains.join(of.select(F.col("set").alias("main"), F.col("class").alias("main_class")), "main", "left").select("h", F.coalesce("main_class", "main").alias("main_class"))
    rows = index.with_hub_answers(first).join(of, "set", "left").withColumn("class", F.coalesce("class", "set")).join(main, "h")
    rows = rows.withColumn("outside", F.col("class") != F.col("main_class")).drop("main_class")
    rows = index.space.save(rows, "classed")
    some = rows.where("outside").select("h").distinct()
    met = blocks_met(rows.where("outside"), rows.join(some, "h", "left_semi")).where("u_class <> m_class and not (m_outside and u_set > m_set)").where(MAY_MEET)
    return met.select(F.least("u_set", "m_set").alias("a"), F.greatest("u_set", "m_set").alias("b")).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")


def other_pairs(index: Index, first: DataFrame) -> DataFrame:
    """(a, b, sure): pairs of long lists without an answer yet that may link, and whether the hub's answers say so."""
    rows = index.with_hub_answers(first)
    met = blocks_met(rows, rows).where("u_set < m_set").where(MAY_MEET)
    met = met.groupBy(F.col("u_set").alias("a"), F.col("m_set").alias("b")).agg(F.max((F.col("u_k") == F.col("m_k")) & (F.col("u_high") + F.col("m_high") <= 0.2 - 1e-9)).alias("sure"))
    return met.join(first.select("a", "b"), ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    space = space or Workspace(docs.sparkSession, "jaccard")
    index = Index(docs, width, id_col, space)
    first = index.answers(index.pairs, "first")
    links = first.where("linked").select("a", "b")
    # what the hubs' answers leave open
    classes = space.save(connected_components(links, space, "cc1"), "classes")
    left_open = space.save(open_pairs(index, classes, first), "open")
    space.drop("lists", "pairs", "blocks", "classed")
    if left_open.limit(1).count():
        second = index.answers(left_open, "second").where("linked").select("a", "b")
        classes = space.save(connected_components(links.unionByName(second), space, "cc2"), "classes2")
    space.drop("open", *(f"{name}-{part}" for name in ("first", "second") for part in ("sieved", "exact")))

    # a component's number is the smallest document of its sets
    names = index.names
    least = names.join(classes, names["set"] == classes["node"], "left").select("f1", "f2", "doc_id", F.coalesce("component", "set").alias("component"))
    least = space.save(least, "least")
    number = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = space.save(least.join(number, "component").select("f1", "f2", "component_id"), "by_set")
    space.drop("least", "names", "classes", "classes2")
    return index.ids.join(by_set, ["f1", "f2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked(index: Index) -> DataFrame:
    first = index.answers(index.pairs, "first")
    rest = index.space.save(other_pairs(index, first), "rest")
    second = index.answers(rest.where("not sure").select("a", "b"), "second")
    return first.where("linked").select("a", "b").unionByName(second.where("linked").select("a", "b")).unionByName(rest.where("sure").select("a", "b"))


def linked_pairs(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """(a, b) for every two distinct sets that link, by number, a below b."""
    return _linked(Index(docs, width, id_col, space or Workspace(docs.sparkSession, "jaccard-links")))


def jaccard_links(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", space: Workspace | None = None) -> DataFrame:
    """doc_id, n_links for every row of ``docs``: how many other rows its set links with."""
    space = space or Workspace(docs.sparkSession, "jaccard-links")
    index = Index(docs, width, id_col, space)
    pairs = space.save(_linked(index), "links")
    copies = index.ids.where("n > 0").groupBy("f1", "f2").agg(F.count("*").alias("copies")).join(index.names.select("f1", "f2", "set"), ["f1", "f2"])
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("set")).unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("set")))
    near = both.join(copies, "set").groupBy(F.col("of").alias("set")).agg(F.sum("copies").alias("near"))
    by_set = copies.join(near, "set", "left").select("f1", "f2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return index.ids.join(by_set, ["f1", "f2"], "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one document (the smallest id) of each component, columns unchanged.

    Of rows with the same id all stay or go; rows without an id stay. At most BROADCAST_IDS ids are
    broadcast. If more are to go, a filter of them at the scan lets most other rows pass, and only the rest,
    not the whole corpus, is shuffled to be compared with the ids themselves.
    """
    space = Workspace(docs.sparkSession, "jaccard")
    gone = jaccard_components(docs, width, space=space).where("doc_id <> component_id").select("doc_id").distinct()
    gone = space.save(gone, "gone")
    space.drop("ids", "by_set")
    if (many := gone.count()) <= BROADCAST_IDS:
        return docs.join(F.broadcast(gone), "doc_id", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(row_filter(gone.select(F.xxhash64("doc_id").alias("key")), many))

    @F.pandas_udf("boolean")
    def may_go(key: pd.Series) -> pd.Series:
        return pd.Series(has_key(shared.value, key.to_numpy()))

    key = F.xxhash64(F.col("doc_id").cast("long"))
    rest = docs.where(may_go(key)).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return docs.where(~may_go(key)).unionByName(rest)
