"""Near-duplicate vectors by product quantisation: coarse lists, residual codes, exact rerank.

Fitting uses about FIT_ROWS vectors at most (chosen by a hash); every vector is indexed.

1. Equal vectors are one vector with a multiplicity from here on.
2. k-means centres, at most MOST_LISTS, give coarse lists; a vector's residual to its centre is coded
   by one of 16 centres in each group of DIMS_PER_CODE dimensions.
3. A vector visits the lists whose border is at most DELTA / 2 away. Linked vectors are at most
   DELTA apart, and the distances of two vectors to the border between their lists add up to no
   more than that, so at least one of them visits the list of the other: no link is lost, whatever
   the vectors' spread. Where both do, the pair counts in the list of the higher number. Small
   lists are put in groups of neighbours, and a vector is sent once to each group that it visits. A guest brings its
   components and a bit per list of that group; codes, errors and the bits of all lists stay with the members.
4. In a list a table of inner products with all codes gives each candidate's approximate cosine;
   with the length of the candidate's quantisation error this bounds the true one from above, so
   the sieve loses nothing. What passes is compared exactly in double precision.
5. Large lists, which are groups of their own, are split into blocks and their visitors into chunks, so a group of near copies that
   makes up much of the table is dealt over many tasks of bounded size. A task returns a number of
   links and one edge per vector, never its pairs, and holds a bounded number of them.

Vectors of different lengths never link. Lengths between two powers of two are indexed together,
filled up with zeros, which changes no cosine; there are no more such tables than powers of two.

Edge cases: a vector that is null, zero, or holds null or non-finite components links with
nothing and is its own component; equal rows link with each other, also if they repeat an id; an id
may be repeated with another vector, each row is judged by its own; a null id is kept and links with
nothing; very long vectors are compared like others; cosines that tie with the threshold link, decided
in whole numbers where rounding could decide; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace
from strandline.llm.components import connected_components

THRESHOLD = 0.9
FIT_ROWS = 20_000
LIST_ROWS = 48
MOST_LISTS = 5_000
DIMS_PER_CODE, CODES = 4, 16
#: Members of a group and guests that meet them in one task, at most: what is sent is the rows times the groups, so both are as
#: large as a task's memory allows. Of long vectors there are fewer, so many components of members, but an eighth or a quarter of that at least.
GROUP_ROWS, LEAST_GROUPS = 32_768, 16
BLOCK, CHUNK = 1_024, 65_536
VALUES = 1 << 21
QUERIES = 2_048  # vectors that a task compares with its lists at once
FOLDED = 500_000  # pairs that a task holds at once
SEED = 20_240_602
ROUNDING = 1e-4  # single precision in the tables


def rows_for(dims: int, most: int, least: int, values: int) -> int:
    """Rows of ``dims`` components that hold so many ``values``, between ``least`` and ``most``."""
    return min(most, max(least, values // dims))


def reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether the cosine of two vectors is at least the decimal number ``threshold``, in exact arithmetic."""
    whole = []
    for v in (a, b):
        ratios = [x.as_integer_ratio() for x in v.tolist()]
        scale = max(d for _, d in ratios)  # powers of two
        whole.append([n * (scale // d) for n, d in ratios])
    dot, t = sum(x * y for x, y in zip(*whole)), Fraction(repr(threshold))
    squares = t * t * sum(x * x for x in whole[0]) * sum(y * y for y in whole[1])
    return dot >= 0 and dot * dot >= squares if t > 0 else dot >= 0 or dot * dot <= squares


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the closest centre of each row."""
    half = 0.5 * (centres * centres).sum(1)
    out = np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmax(x[a : a + 4096] @ centres.T - half, axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        to = nearest(x, centres)
        n = np.bincount(to, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, to, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    """Coarse centres and residual codebooks: at most MOST_LISTS centres, so of bounded size."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        self.dims = sample.shape[1]
        self.centres = k_means(sample, lists)
        rest = self._groups(sample - self.centres[nearest(sample, self.centres)])
        self.books = np.stack([self._full(k_means(rest[:, g], CODES)) for g in range(rest.shape[1])])
        self.half = 0.5 * (self.centres**2).sum(1)
        self.reach = math.sqrt(2 - 2 * threshold) / 2 + 1e-9

    @staticmethod
    def _full(centres: np.ndarray) -> np.ndarray:
        return np.vstack([centres, np.repeat(centres[:1], CODES - len(centres), axis=0)])

    def _groups(self, x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % DIMS_PER_CODE
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, DIMS_PER_CODE)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and length of the quantisation error of each row."""
        to = nearest(x, self.centres)
        rest = self._groups(x - self.centres[to])
        codes = np.stack([nearest(rest[:, g], self.books[g]) for g in range(rest.shape[1])], axis=1).astype(np.uint8)
        coded = np.stack([self.books[g][codes[:, g]] for g in range(rest.shape[1])], axis=1)
        return to, codes, np.sqrt(((rest - coded) ** 2).sum((1, 2)))

    def visits(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A bit per list and row: whether the border between the row's own list and that one is within reach."""
        c, half, out = self.centres, self.half, []
        for a in range(0, len(x), 1024):
            score, mine = x[a : a + 1024] @ c.T - half, own[a : a + 1024]
            behind = score[np.arange(len(mine)), mine][:, None] - score  # distance to the border times the centres' distance
            lists, which = np.unique(mine, return_inverse=True)
            gap = np.sqrt(np.maximum(2 * half[lists, None] + 2 * half[None, :] - 2 * c[lists] @ c.T, 0))
            near = behind <= self.reach * gap[which] + 1e-12
            near[np.arange(len(mine)), mine] = False
            out.append(np.packbits(near, axis=1, bitorder="little"))
        return np.concatenate(out)

    def groups(self, size: dict[int, int]) -> np.ndarray:
        """A group for each list: neighbours together while small, a list of over BLOCK rows alone."""
        room = min(rows_for(self.dims, GROUP_ROWS, GROUP_ROWS // 8, VALUES), sum(size.values()) // LEAST_GROUPS)
        coarse = k_means(self.centres, max(1, sum(size.values()) // max(1, room)))
        near = nearest(self.centres, coarse)
        out, group, have = np.zeros(len(self.centres), dtype=np.int64), -1, room + 1
        for c in np.lexsort((np.arange(len(near)), near)):
            n = size.get(int(c), 0)
            if n > BLOCK or have + n > room:
                group, have = group + 1, 0
            out[c] = group
            have += n if n <= BLOCK else room + 1
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of every code with each query, by group of dimensions."""
        return np.einsum("qgd,gcd->gcq", self._groups(q), self.books).astype(np.float32)

    def sieve(self, table: np.ndarray, base: np.ndarray, codes: np.ndarray, error: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs of a list that may reach the threshold. ``base``: the centre's product with each query."""
        near = np.tile(base.astype(np.float32), (len(codes), 1))
        for g in range(len(table)):
            near += table[g][codes[:, g]]  # whole rows: one code's inner products with all queries
        member, query = np.nonzero(near >= (threshold - ROUNDING - error)[:, None])
        return query, member


class ListBits:
    """The bits of all lists put in order of groups, each of which begins with a byte, so that a group's bits are a slice."""

    def __init__(self, group_of: np.ndarray):
        lists = [np.flatnonzero(group_of == g) for g in range(group_of.max() + 1)]
        self.width = np.array([-(-len(x) // 8) for x in lists])
        self.start = np.concatenate([[0], np.cumsum(self.width)])
        self.order = np.full(8 * self.start[-1], len(group_of))  # what fills up is a list that nothing visits
        self.place = np.zeros(len(group_of), dtype=np.int64)
        for a, x in zip(self.start, lists):
            self.order[8 * a : 8 * a + len(x)] = x
            self.place[x] = np.arange(len(x))

    def packed(self, near: np.ndarray) -> np.ndarray:
        return np.packbits(np.pad(near, ((0, 0), (0, 1)))[:, self.order], axis=1, bitorder="little")

    def of(self, row: np.ndarray, group: int) -> bytes:
        """A group's bits of a row of ``packed``."""
        return row[self.start[group] : self.start[group + 1]].tobytes()


def has_bit(bits: np.ndarray, row: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    return (bits[row, at >> 3] >> (at & 7)) & 1 == 1


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number in the component of each of 0..n-1 under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


class Links:
    """Number of links and component of each of n rows, from pairs that come by and by."""

    def __init__(self, many: np.ndarray):
        self.many, self.links, self.label = many, np.zeros(len(many)), np.arange(len(many))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)
        if self.size > FOLDED:
            self.fold()

    def fold(self) -> None:
        if self.size:
            a, b = (np.concatenate(c) for c in zip(*self.held))
            self.links += np.bincount(a, weights=self.many[b], minlength=len(self.many)) + np.bincount(b, weights=self.many[a], minlength=len(self.many))
            self.label = roots(len(self.many), self.label[a], self.label[b])[self.label]
        self.held, self.size = [], 0


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    space = Workspace(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    rows = rows.withColumns({"k1": F.when(good, F.xxhash64("v")), "k2": F.when(good, F.hash("v"))})
    keyed = space.save(rows.select("vec_id", "k1", "k2"), "keyed")
    distinct = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many"), F.first("v").alias("v"))
    table = F.ceil(F.log2(F.size("v")) - 1e-9).cast("int")  # lengths up to a power of two
    distinct = space.save(distinct.withColumns({"node": F.monotonically_increasing_id(), "table": table}), "distinct")
    tables = distinct.groupBy("table").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).collect()  # 31 rows at most
    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    met = None
    for t in sorted(tables, key=lambda t: t["table"]):
        found = links_within(distinct.where(F.col("table") == t["table"]), t["n"], t["dims"], kind, threshold, space, str(t["table"]))
        met = found if met is None else met.unionByName(found)
    if met is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    parts = space.save(connected_components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), space), "parts")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    of_key = distinct.select("k1", "k2", "node", "many", "vec_id").join(links, "node", "left").join(parts, "node", "left")
    of_key = space.save(of_key.select("k1", "k2", "vec_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "node").alias("component")), "of_key")
    space.drop("distinct", "parts")
    number = of_key.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    done = keyed.join(of_key.join(number, "component").select("k1", "k2", "links", "component_id"), ["k1", "k2"], "left")
    done = done.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def links_within(distinct: DataFrame, count: int, dims: int, kind: str, threshold: float, space: Workspace, name: str) -> DataFrame:
    """(node, links, root): per task, a number of links of each vector and one that it is connected with.

    ``distinct``: (node, vec_id, k1, k2, many, v) of ``count`` vectors of at most ``dims`` components of the type ``kind``.
    """
    spark = distinct.sparkSession

    def filled_up(some: list[np.ndarray]) -> np.ndarray:
        """A row per vector, with zeros up to ``dims``."""
        out = np.zeros((len(some), dims), dtype=kind)
        for row, v in zip(out, some):
            row[: len(v)] = v
        return out

    def unit(raw: np.ndarray) -> np.ndarray:
        x = raw.astype(np.float64)
        x /= np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)  # else squares may overflow
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    # expected to be a twentieth short of FIT_ROWS, which is seven standard deviations
    some = distinct if count <= FIT_ROWS else distinct.where(F.pmod(F.xxhash64("vec_id", "k1"), F.lit(1 << 30)) < int(0.95 * FIT_ROWS / count * (1 << 30)))
    sample = some.orderBy("vec_id", "k1", "k2").select("v").toPandas()["v"]
    sample = unit(filled_up(sample.to_list()))
    made = Quantiser(sample, max(1, min(MOST_LISTS, count // LIST_ROWS, len(sample) // 4)), threshold)
    shared = spark.sparkContext.broadcast(made)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            flat = np.asarray(batch.column(2).flatten()).astype(kind)
            raw = flat.reshape(-1, dims) if (sizes == dims).all() else filled_up(np.split(flat, np.cumsum(sizes)[:-1]))
            x = unit(raw)
            to, codes, error = quantiser.encode(x)
            visits = quantiser.visits(x, to)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(to.astype(np.int32)), pa.array([v.tobytes() for v in visits], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                ["node", "many", "dims", "x", "cell", "visits", "code", "error"],
            )

    indexed = space.save(distinct.select("node", "many", "v").mapInArrow(index, "node long, many long, dims int, x binary, cell int, visits binary, code binary, error double"), f"indexed-{name}")
    # two numbers per list, of which there are at most MOST_LISTS
    size = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    group_of = made.groups(size)
    home_of = {c: int(group_of[c]) for c in size}
    filled = np.zeros(len(group_of), dtype=bool)
    filled[list(size)] = True

    def near_lists(bits: list[bytes]) -> np.ndarray:
        """Whether each row visits each list that has rows."""
        return np.unpackbits(np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")[:, : len(filled)].astype(bool) & filled

    def visited(cells: list[int], near: np.ndarray) -> list[list[int]]:
        """The groups with rows, other than its own, that each row visits."""
        return [[g for g in np.unique(group_of[row]).tolist() if g != home_of[c]] for c, row in zip(cells, near)]

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(group_of.max() + 1, dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                for row in visited(part.column(0).to_pylist(), near_lists(part.column(1).to_pylist())):
                    n[row] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["g", "n"])

    guests = {r["g"]: r["n"] for r in indexed.select("cell", "visits").mapInArrow(calls, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    held: dict[int, int] = {}
    for c, n in size.items():
        held[home_of[c]] = held.get(home_of[c], 0) + n
    alone = {home_of[c] for c, n in size.items() if n > BLOCK}
    blocks = {g: -(-n // BLOCK) if g in alone else 1 for g, n in held.items()}
    room = rows_for(dims, CHUNK, CHUNK // 4, 2 * VALUES)
    chunks = {g: max(1, -(-(guests.get(g, 0) + (n if g in alone else 0)) // room)) for g, n in held.items()}
    layout = ListBits(group_of)

    columns = ["node", "many", "dims", "x", "cell", "visits", "code", "error"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                at, keys = [], []
                part, cells = batch.column(8).to_pylist(), batch.column(4).to_pylist()
                near = near_lists(batch.column(5).to_pylist())
                local, bits = layout.packed(near), []
                for i, (cell, others) in enumerate(zip(cells, visited(cells, near))):
                    g = home_of[cell]
                    home = part[i] % blocks[g]
                    mine = [(g, home, k, True) for k in range(chunks[g])]
                    mine += [(g, b, part[i] // 1024 % chunks[g], False) for b in range(home + 1, blocks[g])]
                    mine += [(o, b, part[i] // 1024 % chunks[o], False) for o in others for b in range(blocks[o])]
                    at += [i] * len(mine)
                    keys += mine
                    bits += [layout.of(local[i], key[0]) for key in mine]
                    if len(at) > 20_000:
                        yield placed(batch, at, keys, bits)
                        at, keys, bits = [], [], []
                yield placed(batch, at, keys, bits)

    def placed(batch: pa.RecordBatch, at: list[int], keys: list[tuple], bits: list[bytes]) -> pa.RecordBatch:
        group, block, chunk, member = zip(*keys) if keys else ([], [], [], [])
        own = pa.array([i if m else None for i, m in zip(at, member)], pa.int32())  # what only members need
        took = [batch.column(j).take(own if j > 4 else pa.array(at, pa.int32())) for j in range(8)]
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(block, pa.int32()), pa.array(chunk, pa.int32()), pa.array(member, pa.bool_()), pa.array(bits, pa.binary()), *took], ["group", "block", "chunk", "member", "near", *columns])

    def compare(group: pa.Table) -> pa.Table:
        quantiser = shared.value
        chunk, width = group.column("chunk")[0].as_py(), int(layout.width[group.column("group")[0].as_py()])
        member, cell, nodes, sizes = (np.asarray(group.column(c)) for c in ("member", "cell", "node", "dims"))
        raw = np.frombuffer(b"".join(group.column("x").to_pylist()), dtype=kind).reshape(len(nodes), -1)
        x = unit(raw)
        near = np.frombuffer(b"".join(group.column("near").to_pylist()), dtype=np.uint8).reshape(len(nodes), width)
        place, members = np.cumsum(member) - 1, int(member.sum())  # of a member among members
        visits, codes = (np.frombuffer(b"".join(group.column(c).drop_null().to_pylist()), dtype=np.uint8).reshape(members, -1) for c in ("visits", "code"))
        error = np.asarray(group.column("error").drop_null())
        asking = np.arange(len(nodes)) if chunk == 0 else np.flatnonzero(~member)
        found = Links(np.asarray(group.column("many")))
        lists = [(c, np.flatnonzero(member & (cell == c))) for c in np.unique(cell[member]).tolist()]
        for a in range(0, len(asking), QUERIES):
            block = asking[a : a + QUERIES]
            table, base = quantiser.tables(x[block]), quantiser.centres[[c for c, _ in lists]] @ x[block].T
            for k, (c, inside) in enumerate(lists):
                home, mine = cell[block] == c, member[block]
                for some, how in ((home & mine, "own"), (home & ~mine, "block"), (has_bit(near, block, int(layout.place[c])), "visit")):
                    at = np.flatnonzero(some)
                    if not len(at):
                        continue
                    q = block[at]
                    i, j = quantiser.sieve(table[:, :, at], base[k, at], codes[place[inside]], error[place[inside]], threshold)
                    i, j = q[i], inside[j]
                    for b in range(0, len(i), 65_536):
                        p, r = i[b : b + 65_536], j[b : b + 65_536]
                        cosine = np.einsum("ij,ij->i", x[p], x[r])
                        linked = cosine >= threshold
                        for e in np.flatnonzero(np.abs(cosine - threshold) <= 1e-15 * (dims + 8)).tolist():  # rounding could decide
                            linked[e] = reaches(raw[p[e]], raw[r[e]], threshold)
                        linked &= sizes[p] == sizes[r]
                        p, r = p[linked], r[linked]
                        if how == "own":
                            once = nodes[p] < nodes[r]
                        else:  # the pair also meets in the other's list if each visits that of the other
                            once = (cell[p] <= c) | ~has_bit(visits, place[r], cell[p])
                        found.add(p[once], r[once])
        found.fold()
        some = np.flatnonzero(found.links)
        return pa.table({"node": nodes[some], "links": found.links[some].astype(np.int64), "root": nodes[found.label][some]})

    dealt = indexed.select(*columns, F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("part")).mapInArrow(deal, "group int, block int, chunk int, member boolean, near binary, node long, many long, dims int, x binary, cell int, visits binary, code binary, error double")
    met = space.save(dealt.groupBy("group", "block", "chunk").applyInArrow(compare, "node long, links long, root long"), f"met-{name}")
    space.drop(f"indexed-{name}")
    return met
