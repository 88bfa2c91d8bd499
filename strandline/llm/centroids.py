"""Centroid clustering by delta Lloyd rounds in exact integers.

1. Vectors become integers, floor(SCALE * x), and are written once with a row per vector. The first
   centroids are the kept vectors with the smallest hashes.
2. A round reads the table of the round before: vector, owner, distance. A vector whose owner stayed
   where it was is compared with the changed centroids only, as no other can have come nearer; a vector whose owner
   moved is compared with all. The new owner and distance are written with the vector.
3. In the same pass each task adds up what changes hands: a vector that moves from one owner to another
   counts -1 times itself for the old one and +1 times for the new one. The task's sums are rows of the
   same table, at most one per centroid, and a shuffle adds them up to what the global sums gain. Only these,
   a row per centroid and component, come to the driver, where the persisted sums and counts are brought up to date.
4. If no centroid changed, the assignment is final and the rounds end; else the vectors are assigned once more
   after the last round.

A round never shuffles a vector, and a lost executor repeats its tasks of one round: the rounds before are
files in the shared folder, of which the last two exist at a time.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out;
components beyond +-LARGEST count as that (a distance then still fits a long); repeated ids are rows of their own, and as first
centroids they follow the order of their components; a null id is hashed as the empty text and stays null;
with fewer vectors than centroids there are fewer centroids; of equal vectors two centroids may start
alike, and the second stays empty; ties go to the smaller number; an empty table gives an empty one;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LARGEST = 1 << 26
#: Up to this magnitude sums of products are exact in double precision.
EXACT = 1 << 21
STATE = "vec_id {0}, v array<int>, owner int, distance long, centroid int, gain array<long>, members long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """(vec_id, v): the vectors of ``size`` finite components as integers."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))  # false for NaN, which is larger than all
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.lit(SCALE) * x.cast("double")), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.where((F.size(v) == size) & finite).select(F.col(id_col).alias("vec_id"), scaled.alias("v"))


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector (row) to each centroid."""
    kind = np.float64 if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT else np.int64
    v, c = v.astype(kind), centroids.astype(kind)
    return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def assigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners and distances after ``changed`` centroids (a mask) took their new places; owner -1: none yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = squared_distances(v[lost], centroids)
        owner[lost] = d.argmin(axis=1)  # the first of equal ones
        distance[lost] = d.min(axis=1)
    at, rest = np.flatnonzero(changed), np.flatnonzero(~lost)
    if len(at) and len(rest):
        d = squared_distances(v[rest], centroids[at])
        best = d.argmin(axis=1)
        d, best = d[np.arange(len(rest)), best], at[best]
        nearer = (d < distance[rest]) | ((d == distance[rest]) & (best < owner[rest]))
        owner[rest[nearer]], distance[rest[nearer]] = best[nearer], d[nearer]
    return owner, distance


def one_round(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The vectors with their new owners, and a row per task and centroid with what the centroid's sum and count gain."""
    many = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
        names = [x.split()[0] for x in STATE.split(", ")]
        gain, members, id_kind = np.zeros_like(centroids), np.zeros(many, dtype=np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_kind = batch.column(0).type
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, centroids.shape[1])
            before = batch.column(2).to_numpy()
            owner, distance = assigned(v, before, batch.column(3).to_numpy(), centroids, changed)
            moved = np.flatnonzero(owner != before)
            for rows, owners, sign in ((moved, owner, 1), (moved[before[moved] >= 0], before, -1)):
                one = np.zeros((many, len(rows)), dtype=np.int64)
                one[owners[rows], np.arange(len(rows))] = sign
                gain += one @ v[rows].astype(np.int64)
                members += one.sum(axis=1)
            none = [pa.nulls(batch.num_rows, k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), *none], names)
        hit = np.flatnonzero((gain != 0).any(axis=1) | (members != 0))
        if len(hit):
            none = [pa.nulls(len(hit), k) for k in (id_kind, *kinds[:3])]
            yield pa.RecordBatch.from_arrays([*none, pa.array(hit, pa.int32()), pa.array(gain[hit].tolist(), kinds[4]), pa.array(members[hit])], names)

    return state.mapInArrow(run, STATE.format(state.schema["vec_id"].dataType.simpleString()))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = COMPONENTS, many: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    space = Workspace(spark, "centroids")
    start = integer_vectors(vectors, id_col, vector_col, size).select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    state = space.save(start, "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = state.select("v", rank.alias("rank")).orderBy("rank", "v").limit(many).collect()  # ``many`` rows
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), size)
    sums, counts = np.zeros_like(centroids), np.zeros(len(first), dtype=np.int64)
    changed = np.ones(len(first), dtype=bool)
    previous = "vectors"
    for k in range(rounds + 1):
        state = space.save(one_round(state.select("vec_id", "v", "owner", "distance"), centroids, changed), f"round-{k}")
        gained = state.where("centroid is not null").select("centroid", "members", F.posexplode("gain").alias("i", "x"))
        for row in gained.groupBy("centroid", "i").agg(F.sum("x").alias("x"), F.sum("members").alias("members")).collect():  # ``many`` times ``size`` rows
            sums[row["centroid"], row["i"]] += row["x"]
            if row["i"] == 0:
                counts[row["centroid"]] += row["members"]
        state = state.where("v is not null")
        space.drop(previous)
        previous = f"round-{k}"
        if k < rounds:
            moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
            changed, centroids = (moved != centroids).any(axis=1), moved
            if not changed.any():
                break
    inertia = {r["owner"]: r["d"] for r in state.groupBy("owner").agg(F.sum("distance").alias("d")).collect()}  # ``many`` rows
    known = [(c, inertia.get(c, 0), sum(inertia.values()), digest(centroids[c])) for c in range(len(first))]
    facts = F.broadcast(spark.createDataFrame(known, "owner int, cluster_inertia long, inertia long, centroid_sha256 string"))  # ``many`` rows
    return state.select("vec_id", "owner", "distance").join(facts, "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
