"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is two aggregations and two joins on the edges; nothing of the graph comes to the
driver but a row count and a checksum per round. Each round is written to the shared folder, so a
lost executor costs one round at most. A hub's edges are aggregated before they are shuffled, and
the join back to them has one row per node on its other side, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Workspace


def connected_components(edges: DataFrame, space: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a and b, longs); component: its smallest node.

    Loops, repeated edges and nulls are ignored. An empty table gives an empty one.
    """
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = space.save(edges.where("a is not null and b is not null and a <> b").select(u, v).distinct(), f"{name}-0")
    seen = _checksum(now)
    for k in range(1, 64):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = space.save(both.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
        now, before, seen = after, seen, _checksum(after)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
