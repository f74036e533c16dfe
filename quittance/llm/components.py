"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import remove, shuffled, stored


def _with_min(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and all its v.

    The minimum meets the pairs on a key of its own, which makes Spark shuffle
    both sides for the join, so adaptive execution can split a hub over tasks.
    Neither side is broadcast: the rounds would pile up in the driver.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.withColumn("k", F.struct("u")).join(shuffled(least), "k").select("u", "v", "m")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Every round rewires edges to smaller nodes: all neighbours above a node are
    tied to the least neighbour, then the node itself and those below. Each
    round is written to the shared folder and read again, so a lost executor
    costs one round at most, and its estimated size stays that of its files. Nothing but a count and a checksum comes to the driver.
    Null ends and self-loops are left out; repeated edges count once.
    """
    e = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e, path = stored(e)
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_min(large)
        before = path
        e, path = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        remove(e.sparkSession, before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
