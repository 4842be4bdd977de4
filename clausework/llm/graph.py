"""Connected components by alternating stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge; component is the smallest node reachable.

    Large-star hangs a node's larger neighbours onto its smallest one, small-star
    hangs its smaller neighbours there; both shrink distances, so the number of
    rounds grows with the logarithm of the longest path. Every minimum is a
    partial aggregate and is joined back, so a node that holds a third of the
    edges is split by the skew join and never gathered. Loops and null ends are
    ignored; repeated edges count once; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e)
    n = e.count()
    for _ in range(rounds):
        if not n:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, was = e, n
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        n = e.count()
        if n == was and old.join(e, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
