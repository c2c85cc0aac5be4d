"""Connected components by alternating stars, for the operators that group near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node id of each connected component, for nodes that have an edge.

    Large-star and small-star steps (Kiveris et al. 2014) alternate until the
    edges no longer change; the number of rounds grows with the logarithm of the
    longest path.  Each round is written, so a lost executor costs no earlier round.
    """
    now = storage.written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = storage.written(small.where("u <> v").distinct(), "edges")
        summary = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if summary == state:
            break
        state = summary
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
