"""Connected components over a distributed edge table, by alternating large-star and small-star steps.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a
DataFrame aggregation and a join; each step's edges are written to the shared folder, so lineage stays
short and a lost executor costs a step at most. Links never reach the driver, only counts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.stages import drop_stage, write_stage


def _with_min(both: DataFrame) -> DataFrame:
    """both: (u, v) neighbours of u. Adds m, the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("k"), F.least("u", "m0").alias("m"))
    return both.join(least, both.u == least.k).drop("k")


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of `edges`, the smallest node it can reach. Nodes without edges are absent.

    Null ends and loops are ignored; an empty table gives an empty result. The steps end when one leaves the set of
    edges as it was, which is compared edge by edge.
    """
    e = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    e = write_stage(e.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct(), "cc")
    before = e.count()
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is joined to the least of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u, is joined to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        j = large.join(least, large.u == least.k)
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        nxt = write_stage(small, "cc")
        now = nxt.count()
        settled = now == before and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
        drop_stage(e)
        e, before = nxt, now
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    labels = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.union(roots)
