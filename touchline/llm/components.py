"""Connected components of a link table, distributed, by contraction to local minima.

Each round points every node at its smallest neighbour, follows the pointers to their ends by
doubling, and replaces links by links between the ends. Ends are local minima, so at least half of
the nodes that still have links go in each round. All tables stay in Spark; every round is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that it reaches) for every node that has a link.

    ``links`` holds two long columns; repeated links, both directions and loops do no harm, null
    ends are ignored, and an empty table gives an empty result.
    """
    spark = links.sparkSession
    lo, hi = F.least(a, b), F.greatest(a, b)
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    old: list[str] = []
    edges = stored(clean.select(lo.alias("u"), hi.alias("v")).distinct(), old)
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("end"))
        here: list[str] = []
        ends = stored(least, here)
        while True:
            inner = ends.select(F.col("node").alias("mid"), F.col("end").alias("far"))
            before, here = here, []
            ends = stored(
                ends.join(inner, F.expr("end = mid")).select("node", F.col("far").alias("end"), (F.col("far") != F.col("end")).alias("moved")), here
            )
            moved = not ends.where("moved").isEmpty()
            ends = ends.drop("moved")
            forget(spark, before)
            if not moved:
                break
        if found is None:
            found = ends.select("node", F.col("end").alias("component"))
        else:
            step = ends.select("node", "end").withColumnRenamed("node", "at")
            earlier = found.join(step, F.expr("component = at"), "left").select("node", F.coalesce("end", "component").alias("component"))
            found = stored(earlier)
        left = ends.select(F.col("node").alias("nu"), F.col("end").alias("eu"))
        right = ends.select(F.col("node").alias("nv"), F.col("end").alias("ev"))
        moved_edges = edges.join(left, F.expr("u = nu")).join(right, F.expr("v = nv")).where("eu <> ev")
        fresh: list[str] = []
        edges = stored(moved_edges.select(F.least("eu", "ev").alias("u"), F.greatest("eu", "ev").alias("v")).distinct(), fresh)
        forget(spark, old)
        old = fresh
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found
