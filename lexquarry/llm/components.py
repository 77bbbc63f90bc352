"""Connected components of a graph too large for one machine.

Alternates the two "star" steps: every vertex ties its larger neighbours to its smallest
neighbour, then its smaller neighbours likewise. Both are an aggregate and an equi-join, so a hub
is reduced before the shuffle and split by the skew join. Each round is settled in the shared
folder; only two numbers of a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has each edge once, u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u").where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of all nodes of ``edges`` (columns a, b).

    Loops, repeated and reversed edges and nulls change nothing; no edges give no rows.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    now = settle(now.distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = settle(_star(_star(now, True), False), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().join(ends.select("node"), "node", "left_anti")
    return ends.unionByName(roots.withColumn("component", F.col("node")))
