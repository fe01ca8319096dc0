"""Connected groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, settled


def connected(edges: DataFrame, paths: list[str]) -> DataFrame:
    """node and root, the least node that it is connected with, of all nodes of the edges (u and v, whole numbers).

    Every node knows the least node that it has heard of. In each round it hears of what its
    neighbours know, and of what the node that it knows knows, so far ends hear of each other in about as
    many rounds as their distance has bits. What each round has found is settled, and joins merge, as broadcasts would pass through
    the driver; the last table's path is added to ``paths``.
    """
    spark, own = edges.sparkSession, []
    near = settled(edges.where("u <> v").select("u", "v").unionAll(edges.where("u <> v").select(F.col("v"), F.col("u"))).distinct(), own)
    known = settled(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).select(F.col("u").alias("node"), "root"), own)
    while True:
        # the neighbours of a node, what it knows itself, and the neighbours of what it knows
        heard = near.join(known.hint("merge"), F.col("v") == F.col("node")).select(F.col("u").alias("node"), "root")
        # whoever told a node of its root is told in return
        told = near.join(known.hint("merge"), F.col("v") == F.col("node")).select(F.col("u"), F.col("root").alias("of"))
        told = told.join(known.hint("merge"), F.col("u") == F.col("node")).where("root > of").select(F.col("root").alias("node"), F.col("of").alias("root"))
        least = known.unionAll(heard).unionAll(told).groupBy("node").agg(F.min("root").alias("new"))
        # and from there one step further
        there = known.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        least = least.join(there.hint("merge"), F.col("new") == F.col("at")).select("node", F.least("new", "beyond").alias("root"))
        before, last = known, own[-1]
        known = settled(least, own)
        changed = known.join(before.withColumnRenamed("root", "was").hint("merge"), "node").where("root < was").limit(1).count()
        discard(spark, [last])
        own.remove(last)
        if not changed:
            break
    paths.append(own.pop())
    discard(spark, own)
    return known
