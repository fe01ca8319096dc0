"""Connected components of an edge table, by alternating large and small stars.

Labels travel as rows: nothing is gathered on the driver but one number a
round. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, tidy, written


def _unsettled(stars: DataFrame) -> bool:
    """Whether a child has two parents or a parent is a child."""
    roles = stars.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
        stars.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    roles = roles.groupBy("x").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    with tidy(stars.sparkSession):
        return bool(roles.where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))).limit(1).count())


def _large(stars: DataFrame) -> DataFrame:
    near = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of an edge; edges has longs u and v.

    Edges from a node to itself, or with a null, are ignored. Without edges the result is empty.
    """
    spark = edges.sparkSession
    stars = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    paths: list[str] = []
    stars = written(stars, "stars", paths)
    while _unsettled(stars):
        stars = written(_small(written(_large(stars), "stars", paths)), "stars", paths)
        discard(spark, paths[:-1])
        del paths[:-1]
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
