"""Connected components of a link table by alternating large and small stars.

Each round moves links towards the smallest node of their component; a round is
two grouped minima and two joins, so no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links (u, v) with u > v. Large star: every larger neighbour of a node is
    linked to the node's minimum; small star: the node and its smaller neighbours are."""
    if larger_only:
        sides = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = sides.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` of every node that has a link; a component is named by its smallest node.

    Links from a node to itself and repeated links change nothing; links with a null end are ignored.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = written(links, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = written(_stars(_stars(now, True), False), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
