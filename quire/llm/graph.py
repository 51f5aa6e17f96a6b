"""Connected components of a graph given as a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One half step: every node's larger neighbours (large) or its smaller ones and itself (small) are linked to its least one."""
    if large:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ordered.groupBy("u").agg(F.min("v").alias("m"))
        out = ordered.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, label) for every node of `links` (u, v): label is the least node of its component.

    Alternating large and small stars: the links shrink to one star for each component in about log(nodes) rounds, whatever
    the shape, and no step brings a component together in one task. Rounds end when no link changes."""
    links = cut(links.select("u", "v").filter("u <> v").distinct())
    mark = None
    while True:
        links = cut(_stars(_stars(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select("u", F.col("v").alias("label")).union(links.select(F.col("v").alias("u"), F.col("v").alias("label"))).distinct()
