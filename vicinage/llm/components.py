"""Connected components of a link table, by alternating large-star and small-star steps (a published algorithm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, u: str, v: str) -> tuple[DataFrame, str]:
    """(node, component) for every node of a link, the component being its smallest node; and the path of the table behind it.

    Nulls and links of a node with itself are ignored; repeated links count once; without links there are no rows.
    Each round hangs neighbours on the smallest one near; rounds grow with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    edges, path = tables.written(edges, "links")
    before = _state(edges)
    while before[0]:
        both = _both(edges)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges, now = tables.written(small, "links")
        tables.drop(spark, path)  # of the rounds only the last stays
        path, after = now, _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), path
