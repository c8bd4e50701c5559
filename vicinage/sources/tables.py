"""Cells, expression and embeddings from files, and from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adapters over the star schema -----------------------------------------------------------------------------------


def cells_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("cell_id"),
        (F.col("value") * 4).alias("x"),
        (F.col("user_id") * F.lit(4.0)).alias("y"),
        F.col("event_type").alias("cell_type"),
        F.concat(F.lit("SE"), 1 + (F.col("event_id") * 7) % 4).alias("se"),
        F.concat(F.lit("S"), F.col("event_id") % 4).alias("sample"),
    )


def cells_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    x, y = (F.col("c_custkey") % 40) * F.lit(12.0), F.floor(F.col("c_custkey") / 40) * F.lit(12.0)
    stripe = (F.floor(x / 120) + F.floor(y / 120)) % 3
    return c.select(
        F.col("c_custkey").alias("cell_id"),
        x.alias("x"),
        y.alias("y"),
        F.col("c_mktsegment").alias("cell_type"),
        F.concat(F.lit("SE"), (1 + stripe).cast("int")).alias("se"),
        F.concat(F.lit("S"), F.col("c_nationkey") % 4).alias("sample"),
    )


def expression_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, gene, value): quantities bought by brand; an absent row is a zero."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def embedding_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, spot_id, pc): the two halves of each embedding as two views of the same spots."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("embedding").cast("array<double>").alias("v"))
    half = lambda name, at: e.select(F.lit(name).alias("view"), "spot_id", F.slice("v", at, 32).alias("pc"))
    return half("a", 1).unionByName(half("b", 33))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("sample"))
    return labels.join(docs, "doc_id").select("sample", F.concat(F.lit("Q"), "quality").alias("se"), F.concat(F.lit("Q"), 1 - F.col("toxic")).alias("pred"))
