"""The catalogue's tables, made from the TPC-H-like ones: items with nullable vectors, likes, an ingredient bridge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, v, label)"""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def coordinates(spark: SparkSession, d: str, first: int = 1) -> DataFrame:
    """(id, v, x, y, z, label): three dimensions from ``first`` on, at unit length."""
    three = vectors(spark, d).select("id", "label", F.slice("v", first, 3).alias("v")).withColumn("n", F.sqrt(F.col("v")[0] * F.col("v")[0] + F.col("v")[1] * F.col("v")[1] + F.col("v")[2] * F.col("v")[2]))
    return three.where("n > 1e-12").select("id", "label", F.transform("v", lambda x: x / F.col("n")).alias("v")).select("id", "label", "v", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, base_tag, glass, abv, price): the items where no vector is asked for."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("base_tag"), F.col("p_type").alias("glass"), F.col("p_size").alias("abv"), F.col("p_retailprice").alias("price"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, base_tag, glass, abv, price, embedding)"""
    return parts(spark, d).join(vectors(spark, d).select("id", F.col("v").alias("embedding")), "id", "left")


def likes(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, created_at), one row per pair: the latest."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item_id")).join(orders, "l_orderkey")
    return rows.groupBy("user_id", "item_id").agg(F.max("created_at").alias("created_at"))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """(cocktail_id, ingredient_id, amount, unit): orders as recipes, parts as ingredients."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cocktail_id"), F.col("l_partkey").alias("ingredient_id"), F.col("l_quantity").alias("amount"), F.col("l_returnflag").alias("unit"))
