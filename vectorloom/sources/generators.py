"""Seeded synthetic vectors, made where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V


def _normal(dimensions: int, seed: int) -> Column:
    return F.array(*(F.randn(seed + k) for k in range(dimensions)))


def random_vectors(spark: SparkSession, n: int, dimensions: int = 128, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("vec_id"), _normal(dimensions, seed).alias("embedding"))


def normalized_vectors(spark: SparkSession, n: int, dimensions: int = 128, seed: int = 42) -> DataFrame:
    return random_vectors(spark, n, dimensions, seed).withColumn("embedding", V.normalize(F.col("embedding"), 0.0))


def correlated_vectors(spark: SparkSession, n: int, dimensions: int = 128, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """A base vector with noise that grows along the ids."""
    base = spark.range(1).select(_normal(dimensions, seed + 10_000).alias("base"))
    own = random_vectors(spark, n, dimensions, seed).join(F.broadcast(base), how="cross")
    return own.select("vec_id", F.zip_with("base", "embedding", lambda b, x: b + noise * x * F.col("vec_id") / n).alias("embedding"))


def clustered_vectors(spark: SparkSession, n: int, dimensions: int = 128, centres: int = 20, sigma: float = 0.3, seed: int = 42) -> DataFrame:
    middle = spark.range(centres).select(F.col("id").alias("centre"), _normal(dimensions, seed + 10_000).alias("middle"))
    own = random_vectors(spark, n, dimensions, seed).withColumn("centre", F.col("vec_id") % centres).join(F.broadcast(middle), "centre")
    return own.select("vec_id", F.col("centre").alias("label"), F.zip_with("middle", "embedding", lambda m, x: m + sigma * x).alias("embedding"))
