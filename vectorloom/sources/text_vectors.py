"""Vectors in text files: a word and its numbers on each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """(word, embedding: array<float>); lines of another size are left out."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where(F.size(parts) == dimensions + 1)
    return rows.select(parts[0].alias("word"), F.slice(parts, 2, dimensions).cast("array<float>").alias("embedding"))
