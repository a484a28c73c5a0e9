"""What all operators use: cuts of lineage in the shared folder, tables, Arrow output schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vectorloom.plans.scratch import clear, cut, shared_dir, small_batches

__all__ = ["clear", "cut", "positional", "shared_dir", "small_batches", "struct", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"{k} {v}" for k, v in kinds.items()))


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0_, c1_, ..., so that no name of its own can clash with one that an operator adds, and the
    new name of each by its own in lower case."""
    names = [f"c{k}_" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(map(str.lower, docs.columns), names))
