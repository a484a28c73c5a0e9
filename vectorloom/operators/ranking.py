"""Positions in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.plans.scratch import cut


def global_rank(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """Adds the 0-based position of each row in the order, which should be total.

    Rows are dealt out by range and cut; each range is numbered on its own, and ranges are offset by the sizes of those
    before them: a table of one row per range.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__own", own).join(sizes, "__part").withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__before")


def with_previous(df: DataFrame, columns: dict[str, str], ordinal: str = "ordinal") -> DataFrame:
    """Adds columns of the row before, by position: {column: name of its copy}."""
    before = df.select((F.col(ordinal) + 1).alias(ordinal), *(F.col(c).alias(n) for c, n in columns.items()))
    return df.join(before, ordinal, "left")
