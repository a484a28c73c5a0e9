"""Exact quantiles, without one task that holds all values of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.plans.scratch import cut


def quantiles(df: DataFrame, keys: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """(keys, a column for each of `of`): the quantiles of value per key, between two values by their distance.

    Equal values are counted where they are; the counts are dealt out by range and cut; each range is summed up on its own and
    offset by the counts of those before it, a table of one row per range and key.  Missing values don't count; a key with no
    other has null; without keys an empty table gives one row of nulls.
    """
    rows = df.select(F.struct(F.lit(0), *keys).alias("k"), F.col(value).alias("v")).groupBy("k", "v").agg(F.count("v").alias("n"))
    dealt = cut(rows.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part", "k").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("k")
    before = F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", "k", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(own).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("part", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    spread = dealt.withColumn("upto", upto).join(sizes, ["part", "k"]).withColumn("upto", F.col("upto") + F.col("before"))
    found = []
    for name, q in of.items():
        spot = F.lit(q) * (F.col("total") - 1)
        at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("v")))
        share = F.max(spot - F.floor(spot))
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        found.append((low + (high - low) * share).alias(name))
    if not keys:
        return spread.agg(*found)
    return spread.groupBy("k").agg(*found).select(*(F.col("k")[c].alias(c) for c in keys), *of)
