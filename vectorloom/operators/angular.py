"""Ordering of vectors by their angle to a reference vector, and what is built on it."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators.ranking import global_rank, with_previous
from vectorloom.operators.search import with_query

REGIONS = 100


def angle(v: Column, q: Column) -> Column:
    """acos of the cosine, in [0, pi]; 0 for a zero vector."""
    length = V.norm(v) * V.norm(q)
    return F.when(length == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(v, q) / length))))


def transform(df: DataFrame, reference: DataFrame | list[float], vector: str = "embedding") -> DataFrame:
    """Adds theta and radius."""
    v = F.col(vector)
    return with_query(df, reference).withColumn("theta", angle(v, F.col("q"))).withColumn("radius", V.norm(v)).drop("q")


def region(theta: Column, regions: int = REGIONS) -> Column:
    return F.floor(theta / (2 * pi) * regions).cast("int")


def sort(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """Adds ordinal, the position by (theta, key)."""
    return global_rank(df, ["theta", key])


def clusters(df: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    """Equal chunks in angular order, the last with the remainder; with n rows or more asked for than there are, one each."""
    ranked = sort(df, key)
    rows = ranked.agg(F.count("*").alias("rows"))
    size = F.greatest(F.floor(F.col("rows") / n), F.lit(1))
    return ranked.join(F.broadcast(rows), how="cross").withColumn("cluster_id", F.least(F.floor(F.col("ordinal") / size), F.lit(n - 1)).cast("int")).drop("rows")


def neighbours(df: DataFrame, theta: float | Column, radius: float | Column, k: int = 5, key: str = "vec_id") -> DataFrame:
    """The k rows of least 0.7 * |theta difference| + 0.3 * |radius difference|."""
    away = 0.7 * F.abs(F.col("theta") - theta) + 0.3 * F.abs(F.col("radius") - radius)
    return df.withColumn("distance", away).orderBy("distance", key).limit(k)


def potential(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: potential = 1 - mean angle step / pi, in [0, 1]; 0 for under two rows."""
    steps = with_previous(sort(df, key), {"theta": "before"}).where("before is not null")
    mean = F.avg(F.abs(F.col("theta") - F.col("before")))
    return steps.agg(F.when(F.count("*") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean / pi))).otherwise(0.0).alias("potential"))


def relevant_regions(df: DataFrame, theta: Column, radius: Column, k: int, key: str = "vec_id") -> DataFrame:
    """df has theta, radius, region_id.  Regions (region_id, near, alike) to look at for one query: those within
    max(1, min(10, k / 10)) of its own, wrapping, and those whose first row has a radius within a fifth of its."""
    reach = max(1, min(10, k // 10))
    own = df.groupBy("region_id").agg(F.min_by("radius", key).alias("first_radius"))
    apart = F.pmod(F.col("region_id") - region(theta), F.lit(REGIONS))
    near = (apart <= reach) | (apart >= REGIONS - reach)
    alike = F.abs(F.col("first_radius") - radius) / F.greatest(radius, F.lit(0.1)) <= 0.2
    return own.select("region_id", near.alias("near"), alike.alias("alike"))


def xy_simple(df: DataFrame, ordinal: Column, vector: str = "embedding") -> DataFrame:
    """Angle 0.1 * i modulo a turn, radius |mean|."""
    v = V.vec(vector)
    return df.withColumn("angle", F.pmod(0.1 * ordinal, F.lit(2 * pi))).withColumn("radius", F.abs(V.total(v) / F.size(v)))


def xy_weighted(df: DataFrame, ordinal: Column, density: float = 1.0, vector: str = "embedding") -> DataFrame:
    """radius = norm * density, angle = weighted sum / norm + 0.1 * i; x and y."""
    v, length = F.col(vector), V.norm(F.col(vector))
    out = df.withColumn("radius", length * density).withColumn("angle", V.weighted_sum(v) / (length + 1e-8) + 0.1 * ordinal)
    return out.withColumn("x", F.col("radius") * F.cos("angle")).withColumn("y", F.col("radius") * F.sin("angle"))


def xy_levels(df: DataFrame, ordinal: Column, levels: int = 3, vector: str = "embedding") -> DataFrame:
    """angle = base + 0.1 * i + pi * complexity / greatest complexity; radius a weighted mean of norm * 2**level."""
    v = F.col(vector)
    weights = [1 / (level + 1) for level in range(levels)]
    factor = sum(w * 2**level for level, w in enumerate(weights)) / sum(weights)
    own = df.withColumn("complexity", V.complexity(v))
    most = own.agg(F.max("complexity").alias("most"))
    out = own.join(F.broadcast(most), how="cross").withColumn("radius", V.norm(v) * factor)
    out = out.withColumn("angle", V.base_angle(v) + 0.1 * ordinal + pi * F.col("complexity") / (F.col("most") + 1e-8)).drop("most")
    return out.withColumn("x", F.col("radius") * F.cos("angle")).withColumn("y", F.col("radius") * F.sin("angle"))


def xy_search(df: DataFrame, x: float, y: float, k: int, radius: float, key: str = "vec_id") -> DataFrame:
    away = F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    return df.withColumn("distance", away).where(F.col("distance") <= radius).orderBy("distance", key).limit(k)


def reference_states(df: DataFrame, reference: DataFrame | list[float], ordinal: str = "ordinal", every: int = 100, vector: str = "embedding") -> DataFrame:
    """The drifting reference, one row per state (step, reference): each every-th row moves it by a hundredth towards that
    row's direction, then it is made unit length.  An ordered fold over n / every rows, which is inherently serial."""
    moved = df.where(F.col(ordinal) % every == 0).agg(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), V.vec(vector).alias("v")))).alias("rows"))
    zero = F.array(V.vec("q"))

    def step(states: Column, row: Column) -> Column:
        last = F.element_at(states, -1)
        length = V.norm(row["v"])
        near = F.zip_with(last, row["v"], lambda a, b: 0.99 * a + 0.01 * b / length)
        return F.concat(states, F.array(F.when(length == 0, last).otherwise(F.transform(near, lambda x: x / V.norm(near)))))

    states = with_query(moved, reference).select(F.aggregate("rows", zero, step).alias("states"))
    return states.select(F.posexplode("states").alias("step", "reference"))
