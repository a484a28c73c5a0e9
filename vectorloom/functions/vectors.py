"""Functions of vector columns, as built-in expressions in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def vec(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def constant(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or sizes differ."""
    length = norm(a) * norm(b)
    return F.when((length == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / length)


def cosine_eps(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """cosine: (cos + 1) / 2, 0 for a zero vector; l2: 1 / (1 + distance); ip: the product, at least 0."""
    if metric == "cosine":
        length = norm(a) * norm(b)
        return F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (dot(a, b) / length + 1) / 2))
    if metric == "l2":
        return 1 / (1 + euclidean(a, b))
    if metric == "ip":
        return F.greatest(F.lit(0.0), dot(a, b))
    raise ValueError(f"unknown metric {metric!r}")


def from_distance(metric: str, d: Column) -> Column:
    """A similarity for an index's distance."""
    zero = F.lit(0.0)
    return {"cosine": F.greatest(zero, 1 - d), "l2": 1 / (1 + d), "ip": F.greatest(zero, -d)}[metric]


def to_distance(metric: str, s: Column) -> Column:
    return {"cosine": 1 - s, "l2": F.greatest(F.lit(0.0), 1 / s - 1), "ip": -s}[metric]


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(vec(a), vec(b), lambda x, y: F.abs(x - y)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return -euclidean(a, b)
    if metric == "euclidean_sq":
        return -squared_distance(a, b)
    if metric == "manhattan":
        return -manhattan(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def normalize(a: Column, eps: float = 1e-8) -> Column:
    length = norm(a) + eps
    return F.transform(vec(a), lambda x: x / length)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(vec(a), lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(vec(a), vec(b), lambda x, y: x - y)


def quantize(a: Column, low: Column, high: Column, bits: int) -> Column:
    """To 2**bits levels of [low, high], as fractions in [0, 1], halves to even; 0 where the range is empty."""
    top = 2**bits - 1
    return F.transform(vec(a), lambda x: F.when(high > low, F.rint((x - low) / (high - low) * top) / top).otherwise(0.0))


def quantize_255(a: Column) -> Column:
    return F.transform(vec(a), lambda x: F.round(x * 255) / 255)


def quantize_row(a: Column, bits: int) -> Column:
    """Codes 0 .. 2**bits - 1 of each value between the vector's own least and greatest."""
    low, high, top = F.array_min(vec(a)), F.array_max(vec(a)), 2**bits - 1
    return F.transform(vec(a), lambda x: F.when(high > low, F.least(F.lit(top), F.greatest(F.lit(0), F.floor((x - low) / ((high - low) / top) + 0.5)))).otherwise(0).cast("int"))


def weighted_sum(a: Column) -> Column:
    return total(F.transform(vec(a), lambda x, i: x * (i + 1)))


def complexity(a: Column) -> Column:
    return total(F.transform(vec(a), lambda x, i: F.abs(x) * F.sqrt((i + 1).cast("double"))))


def atan2_approx(y: Column, x: Column) -> Column:
    """A rational stand-in for atan2: r / (1 + |r|) for r = y / (|x| + eps), then by quadrant."""
    r = y / (F.abs(x) + 1e-8)
    a = r / (1 + F.abs(r))
    return F.when(x >= 0, a).when(y >= 0, F.pi() - a).otherwise(-F.pi() - a)


def base_angle(a: Column) -> Column:
    return F.when(F.size(a) < 2, 0.0).otherwise(atan2_approx(F.get(vec(a), F.lit(1)), F.get(vec(a), F.lit(0))))


def fingerprint(a: Column) -> Column:
    return F.xxhash64(a)


def checked(a: Column, dimensions: int) -> Column:
    """The vector; another size is an error."""
    return F.when(F.size(a) == dimensions, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimensions} dimensions, found "), F.size(a).cast("string"))))


def greatest_all(cols: list[Column]) -> Column:
    return reduce(F.greatest, cols)


#: SQL functions by name: parameters and body.
SQL_FUNCTIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_norm": ("a ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "vec_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 0D ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) END"),
    "vec_euclidean": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_manhattan": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
}


def register(spark: SparkSession) -> None:
    """Make the SQL_FUNCTIONS available to spark.sql."""
    for name, (params, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
