"""Metadata filters as dictionaries, compiled to one predicate.

{"k": v} equality, {"k": [..]} membership, {"k": {"$gte": a, "$lt": b}} with $eq $ne $gt $gte $lt $lte $in $nin; keys and
operators are joined by AND.  A row without the value is rejected by every operator.  Array columns match a list if they
have an item of it.  Unknown operators and columns are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALAR = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
}


def _member(column: Column, values: list, array: bool) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, values))) if array else column.isin(list(values))


def compile_filter(schema: T.StructType, filters: dict[str, Any] | None) -> Column:
    parts = []
    for key, want in (filters or {}).items():
        if key not in schema.names:
            raise ValueError(f"no metadata column {key!r}")
        column, array = F.col(key), isinstance(schema[key].dataType, T.ArrayType)
        for op, value in want.items() if isinstance(want, dict) else [("$in" if isinstance(want, (list, tuple, set)) else "$eq", want)]:
            if op in ("$in", "$nin"):
                part = _member(column, list(value), array)
                part = ~part if op == "$nin" else part
            elif op in SCALAR:
                part = SCALAR[op](column, F.lit(value))
            else:
                raise ValueError(f"unknown filter operator {op!r}")
            parts.append(F.coalesce(part, F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_filter(df: DataFrame, filters: dict[str, Any] | Column | Callable[[DataFrame], Column] | None) -> DataFrame:
    """The rows that a dictionary, a boolean column, or what a function makes of df, accepts; null is no."""
    if filters is None:
        return df
    if isinstance(filters, dict):
        return df.where(compile_filter(df.schema, filters)) if filters else df
    return df.where(filters if isinstance(filters, Column) else filters(df))
