"""Rings, load scores and state machines over request logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def place(key: Column) -> Column:
    """A position on the ring: the first 15 hexadecimal digits of the md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def ring(spark: SparkSession, nodes: list[str], virtual: int = 64) -> DataFrame:
    """ring(node, position): `virtual` places a node."""
    if len(nodes) * virtual > 1_000_000:
        raise ValueError("a ring is broadcast and limited to a million places")
    own = spark.createDataFrame([(n,) for n in nodes], "node string").select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("i"))
    return own.select("node", place(F.concat_ws(":", "node", F.col("i").cast("string"))).alias("position"))


def lookup(df: DataFrame, rings: DataFrame, key: Column, into: str = "node", cells: int = 4096) -> DataFrame:
    """Adds the node of the first position at or behind the key's, wrapping.  The ring is cut into cells, each with its own
    positions and the first behind it, so a key meets a few positions by an equi-join with one broadcast row per cell."""
    width = (1 << 60) // cells
    one = rings.agg(F.array_sort(F.collect_list(F.struct("position", "node"))).alias("ring"))
    all_cells = rings.sparkSession.range(cells).select(F.col("id").alias("__cell")).join(F.broadcast(one), how="cross")
    after = F.filter("ring", lambda r: r["position"] >= F.col("__cell") * width)
    own = F.filter(after, lambda r: r["position"] < (F.col("__cell") + 1) * width)
    behind = F.coalesce(F.get(after, F.size(own)), F.element_at("ring", 1))
    table = all_cells.select("__cell", F.concat(own, F.array(F.struct(F.lit((1 << 60)).alias("position"), behind["node"].alias("node")))).alias("__near"))
    found = df.withColumn("__at", place(key)).withColumn("__cell", F.expr(f"__at div {width}")).join(F.broadcast(table), "__cell")
    return found.withColumn(into, F.get(F.filter("__near", lambda r: r["position"] >= F.col("__at")), F.lit(0))["node"]).drop("__at", "__cell", "__near")


def replicas(nodes: list[str], primary: Column, copies: int) -> Column:
    """The nodes that follow the primary in order, with it."""
    listed = F.array(*map(F.lit, sorted(nodes)))
    at = F.array_position(listed, primary) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda j: F.element_at(listed, ((at + j) % len(nodes) + 1).cast("int")))


def load_score(load: Column, response_ms: Column, connections: Column, success: Column) -> Column:
    return F.coalesce(0.4 * load + 0.3 * response_ms / 1000 + 0.2 * connections / 100 + 0.1 * (1 - success), F.lit(0.5))


def node_weight(load: Column, response_ms: Column, success: Column) -> Column:
    two = F.lit(2.0)
    weight = 2 * success * (2 - F.least(load, two)) * (2 - F.least(response_ms / 500, two))
    return F.least(F.lit(3.0), F.greatest(F.lit(0.1), weight))


def hashed(nodes: list[str], key: Column) -> Column:
    """The node at the key's position modulo their number."""
    return F.element_at(F.array(*map(F.lit, sorted(nodes))), (place(key) % len(nodes) + 1).cast("int"))


def by_range(bounds: list[int], key: Column) -> Column:
    """The number of the first bound at or behind the key's position; null behind the last, as ranges don't wrap."""
    edges = F.array(*(F.lit(b).cast("long") for b in sorted(bounds)))
    index = F.array_size(F.filter(edges, lambda b: b < place(key)))
    return F.when(index < len(bounds), index)


def assign(df: DataFrame, strategy: str, nodes: list[str], key: Column, into: str = "node", virtual: int = 64) -> DataFrame:
    """Adds the node of each key: "consistent" by a ring, of which angular placement is a case, "hash" by the position modulo
    the number of nodes, "range" by as many equal ranges of positions."""
    if strategy == "consistent":
        return lookup(df, ring(df.sparkSession, nodes, virtual), key, into)
    if strategy == "hash":
        return df.withColumn(into, hashed(nodes, key))
    if strategy == "range":
        bounds = [((k + 1) << 60) // len(nodes) for k in range(len(nodes))]
        return df.withColumn(into, F.element_at(F.array(*map(F.lit, sorted(nodes))), by_range(bounds, key) + 1))
    raise ValueError(f"unknown strategy {strategy!r}")


def shard_map(placed: DataFrame, most_bytes: int, shard: str = "shard", node: str = "node", size: str = "bytes") -> DataFrame:
    """placed(shard, node, bytes), a row for each stored row, to (shard, node, n, bytes, split): what each node holds of each
    shard, and whether the shard, on all its nodes, has outgrown most_bytes and is to be split."""
    own = placed.groupBy(shard, node).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias(size))
    return own.withColumn("split", F.sum(size).over(Window.partitionBy(shard)) > most_bytes)


def weighted(df: DataFrame, weights: DataFrame, key: Column, into: str = "node") -> DataFrame:
    """weights(node, weight) as one row: each key goes to the node in whose share of the weights its position falls."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("node", "weight"))).alias("w"))
    share = F.transform("w", lambda x, i: F.struct(x["node"].alias("node"), F.aggregate(F.slice("w", 1, i + 1), F.lit(0.0), lambda s, y: s + y["weight"]).alias("upto")))
    one = one.select(share.alias("w"))
    at = place(key) / F.lit(float(1 << 60)) * F.element_at("w", -1)["upto"]
    index = F.array_size(F.filter("w", lambda x: x["upto"] <= at))
    return df.join(F.broadcast(one), how="cross").withColumn(into, F.element_at("w", F.least(index + 1, F.size("w")))["node"]).drop("w")


def rebalance(nodes: DataFrame, shards: DataFrame, slack: float = 0.2) -> DataFrame:
    """nodes(node), shards(node, load) to (node, shards, load, state): idle nodes count as well."""
    own = shards.groupBy("node").agg(F.count("*").alias("shards"), F.sum("load").alias("load"))
    own = nodes.join(own, "node", "left").select("node", F.coalesce("shards", F.lit(0)).alias("shards"), F.coalesce("load", F.lit(0.0)).alias("load"))
    mean = F.avg("load").over(Window.partitionBy())
    return own.withColumn("state", F.when(F.col("load") > (1 + slack) * mean, "overloaded").when(F.col("load") < (1 - slack) * mean, "underloaded").otherwise("balanced"))


def fold(df: DataFrame, key: str, time: str, start: tuple, step: Callable[..., tuple[tuple, object]], made: str, type: str) -> DataFrame:
    """Adds the column made: step(state, seconds since the row before, *other columns) gives the next state and its value, for
    the rows of each key by time, then by the other columns.  df has key, time and the others, in that order.

    Keys are dealt to tasks and sorted there, and rows stream through with one state held, so a key with many rows costs time
    but no memory.  Rows without a time come last, and no time passes before them.
    """
    schema = StructType([*df.schema.fields, StructField(made, DataType.fromDDL(type))])
    kept = to_arrow_type(DataType.fromDDL(type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = object(), start, None
        for batch in batches:
            out = []
            times = batch.column(1).cast(pa.int64()).to_pylist()
            for k, t, *others in zip(batch.column(0).to_pylist(), times, *(c.to_pylist() for c in batch.columns[2:])):
                if k != now:
                    now, state, last = k, start, t
                state, value = step(state, 0.0 if t is None or last is None else (t - last) / 1e6, *others)
                last = last if t is None else t
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kept)], names=[*batch.schema.names, made])

    own = df.repartition(F.col(key)).sortWithinPartitions(F.col(key), F.col(time).asc_nulls_last(), *df.columns[2:])
    return own.mapInArrow(run, schema)


def breaker(df: DataFrame, key: str, time: str, failed: str, failures: int = 5, timeout_s: float = 60.0, successes: int = 3) -> DataFrame:
    """Adds state after each request of its key: closed opens at `failures` in a row; open is half open once timeout_s has
    passed; half open closes after `successes` and opens at a failure.  A missing failed counts as none."""

    def step(now: tuple, passed: float, f: bool | None) -> tuple[tuple, str]:
        state, n, age = now  # n: failures in a row, or requests while half open; age: seconds that it has been open
        age += passed
        if state == "open" and age >= timeout_s:
            state, n = "half_open", 0
        if state == "closed":
            n = n + 1 if f else 0
            state, age = ("open", 0.0) if n >= failures else (state, age)
        elif state == "half_open":
            n += 1
            state, n, age = ("open", 0, 0.0) if f else ("closed", 0, age) if n >= successes else (state, n, age)
        return (state, n, age), state

    return fold(df.select(key, time, failed), key, time, ("closed", 0, 0.0), step, "state", "string")


def token_bucket(df: DataFrame, key: str, time: str, rate: float, burst: float) -> DataFrame:
    """Adds allowed: each request takes a token of its key's bucket, refilled at `rate` a second up to `burst`."""

    def step(now: tuple, passed: float) -> tuple[tuple, bool]:
        tokens = min(burst, now[0] + rate * passed)
        return (tokens - (tokens >= 1),), tokens >= 1

    return fold(df.select(key, time), key, time, (burst,), step, "allowed", "boolean")


def healthy(df: DataFrame, now: Column, max_age_s: int = 120) -> DataFrame:
    """Nodes whose breaker isn't open, whose status is healthy and whose last check is recent."""
    return df.where((F.col("breaker") != "open") & (F.col("status") == "healthy") & (now.cast("double") - F.col("checked_at").cast("double") <= max_age_s))


