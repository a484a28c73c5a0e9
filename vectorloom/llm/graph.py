"""Connected components of an edge table, never gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.scratch import cut

SMALL = 1 << 19  # edges that one task solves; about 40 MB


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node reachable from each of n: trees hook to their least neighbour and are flattened, so every round halves them."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    both = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks])
    nodes = pc.unique(both)
    nodes = nodes.take(pc.sort_indices(nodes))
    at = pc.index_in(both, value_set=nodes).to_numpy()
    root = _roots(at[: edges.num_rows], at[edges.num_rows :], len(nodes))
    for k in range(0, len(nodes), 65536):
        yield pa.RecordBatch.from_arrays([nodes.slice(k, 65536), nodes.take(pa.array(root[k : k + 65536]))], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges(a, b): undirected.  Returns (node, root), root the least node reachable; one row per node with an edge.

    Alternates two star operations: each node links its greater neighbours to its least neighbour, then its lesser ones.
    Least neighbours come from aggregates with map-side combining and a join that AQE splits, so that a node with a third
    of all edges doesn't land in one task.  Each round is cut.  Self loops and repeated edges are allowed.

    A graph of at most SMALL edges, for which the rounds' shuffles would cost far more than their work, is solved in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    if now.count() <= SMALL:
        kind = now.schema["a"].dataType.simpleString()
        return cut(now.coalesce(1).mapInArrow(_solve, f"node {kind}, root {kind}"))
    now = cut(now.distinct())
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))  # AQE can split the join
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first()
        if sign == seen or sign[0] == sign[2] and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count() == 0:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
