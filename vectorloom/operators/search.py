"""Exact similarity search: top-k, k-NN and range joins, in expressions or in Arrow blocks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators.filters import apply_filter

QUERY_BLOCK = 4096


def one_vector(df: DataFrame, id: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The query vector as a one-row table (q), to be joined by broadcast: one row whatever the table holds."""
    return df.where(F.col(key) == id).select(F.col(vector).alias("q")).limit(1)


def with_query(df: DataFrame, query: DataFrame | list[float]) -> DataFrame:
    """Adds the column q: the query, a list of numbers or a one-row table."""
    if isinstance(query, DataFrame):
        return df.join(F.broadcast(query), how="cross")
    return df.withColumn("q", V.constant(query))


def topk(df: DataFrame, query: DataFrame | list[float], k: int = 10, metric: str = "cosine", filters: dict[str, Any] | None = None, key: str = "vec_id", vector: str = "embedding", return_vectors: bool = False) -> DataFrame:
    """The k rows of the highest score, ties by key; filters apply before the search.  Planned as a top-k of each partition
    and one of those, so k rows of each partition move.  Adds score and rank."""
    found = with_query(apply_filter(df, filters), query).withColumn("score", V.score(metric, F.col(vector), F.col("q"))).drop("q")
    best = found.orderBy(F.desc("score"), key).limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
    return best if return_vectors else best.drop(vector)


def range_search(df: DataFrame, query: DataFrame | list[float], radius: float, max_results: int = 1000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows within radius (Euclidean), nearest first, at most max_results.  Adds distance."""
    found = with_query(df, query).withColumn("distance", V.euclidean(F.col(vector), F.col("q"))).drop("q")
    return found.where(F.col("distance") <= radius).orderBy("distance", key).limit(max_results)


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "manhattan":
        return -np.stack([np.abs(x - row).sum(1) for row in q]) if len(q) else np.zeros((0, len(x)))
    product = q @ x.T
    if metric == "dot":
        return product
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    if metric == "cosine":
        length = qn[:, None] * xn[None, :]
        return np.divide(product, length, out=np.zeros_like(product), where=length != 0)
    return -np.sqrt(np.maximum(qn[:, None] ** 2 + xn[None, :] ** 2 - 2 * product, 0))


def _best(score: np.ndarray, keys: np.ndarray, found: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of score with keys, both (n, k), and of found (n, m) with the keys own (m), in order, ties by key.  Only rows
    with a tie at the k-th place are sorted whole."""
    k = score.shape[1]
    both = np.concatenate([score, found], 1)
    name = lambda r, c: np.where(c < k, keys[r, np.minimum(c, k - 1)], own[np.maximum(c - k, 0)])
    at = np.argpartition(both, both.shape[1] - k, axis=1)[:, -k:]
    tied = np.flatnonzero((both >= np.take_along_axis(both, at, 1).min(1, keepdims=True)).sum(1) > k)
    if len(tied):
        every = np.broadcast_to(np.arange(both.shape[1]), (len(tied), both.shape[1]))
        at[tied] = np.lexsort((name(tied[:, None], every), -both[tied]), axis=1)[:, :k]
    best, names = np.take_along_axis(both, at, 1), name(np.arange(len(both))[:, None], at)
    order = np.lexsort((names, -best), axis=1)
    return np.take_along_axis(best, order, 1), np.take_along_axis(names, order, 1)


def knn_join(queries: DataFrame, df: DataFrame, k: int = 10, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """For each row of queries(query_id, q) the k rows of df of the highest score, as (query_id, rank, key, score).

    Queries go in blocks of at most `block` rows: a block is what is broadcast, and each passes over df once with a matrix
    product per Arrow batch, of which k rows a query leave the task.  Exact; ties by key.
    """
    n = queries.count()
    several = max(1, -(-n // block))
    out = None
    for b in range(several):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(several)) == b) if several > 1 else queries
        rows = own.select("query_id", V.vec("q").alias("q")).toArrow()
        ids = rows.column("query_id").to_numpy()
        held = df.sparkSession.sparkContext.broadcast((ids, np.array(rows.column("q").to_pylist(), float)))

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            ids, q = held.value
            if not len(ids):
                return
            best_score, best_id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
                    # a product's last bits depend on the shapes of its blocks, which mustn't decide between ties
                    found = np.round(_scores(metric, q, x), 12)
                    found[np.isnan(found)] = -np.inf
                    best_score, best_id = _best(best_score, best_id, found, part.column(0).to_numpy())
            there = np.isfinite(best_score)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], there.shape)[there]), pa.array(best_id[there]), pa.array(best_score[there])], names=["query_id", key, "score"])

        part = df.select(F.col(key).cast("long").alias(key), V.vec(vector).alias("v")).where("v is not null").mapInArrow(run, f"query_id bigint, {key} bigint, score double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def range_join(queries: DataFrame, df: DataFrame, radius: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Pairs (query_id, key, distance) within radius: pruned by norm and by the places along two unit directions at right
    angles (all components alike, and with signs in turn), since none of the three differs by more between near vectors.

    Rows are keyed by the three as multiples of the radius; a query meets its own cell and those beside it, 27 in all, so the
    join is an equi-join, rows aren't copied, and vectors of one length are told apart by the directions.  A cell that holds
    many rows is split by the engine's handling of skewed joins.
    """
    width = radius * (1 + 1e-6) + 1e-12  # a little wider, for rounding

    def cells(v: str) -> list[Column]:
        own = V.vec(v)
        total = lambda turn: F.aggregate(F.transform(own, lambda x, i: F.when(turn & (i % 2 == 1), -x).otherwise(x)), F.lit(0.0), lambda s, x: s + x)
        along = [total(F.lit(turn)) / F.sqrt(F.greatest(F.size(own), F.lit(1))) for turn in (False, True)]
        return [F.floor(x / width) for x in (V.norm(F.col(v)), *along)]

    names = ["__c0", "__c1", "__c2"]
    near, far = queries, df
    for name, asked, held in zip(names, cells("q"), cells(vector)):
        near, far = near.withColumn(name, F.explode(F.sequence(asked - 1, asked + 1))), far.withColumn(name, held)
    pairs = near.join(far, names).withColumn("distance", V.euclidean(F.col("q"), F.col(vector)))
    return pairs.where(F.col("distance") <= radius).select("query_id", key, "distance")


def recall_at_k(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """(query_id, recall, precision) of found(query_id, key) against truth(query_id, key)."""
    hits = truth.select("query_id", key).join(found.select("query_id", key).distinct().withColumn("hit", F.lit(1)), ["query_id", key], "left")
    sized = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    own = found.select("query_id", key).distinct().groupBy("query_id").agg(F.count("*").alias("m"))
    out = sized.join(own, "query_id", "left")
    return out.select("query_id", (F.col("hits") / F.col("n")).alias("recall"), F.coalesce(F.try_divide("hits", "m"), F.lit(0.0)).alias("precision"))


def top_per_group(df: DataFrame, group: str, score: Column, k: int, key: str) -> DataFrame:
    """The k best rows of each group, with score and rank; a group's rows are cut to k in each task before they move."""
    own = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def merge_shards(df: DataFrame, query: DataFrame | list[float], k: int, metric: str = "cosine", shard: str = "shard", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df has a shard column: the k best rows of each shard, as each would answer on its own, and the k best of those."""
    own = with_query(df, query)
    parts = top_per_group(own, shard, V.score(metric, F.col(vector), F.col("q")), k, key).drop("rank", "q", vector)
    best = parts.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
