"""Sequences stored encoded: anchors as they are, other vectors as codes of their difference to the nearest anchor.

Layout under one path: encoded/ (append-only, in order of sequence; anchor is null but for anchors, codes, a list for each level, null for anchors),
codebook/ (level, subspace, code, centroid) and meta/.  Level k codes the difference at half the scale of the level before.
Reads decode where the rows are: a join with the anchors of the sequence and a broadcast of one level of the codebook, which
has m * 2**bits rows.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import compress


class EncodedTable:
    def __init__(self, spark: SparkSession, path: str, dimensions: int, stride: int = 16, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.dimensions, self.stride, self.key, self.vector = spark, path.rstrip("/"), dimensions, stride, key, vector

    def train(self, rows: DataFrame, bits: int = 8, m: int = 8, levels: int = 4, iterations: int = 20) -> None:
        """rows(seq_id, pos, vector): a codebook for each level from the differences, with as many codes as they can fill."""
        own = compress.deltas(rows, self.stride, self.vector).select("delta").persist()
        m = compress.subspaces(self.dimensions, m)
        bits = compress.fitting_bits(own.count(), bits, m)
        books = [compress.train_codebook(own.select(compress.level(F.col("delta"), k).alias("x")), bits, m, self.dimensions, "x", iterations=iterations).withColumn("level", F.lit(k)) for k in range(levels)]
        self.set_codebook(reduce(DataFrame.unionByName, books))
        own.unpersist()

    def set_codebook(self, codebook: DataFrame) -> None:
        """codebook(level, subspace, code, centroid): saved, with the table's parameters, as the state that load() reads."""
        codebook.select("level", "subspace", "code", V.vec("centroid").alias("centroid")).write.mode("overwrite").parquet(f"{self.path}/codebook")
        meta = {"dimensions": self.dimensions, "stride": self.stride, "key": self.key, "vector": self.vector}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncodedTable:
        meta = json.loads(spark.read.text(f"{path.rstrip('/')}/meta").first()[0])
        return cls(spark, path, meta["dimensions"], meta["stride"], meta["key"], meta["vector"])

    def codebook(self, level: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/codebook").where(F.col("level") == level).drop("level")

    def levels(self) -> int:
        return (self.spark.read.parquet(f"{self.path}/codebook").agg(F.max("level")).first()[0] or 0) + 1

    def write(self, rows: DataFrame) -> None:
        """Append whole sequences: rows(seq_id, pos, key, vector, metadata ...)."""
        rows = rows.withColumn(self.vector, V.checked(F.col(self.vector), self.dimensions))
        own = compress.with_size(rows)
        anchors = own.where(compress.is_anchor(F.col("pos"), F.col("n"), self.stride)).drop("n").withColumnRenamed(self.vector, "anchor")
        anchors = anchors.withColumns({"anchor_pos": F.col("pos").cast("long"), "codes": F.lit(None).cast("array<array<int>>")})
        coded = compress.deltas(rows, self.stride, self.vector)
        n = self.levels()
        for k in range(n):
            coded = coded.withColumn("part", compress.level(F.col("delta"), k))
            coded = compress.pq_encode(coded, self.codebook(k), self.key, "part").withColumnRenamed("codes", f"codes{k}").drop("part")
        coded = coded.withColumn("codes", F.array(*(F.transform(f"codes{k}", lambda c: c.cast("int")) for k in range(n))))
        coded = coded.withColumns({"anchor": F.lit(None).cast(rows.schema[self.vector].dataType), "anchor_pos": F.col("anchor_pos").cast("long")})
        both = anchors.unionByName(coded.select(anchors.columns))
        both.repartitionByRange("seq_id", "pos").sortWithinPartitions("seq_id", "pos").write.mode("append").parquet(f"{self.path}/encoded")

    def stored(self) -> DataFrame:
        """Rows as stored.  Files and their row groups hold ranges of seq_id, so a read of one sequence skips the others by their
        statistics, and the number of files follows the bytes, not the sequences."""
        return self.spark.read.parquet(f"{self.path}/encoded")

    def read(self, level: int = 0, sequence: int | None = None) -> DataFrame:
        """Rows with their vectors decoded from one level; anchors are exact."""
        own = self.stored()
        own = own if sequence is None else own.where(F.col("seq_id") == sequence)
        kept = own.where("codes is null").withColumn(self.vector, V.vec("anchor")).drop("anchor", "codes", "anchor_pos")
        anchors = own.where("codes is null").select("seq_id", "anchor_pos", V.vec("anchor").alias("base"))
        coded = own.where("codes is not null").withColumn("codes", F.col("codes")[level]).drop("anchor").join(anchors, ["seq_id", "anchor_pos"])
        coded = compress.pq_decode(coded, self.codebook(level))
        coded = coded.withColumn(self.vector, V.add(F.col("base"), V.scale(F.col("decoded"), 2.0**level)))
        return kept.unionByName(coded.select(kept.columns))

    def sizes(self, m: int) -> DataFrame:
        return compress.sizes(self.stored(), self.dimensions, self.stride, m, self.levels())

