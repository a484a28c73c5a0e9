"""A table of vectors as Parquet: append, delete, update, compact, statistics, save and load.

Layout under one path: data-N/ (append-only, in order of theta), tombstones-N/ (ids deleted, with the batch from which on an
id is live again) and meta-N/ (dimensions and reference vector).  Reads join tombstones away; optimize() writes version N + 1
without them, rebuild() one for another reference.  The version is the greatest N whose data folder has Spark's mark of success, so a rewrite counts once it is
whole, and one that ends early changes nothing.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import angular, search


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _version(spark: SparkSession, path: str) -> int:
    files, at = _files(spark, path)
    found = files.globStatus(at(f"{path}/data-*/_SUCCESS")) or []
    return max((int(x.getPath().getParent().getName().split("-")[1]) for x in found), default=1)


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, dimensions: int, reference: list[float], key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.dimensions, self.reference, self.key, self.vector = spark, path.rstrip("/"), dimensions, [float(x) for x in reference], key, vector
        if len(self.reference) != dimensions:
            raise ValueError("the reference has another size than the vectors")

    # ---- state

    def save(self, version: int | None = None) -> None:
        meta = {"dimensions": self.dimensions, "reference": self.reference, "key": self.key, "vector": self.vector}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta-{version or self.version()}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorTable:
        path = path.rstrip("/")
        meta = json.loads(spark.read.text(f"{path}/meta-{_version(spark, path)}").first()[0])
        return cls(spark, path, meta["dimensions"], meta["reference"], meta["key"], meta["vector"])

    def _exists(self, name: str) -> bool:
        files, at = _files(self.spark, self.path)
        return files.exists(at(f"{self.path}/{name}"))

    def version(self) -> int:
        return _version(self.spark, self.path)

    def _batch(self) -> int:
        data = f"data-{self.version()}"
        return (self.spark.read.parquet(f"{self.path}/{data}").agg(F.max("batch")).first()[0] or 0) + 1 if self._exists(data) else 1

    # ---- writing

    def _derived(self, rows: DataFrame) -> DataFrame:
        return angular.transform(rows, self.reference, self.vector).withColumn("region_id", angular.region(F.col("theta")))

    def insert(self, rows: DataFrame) -> None:
        """Append rows: key, vector and metadata columns.  Vectors of another size are an error; a row keeps its metadata."""
        rows = rows.withColumn(self.vector, V.checked(F.col(self.vector), self.dimensions))
        rows = self._derived(rows).withColumn("batch", F.lit(self._batch()).cast("long"))
        rows.repartitionByRange("theta", self.key).sortWithinPartitions("theta", self.key).write.mode("append").parquet(f"{self.path}/data-{self.version()}")

    def delete(self, ids: DataFrame) -> int:
        """ids(key): returns how many live rows it hides."""
        gone = self.read().join(ids.select(self.key).distinct(), self.key, "left_semi").select(self.key)
        n = gone.count()
        gone.select(self.key, F.lit(self._batch()).cast("long").alias("before")).write.mode("append").parquet(f"{self.path}/tombstones-{self.version()}")
        return n

    def update(self, rows: DataFrame) -> None:
        """Replace rows by key; ids stay."""
        self.delete(rows.select(self.key))
        self.insert(rows)

    def _rewrite(self, live: DataFrame) -> None:
        files, at = _files(self.spark, self.path)
        old = self.version()
        files.delete(at(f"{self.path}/data-{old + 1}"), True)  # of a rewrite that did not end
        self.save(old + 1)
        live = live.withColumn("batch", F.lit(1).cast("long"))
        live.repartitionByRange("theta", self.key).sortWithinPartitions("theta", self.key).write.parquet(f"{self.path}/data-{old + 1}")
        for name in ("data", "tombstones", "meta"):
            files.delete(at(f"{self.path}/{name}-{old}"), True)

    def optimize(self) -> None:
        """Rewrite without deleted rows, in order, as the next version; then drop the one before."""
        self._rewrite(self.read(system=True))

    def rebuild(self, reference: list[float] | None = None) -> None:
        """optimize(), with the derived columns computed anew, from another reference if one is given."""
        live = self.read()
        new = VectorTable(self.spark, self.path, self.dimensions, reference or self.reference, self.key, self.vector)
        new._rewrite(new._derived(live))
        self.reference = new.reference

    def backup(self, path: str) -> None:
        self.read(system=True).write.parquet(f"{path.rstrip('/')}/data-1")
        VectorTable(self.spark, path, self.dimensions, self.reference, self.key, self.vector).save()

    # ---- reading

    def read(self, system: bool = False) -> DataFrame:
        """Live rows; system: with theta, radius, region_id and batch."""
        version = self.version()
        data = self.spark.read.parquet(f"{self.path}/data-{version}")
        if self._exists(f"tombstones-{version}"):
            gone = self.spark.read.parquet(f"{self.path}/tombstones-{version}").groupBy(self.key).agg(F.max("before").alias("before"))
            data = data.join(gone, self.key, "left").where(F.col("before").isNull() | (F.col("batch") >= F.col("before"))).drop("before")
        return data if system else data.drop("theta", "radius", "region_id", "batch")

    def get(self, id: Any) -> dict:
        row = self.read().where(F.col(self.key) == id).first()
        if row is None:
            raise ValueError(f"no vector {id!r}")
        return row.asDict()

    def get_many(self, ids: list) -> DataFrame:
        return self.read().where(F.col(self.key).isin(ids))

    def search(self, query: list[float], k: int = 10, metric: str = "cosine", filters: dict[str, Any] | None = None, mode: str = "exact", return_vectors: bool = False) -> DataFrame:
        """mode "exact", or "pruned": only regions near the query's angle, approximate."""
        if len(query) != self.dimensions:
            raise ValueError(f"expected {self.dimensions} dimensions, found {len(query)}")
        if mode not in ("exact", "pruned"):
            raise ValueError(f"unknown mode {mode!r}")
        rows = self.read(system=True)
        if mode == "pruned":
            theta = angular.angle(V.constant(query), V.constant(self.reference))
            apart = F.pmod(F.col("region_id") - angular.region(theta), F.lit(angular.REGIONS))
            reach = max(1, min(10, k // 10))
            rows = rows.where((apart <= reach) | (apart >= angular.REGIONS - reach))
        return search.topk(rows.drop("theta", "radius", "region_id", "batch"), [float(x) for x in query], k, metric, filters, self.key, self.vector, return_vectors)

    def stats(self) -> DataFrame:
        own = self.read(system=True)
        return own.agg(F.count("*").alias("vectors"), F.lit(self.dimensions).alias("dimensions"), (F.count("*") * self.dimensions * 4).alias("raw_bytes"), F.count_distinct("region_id").alias("regions"), F.count_distinct("batch").alias("batches"))
