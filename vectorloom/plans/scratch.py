"""Lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset on one machine (tests) a temporary folder is set; on a
    cluster, whose executors wouldn't see that, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="vectorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES, whatever the length of texts, unless the session says otherwise."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the plan after it starts from shared files, so a lost
    executor costs no recomputation of what came before, and values that depend on placement stay as they were."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/vectorloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete what cut() has written; results that still depend on it can't be read afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before the interpreter
            return


atexit.register(clear)
