"""Vector functions against numpy, with zero, equal, opposite and constant vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V

rng = np.random.default_rng(42)
A = [[0.0, 0, 0, 0], [1.0, 2, 3, 4], [1.0, 2, 3, 4], [-1.0, -2, -3, -4], [2.0, 2, 2, 2], *rng.standard_normal((20, 4)).tolist()]
B = [[1.0, 0, 0, 0], [1.0, 2, 3, 4], [0.0, 0, 0, 0], [1.0, 2, 3, 4], [-2.0, 0, 2, 0], *rng.standard_normal((20, 4)).tolist()]
A, B = ([[float(x) for x in v] for v in side] for side in (A, B))


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / n if n else 0.0


FUNCTIONS = {
    "dot": (V.dot, lambda a, b: a @ b), "cosine": (V.cosine, cos), "euclidean": (V.euclidean, lambda a, b: np.linalg.norm(a - b)), "manhattan": (V.manhattan, lambda a, b: np.abs(a - b).sum()),
    "sim01": (lambda a, b: V.similarity("cosine", a, b), lambda a, b: max(0, (cos(a, b) + 1) / 2) if np.linalg.norm(a) * np.linalg.norm(b) else 0.0),
    "sim_l2": (lambda a, b: V.similarity("l2", a, b), lambda a, b: 1 / (1 + np.linalg.norm(a - b))), "sim_ip": (lambda a, b: V.similarity("ip", a, b), lambda a, b: max(0, a @ b)),
    "norm": (lambda a, b: V.norm(a), lambda a, b: np.linalg.norm(a)), "weighted": (lambda a, b: V.weighted_sum(a), lambda a, b: (a * np.arange(1, 5)).sum()),
    "complexity": (lambda a, b: V.complexity(a), lambda a, b: (np.abs(a) * np.sqrt(np.arange(1, 5))).sum()),
}


@pytest.mark.parametrize("name", FUNCTIONS)
def test_scalar(spark, name):
    own, numpy = FUNCTIONS[name]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(A, B))], "k int, a array<double>, b array<double>")
    got = [r[1] for r in df.select("k", own(F.col("a"), F.col("b")).alias("v")).orderBy("k").collect()]
    assert got == pytest.approx([numpy(np.array(a), np.array(b)) for a, b in zip(A, B)], abs=1e-9)


def test_vectors(spark):
    df = spark.createDataFrame([(k, a) for k, a in enumerate(A)], "k int, a array<double>").orderBy("k")
    low, high = np.min(A), np.max(A)
    for own, numpy in (
        (V.normalize(F.col("a")), lambda a: a / (np.linalg.norm(a) + 1e-8)),
        (V.quantize(F.col("a"), F.lit(float(low)), F.lit(float(high)), 8), lambda a: np.round((a - low) / (high - low) * 255) / 255),
        (V.quantize_row(F.col("a"), 4), lambda a: np.clip(np.floor((a - a.min()) / ((a.max() - a.min()) / 15) + 0.5), 0, 15) if a.max() > a.min() else a * 0),
    ):
        assert np.allclose([r[0] for r in df.select(own).collect()], [numpy(np.array(a)) for a in A])


def test_dimensions_are_checked(spark):
    df = spark.createDataFrame([([1.0],)], "a array<double>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        df.select(V.checked(F.col("a"), 2)).collect()
    with pytest.raises(ValueError):
        V.score("hamming", F.col("a"), F.col("a"))
