"""Anchors, deltas, product quantization and their measures.  Sequences have seq_id and pos, 0-based without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators.quantiles import quantiles


def with_size(df: DataFrame) -> DataFrame:
    """Adds n, the size of each sequence."""
    return df.join(df.groupBy("seq_id").agg(F.count("*").alias("n")), "seq_id")


def anchor_pos(pos: Column, n: Column, stride: int) -> Column:
    """The nearest of the positions 0, stride, 2 * stride, ... and n - 1; the lower of two as near."""
    low = pos - pos % stride
    high = F.least(low + stride, n - 1)
    return F.when(pos - low <= high - pos, low).otherwise(high)


def is_anchor(pos: Column, n: Column, stride: int) -> Column:
    return (pos % stride == 0) | (pos == n - 1)


def deltas(df: DataFrame, stride: int = 16, vector: str = "embedding") -> DataFrame:
    """df(seq_id, pos, vector, ...) to rows that aren't anchors, with anchor_pos, anchor and delta."""
    own = with_size(df).withColumn("is_anchor", is_anchor(F.col("pos"), F.col("n"), stride)).withColumn("anchor_pos", anchor_pos(F.col("pos"), F.col("n"), stride))
    anchors = own.where("is_anchor").select("seq_id", F.col("pos").alias("anchor_pos"), V.vec(vector).alias("anchor"))
    return own.where("not is_anchor").join(anchors, ["seq_id", "anchor_pos"]).withColumn("delta", V.subtract(F.col(vector), F.col("anchor")))


def level(delta: Column, k: int) -> Column:
    """Level k of the hierarchy: the same delta at half the scale of the level before."""
    return V.scale(delta, 0.5**k)


def subspaces(dimensions: int, m: int) -> int:
    """The greatest number of subspaces up to m that divides the dimensions."""
    m = max(1, min(m, dimensions))
    return next(k for k in range(m, 0, -1) if dimensions % k == 0)


def fitting_bits(n: int, bits: int, m: int) -> int:
    """Bits that n training rows can fill."""
    if n >= 5 * 2**bits:
        return bits
    return max(1, min(bits, (n // max(1, m)).bit_length() - 1))


def codebook_from_rows(df: DataFrame, k: int, m: int, dimensions: int, vector: str = "embedding", ordinal: str = "ordinal") -> DataFrame:
    """codebook(subspace, code, centroid) from the rows at ordinals floor(i * n / k): k * m rows."""
    width = dimensions // m
    n = df.agg(F.count("*").alias("n"))
    picks = n.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("code"), "n").select("code", F.floor(F.col("code") * F.col("n") / k).alias(ordinal))
    rows = df.join(F.broadcast(picks), ordinal)
    return rows.select("code", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("subspace"), V.vec(vector).alias("v")).select("subspace", "code", F.slice("v", F.col("subspace") * width + 1, width).alias("centroid"))


def train_codebook(df: DataFrame, bits: int, m: int, dimensions: int, vector: str = "embedding", seed: int = 42, iterations: int = 20) -> DataFrame:
    """codebook by k-means in each subspace, by pyspark.ml; 2**bits codes at most."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width, spark = dimensions // m, df.sparkSession
    rows = []
    for s in range(m):
        part = df.select(array_to_vector(F.slice(V.vec(vector), s * width + 1, width)).alias("features"))
        model = KMeans(k=2**bits, seed=seed, maxIter=iterations).fit(part)
        rows += [(s, c, [float(x) for x in centre]) for c, centre in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "subspace int, code int, centroid array<double>")


def pq_encode(df: DataFrame, codebook: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Adds codes, the nearest centroid of each subspace, the lowest of equals.  The codebook, m * 2**bits rows, becomes one
    row of arrays, so a vector is encoded where it is and no rows are made."""
    book = codebook.groupBy("subspace").agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("entries"))
    book = book.agg(F.array_sort(F.collect_list(F.struct("subspace", "entries"))).alias("book"))

    def best(s: Column) -> Column:
        width = F.size(s["entries"][0]["centroid"])
        own = F.slice(V.vec(vector), s["subspace"] * width + 1, width)
        return F.array_min(F.transform(s["entries"], lambda e: F.struct(V.squared_distance(own, e["centroid"]).alias("d"), e["code"].alias("code"))))["code"]

    return df.join(F.broadcast(book), how="cross").withColumn("codes", F.transform("book", best)).drop("book")


def pq_decode(df: DataFrame, codebook: DataFrame, into: str = "decoded") -> DataFrame:
    """Adds the vector of centroids; a code beyond the codebook is its last."""
    book = codebook.groupBy("subspace").agg(F.array_sort(F.collect_list(F.struct("code", "centroid"))).alias("entries"))
    book = book.agg(F.array_sort(F.collect_list(F.struct("subspace", "entries"))).alias("book"))
    pick = lambda s, i: F.element_at(s["entries"], F.least(F.element_at("codes", i + 1) + 1, F.size(s["entries"])))["centroid"]
    return df.join(F.broadcast(book), how="cross").withColumn(into, F.flatten(F.transform("book", pick))).drop("book")


def sizes(df: DataFrame, dimensions: int, stride: int, m: int, levels: int) -> DataFrame:
    """Bytes of each sequence raw and encoded (float32 anchors, a byte a code, headers), and the ratio raw and clamped."""
    own = with_size(df).groupBy("seq_id").agg(F.first("n").alias("n"), F.count_if(is_anchor(F.col("pos"), F.col("n"), stride)).alias("anchors"))
    encoded = F.col("anchors") * dimensions * 4 + (F.col("n") - F.col("anchors")) * m * levels + 1024 + 16 * F.col("anchors") + 8 * levels
    out = own.withColumn("raw_bytes", F.col("n") * dimensions * 4).withColumn("encoded_bytes", encoded)
    return out.withColumn("ratio", 1 - F.col("encoded_bytes") / F.col("raw_bytes")).withColumn("clamped_ratio", F.least(F.lit(0.70), F.greatest(F.lit(0.30), F.col("ratio"))))


def pairwise(df: DataFrame, previous: str, vector: str = "embedding", threshold: float = 0.01) -> DataFrame:
    """Delta to the previous vector with small components zeroed: kept, error and ratio."""
    delta = V.subtract(F.col(vector), F.col(previous))
    out = df.withColumn("delta", delta).withColumn("kept", F.transform("delta", lambda x: F.when(F.abs(x) <= threshold, 0.0).otherwise(x)))
    whole = V.norm(F.col("delta"))
    return out.withColumn("error", V.euclidean(F.col("delta"), F.col("kept"))).withColumn("ratio", F.when(whole == 0, 0.0).otherwise(1 - V.norm(F.col("kept")) / whole))


def reconstruction(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row of measures of b against a."""
    x, y = F.col(a), F.col(b)
    n = F.size(x)
    rows = df.select(V.cosine(x, y).alias("cos"), (V.squared_distance(x, y) / n).alias("mse"), (V.manhattan(x, y) / n).alias("mae"), (V.euclidean(x, y) / V.norm(x)).alias("rel"), (V.norm(y) / V.norm(x)).alias("mag"))
    own = rows.agg(
        F.avg("cos").alias("cosine_mean"), F.stddev_pop("cos").alias("cosine_std"), F.min("cos").alias("cosine_min"),
        F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("rel").alias("relative_error"), F.avg("mag").alias("magnitude"),
        (0.8 * F.avg("cos") + 0.2 * (1 - F.avg("mae"))).alias("quality_score"), (F.avg("cos") * (1 - F.avg("rel"))).alias("composite_score"),
    )
    return own.join(quantiles(rows, [], "cos", {"cosine_p10": 0.1}), how="cross")


def moments(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, scale): the population standard deviation of each dimension."""
    return df.select(F.posexplode(V.vec(vector)).alias("dim", "x")).groupBy("dim").agg(F.stddev_pop("x").alias("scale"))


def estimated_ratio(df: DataFrame, previous: str, vector: str = "embedding") -> DataFrame:
    """One row: 1 - 2 * mean step / mean norm, in [0, 0.9]; 0 for under two rows."""
    own = df.agg(F.avg(V.euclidean(F.col(vector), F.col(previous))).alias("step"), F.avg(V.norm(F.col(vector))).alias("length"))
    return own.select(F.when(F.col("step").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.9), 1 - 2 * F.col("step") / F.col("length")))).otherwise(0.0).alias("ratio"))


def in_sequences(df: DataFrame, size: int = 100, key: str = "vec_id") -> DataFrame:
    """df with theta: seq_id is key div size, pos the place by (theta, key) in the sequence."""
    own = df.withColumn("seq_id", F.expr(f"{key} div {size}"))
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("seq_id").orderBy("theta", key)) - 1)


def distinct_parts(df: DataFrame, m: int, dimensions: int, decimals: int = 6, vector: str = "embedding") -> DataFrame:
    """(subspace, n): the different parts of vectors in each of m subspaces, to so many decimals."""
    width = dimensions // m
    own = df.select(F.transform(V.vec(vector), lambda x: F.round(x, decimals)).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("subspace"))
    parts = own.select("subspace", F.slice("v", F.col("subspace") * width + 1, width).alias("part")).distinct()
    return parts.groupBy("subspace").agg(F.count("*").alias("n"))
