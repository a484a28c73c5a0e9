"""Scalar functions, filters, scans and search over `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import search
from vectorloom.operators.filters import apply_filter
from vectorloom.plans.registry import query, table


def E():  # noqa: N802
    """The vector; a column can't be made before there is a session."""
    return F.col("embedding")


def Q():  # noqa: N802
    return F.col("q")


WITH = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, q FROM embeddings, q) "
SQ = "list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
MAN = "list_sum(list_transform(list_zip(v, q), lambda p: abs(p[1] - p[2])))"
COS = "list_cosine_similarity(v, q)"
DOT = "list_inner_product(v, q)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with metadata derived from it: active, category, score, tags."""
    e = table(spark, sf_dir, "embeddings")
    return e.withColumn("active", F.col("label") % 2 == 0).withColumn("category", (F.col("vec_id") % 5).cast("int")).withColumn("score", F.col("vec_id") * 0.1).withColumn("tags", F.array(F.concat(F.lit("tag_"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("tag_"), (F.col("vec_id") % 7).cast("string"))))


META = "m AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, label % 2 = 0 AS active, (vec_id % 5)::INT AS category, vec_id * 0.1::DOUBLE AS score, ['tag_' || (vec_id % 3), 'tag_' || (vec_id % 7)] AS tags FROM embeddings) "


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.with_query(e, search.one_vector(e, 0))


def scalar(name: str, value, sql: str) -> None:
    query(name, f"{WITH}SELECT vec_id, round({sql}, 6) AS value FROM e")(lambda s, d: pairs(s, d).select("vec_id", F.round(value(), 6).alias("value")))


LEN = "(sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"
scalar("vec_dot", lambda: V.dot(E(), Q()), DOT)
scalar("vec_norm", lambda: V.norm(E()), "sqrt(list_inner_product(v, v))")
scalar("vec_cosine", lambda: V.cosine(E(), Q()), COS)
scalar("vec_cosine_eps", lambda: V.cosine_eps(E(), Q()), f"{DOT} / ({LEN} + 1e-8)")
scalar("sim_cosine01", lambda: V.similarity("cosine", E(), Q()), f"greatest(0, ({COS} + 1) / 2)")
scalar("sim_l2", lambda: V.similarity("l2", E(), Q()), f"1 / (1 + sqrt({SQ}))")
scalar("sim_ip", lambda: V.similarity("ip", E(), Q()), f"greatest(0, {DOT})")
scalar("dist_to_sim_cosine", lambda: V.from_distance("cosine", 1 - V.cosine(E(), Q())), f"greatest(0, 1 - (1 - {COS}))")
scalar("dist_to_sim_l2", lambda: V.from_distance("l2", V.euclidean(E(), Q())), f"1 / (1 + sqrt({SQ}))")
scalar("dist_to_sim_ip", lambda: V.from_distance("ip", -V.dot(E(), Q())), f"greatest(0, {DOT})")
scalar("sim_to_dist_cosine", lambda: V.to_distance("cosine", V.cosine(E(), Q())), f"1 - {COS}")
scalar("sim_to_dist_l2", lambda: V.to_distance("l2", V.similarity("l2", E(), Q())), f"greatest(0, 1 / (1 / (1 + sqrt({SQ}))) - 1)")
scalar("sim_to_dist_ip", lambda: V.to_distance("ip", V.dot(E(), Q())), f"-({DOT})")
scalar("score_euclid_sq", lambda: V.score("euclidean_sq", E(), Q()), f"-({SQ})")
scalar("score_euclid", lambda: V.score("euclidean", E(), Q()), f"-sqrt({SQ})")
scalar("score_manhattan", lambda: V.score("manhattan", E(), Q()), f"-({MAN})")
scalar("vec_weighted_sum", lambda: V.weighted_sum(E()), "list_sum(list_transform(v, lambda x, i: x * i))")
scalar("vec_complexity", lambda: V.complexity(E()), "list_sum(list_transform(v, lambda x, i: abs(x) * sqrt(i)))")
ATAN = "(CASE WHEN v[1] >= 0 THEN r / (1 + abs(r)) WHEN v[2] >= 0 THEN pi() - r / (1 + abs(r)) ELSE -pi() - r / (1 + abs(r)) END)"
query("atan2_approx", f"{WITH}, a AS (SELECT vec_id, v, v[2] / (abs(v[1]) + 1e-8) AS r FROM e) SELECT vec_id, round({ATAN}, 6) AS value FROM a")(
    lambda s, d: pairs(s, d).select("vec_id", F.round(V.base_angle(E()), 6).alias("value"))
)


def elementwise(name: str, made, sql: str) -> None:
    """Vector results are compared by component."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pairs(spark, sf_dir).select("vec_id", F.posexplode(made()).alias("dim", "x")).select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("value"))

    query(name, f"{WITH}, x AS (SELECT vec_id, {sql} AS x FROM e) SELECT vec_id, unnest(range(1, len(x) + 1))::INT AS dim, round(unnest(x), 6) AS value FROM x")(run)


elementwise("vec_normalize", lambda: V.normalize(E()), "list_transform(v, lambda x: x / (sqrt(list_inner_product(v, v)) + 1e-8))")
elementwise("vec_quantize_255", lambda: V.quantize_255(E()), "list_transform(v, lambda x: round(x * 255) / 255)")
elementwise("vec_quantize_row", lambda: F.transform(V.quantize_row(E(), 4), lambda x: x.cast("double")), "list_transform(v, lambda x: least(15, greatest(0, floor((x - list_min(v)) / ((list_max(v) - list_min(v)) / 15) + 0.5)))::DOUBLE)")
elementwise("reconstruct_vector", lambda: V.add(Q(), V.subtract(E(), Q())), "list_transform(list_zip(v, q), lambda p: p[2] + (p[1] - p[2]))")


@query("vec_quantize_global", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e), x AS (SELECT vec_id, list_transform(v, lambda x: round_even((x - lo) / (hi - lo) * 255, 0) / 255) AS x FROM e, r) SELECT vec_id, unnest(range(1, len(x) + 1))::INT AS dim, round(unnest(x), 6) AS value FROM x")
def vec_quantize_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    span = e.agg(F.min(F.array_min(V.vec("embedding"))).alias("lo"), F.max(F.array_max(V.vec("embedding"))).alias("hi"))
    own = e.join(F.broadcast(span), how="cross").select("vec_id", F.posexplode(V.quantize(E(), F.col("lo"), F.col("hi"), 8)).alias("dim", "x"))
    return own.select("vec_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("value"))


@query("vec_pca")
def vec_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight principal components of the centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(V.vec("embedding")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(e).transform(e)
    made = PCA(k=8, inputCol="centred", outputCol="pc").fit(centred).transform(centred)
    return made.select("vec_id", F.transform(vector_to_array("pc"), lambda x: F.round(x, 6)).alias("components"))


@query("vec_hash")
def vec_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", V.fingerprint(E()).alias("hash"))


# ---- filters


def filtered(name: str, filters: dict, where: str) -> None:
    query(name, f"WITH {META}SELECT vec_id, label, category, active, round(score, 6) AS score FROM m WHERE {where}")(
        lambda s, d: apply_filter(vectors(s, d), filters).select("vec_id", "label", "category", "active", F.round("score", 6).alias("score"))
    )


filtered("filter_eq", {"category": 2}, "category = 2")
filtered("filter_list", {"tags": ["tag_0", "tag_5"]}, "list_has_any(tags, ['tag_0', 'tag_5'])")
filtered("filter_range", {"score": {"$gte": 2.0, "$lt": 4.0}}, "score >= 2.0 AND score < 4.0")
filtered("filter_eq_ne", {"category": {"$eq": 1}, "label": {"$ne": 3}}, "category = 1 AND label <> 3")
filtered("filter_in", {"label": {"$in": [1, 4, 7]}}, "label IN (1, 4, 7)")
filtered("filter_gt_lte_nin", {"score": {"$gt": 1.0, "$lte": 30.0}, "label": {"$nin": [0, 5]}}, "score > 1.0 AND score <= 30.0 AND label NOT IN (0, 5)")
filtered("filter_conjunction", {"category": [0, 1, 3], "active": True, "score": {"$gte": 5.0}}, "category IN (0, 1, 3) AND active AND score >= 5.0")
filtered("filter_none", {}, "true")


@query("projection_no_vectors", "SELECT vec_id, label FROM embeddings")
def projection_no_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").drop("embedding")


@query("metadata_merge", "SELECT vec_id, coalesce(CASE WHEN vec_id % 2 = 0 THEN label END, (vec_id % 5)::INT) AS merged FROM embeddings")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    stored = F.when(F.col("vec_id") % 2 == 0, F.col("label"))
    return e.select("vec_id", F.coalesce(stored, (F.col("vec_id") % 5).cast("int")).alias("merged"))


@query("dimension_check", "SELECT len(embedding)::INT AS dimensions, count(*) AS n FROM embeddings GROUP BY 1")
def dimension_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.size(V.checked(E(), 64)).alias("dimensions")).groupBy("dimensions").agg(F.count("*").alias("n"))


# ---- search

TOP = "SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM {} QUALIFY rank <= {}"


def shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("search_topk", f"{WITH}, s AS (SELECT vec_id, label, {COS} AS score FROM e) {TOP.format('s', 10)}")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return shown(search.topk(e, search.one_vector(e, 0), 10))


@query("search_filtered", f"{WITH}, s AS (SELECT vec_id, label, {COS} AS score FROM e WHERE label IN (1, 2, 3)) {TOP.format('s', 10)}")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return shown(search.topk(e, search.one_vector(e, 0), 10, filters={"label": [1, 2, 3]}))


@query("range_search", f"{WITH}, s AS (SELECT vec_id, sqrt({SQ}) AS d FROM e) SELECT vec_id, round(d, 6) AS distance FROM s WHERE d <= 1.2 ORDER BY d, vec_id LIMIT 1000")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.range_search(e, search.one_vector(e, 0), 1.2).select("vec_id", F.round("distance", 6).alias("distance"))


@query("similar_excluding_self", f"{WITH}, s AS (SELECT vec_id, label, {COS} AS score FROM e WHERE vec_id <> 0) {TOP.format('s', 5)}")
def similar_excluding_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return shown(search.topk(e.where("vec_id <> 0"), search.one_vector(e, 0), 5))


@query("recommend_items", f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, q FROM embeddings, q WHERE label % 2 = 1), s AS (SELECT vec_id, label, {DOT} AS score FROM e) {TOP.format('s', 8)}")
def recommend_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of one table by id, searched in another: odd labels are the items."""
    e = table(spark, sf_dir, "embeddings")
    return shown(search.topk(e.where("label % 2 = 1"), search.one_vector(e, 3), 8, "dot"))


@query("topk_per_label", f"{WITH}, s AS (SELECT vec_id, label, {COS} AS score FROM e) SELECT vec_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3")
def topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(search.top_per_group(pairs(spark, sf_dir), "label", V.cosine(E(), Q()), 3, "vec_id"))


@query("shard_merge_topk", f"{WITH}, s AS (SELECT vec_id, label, {DOT} AS score, vec_id % 8 AS shard FROM e), t AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, vec_id) AS r FROM s QUALIFY r <= 5) {TOP.format('t', 5)}")
def shard_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each shard, then the best of those."""
    e = table(spark, sf_dir, "embeddings").withColumn("shard", F.col("vec_id") % 8)
    return shown(search.merge_shards(e, search.one_vector(e, 0), 5, "dot"))


@query("score_rank", "WITH s AS (SELECT label, avg(len(embedding)) * 0 + count(*) AS n, label / 10.0 AS ratio FROM embeddings GROUP BY label), t AS (SELECT label, CASE WHEN label = 9 THEN -1.0 ELSE (label % 4) / 4.0 * ratio - 0.5 * abs(ratio - 0.7) END AS score FROM s) SELECT label, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, label)::INT AS rank FROM t")
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter sets by quality * ratio - 0.5 * |ratio - target|, failures at -1; ratio label / 10, quality label % 4 / 4."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "embeddings").select("label").distinct().withColumn("ratio", F.col("label") / 10.0)
    score = F.when(F.col("label") == 9, -1.0).otherwise((F.col("label") % 4) / 4.0 * F.col("ratio") - 0.5 * F.abs(F.col("ratio") - 0.7))
    own = own.withColumn("score", score)
    return own.select("label", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(F.desc("score"), "label")).alias("rank"))


# ---- joins

BOTH = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, {} AS score FROM q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10"


def queries_of(e: DataFrame) -> DataFrame:
    """The query set of joins: every row whose id is divisible by 20."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), E().alias("q"))


def joined(name: str, metric: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = table(spark, sf_dir, "embeddings")
        return search.knn_join(queries_of(e), e, 10, metric).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")

    query(name, BOTH.format(sql))(run)


joined("knn_join_cosine", "cosine", COS)
joined("knn_join_dot", "dot", DOT)
joined("knn_join_euclid", "euclidean", f"-sqrt({SQ})")
joined("knn_join_manhattan", "manhattan", f"-({MAN})")


@query("range_join", f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, sqrt({SQ}) AS d FROM q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)) SELECT query_id, vec_id, round(d, 6) AS distance FROM s WHERE d <= 1.0")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.range_join(queries_of(e), e, 1.0).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query("brute_topk", BOTH.format(COS).replace("rank <= 10", "rank <= 1").replace("(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "(SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) WHERE vec_id <> query_id"))
def brute_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth by expressions: the nearest other vector of each query."""
    e = table(spark, sf_dir, "embeddings")
    found = search.knn_join(queries_of(e), e, 2).where("query_id <> vec_id")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", rank).where("rank = 1").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("recall_at_k", f"WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT query_id, vec_id, {COS} AS c, {DOT} * (vec_id % 3) AS d FROM q, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), t AS (SELECT query_id, vec_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) <= 10), a AS (SELECT query_id, vec_id FROM b WHERE vec_id % 3 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) <= 10) SELECT t.query_id, round(count(a.vec_id) / 10.0, 6) AS recall, round(count(a.vec_id) / 10.0, 6) AS \"precision\" FROM t LEFT JOIN a USING (query_id, vec_id) GROUP BY t.query_id")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search that sees two thirds of the rows, against the whole."""
    e = table(spark, sf_dir, "embeddings")
    found, truth = search.knn_join(queries_of(e), e.where("vec_id % 3 > 0"), 10), search.knn_join(queries_of(e), e, 10)
    return search.recall_at_k(found, truth).select("query_id", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


# ---- scans and the stored table


@query("vector_by_id", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id = 7")
def vector_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("vec_id", "label", F.round(V.total(V.vec("embedding")), 6).alias("total"))


@query("vectors_by_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 1, 4, 15, 92)")
def vectors_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(3, 1, 4, 15, 92)).select("vec_id", "label").orderBy("vec_id")


@query("count_vectors", "SELECT count(*) AS n FROM embeddings")
def count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))


@query("catalog_join", "SELECT e.vec_id, s.seq_id, s.vector_count FROM (SELECT vec_id, vec_id // 100 AS seq_id FROM embeddings) e JOIN (SELECT vec_id // 100 AS seq_id, count(*) AS vector_count FROM embeddings GROUP BY 1) s ON e.seq_id = s.seq_id")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 100").alias("seq_id"))
    return e.join(e.groupBy("seq_id").agg(F.count("*").alias("vector_count")), "seq_id").select("vec_id", "seq_id", "vector_count")


@query("semi_ids", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
def semi_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels"), F.col("vec_id") == F.col("doc_id"), "left_semi").select("vec_id", "label")


@query("anti_deleted", "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "labels"), F.col("vec_id") == F.col("doc_id"), "left_anti").select("vec_id", "label")


def stored(spark: SparkSession, sf_dir: str):
    """The embeddings as a VectorTable in the shared folder, in two batches."""
    import uuid

    from vectorloom.plans.scratch import shared_dir
    from vectorloom.sources.store import VectorTable

    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").first()
    made = VectorTable(spark, f"{shared_dir(spark)}/vectorloom/table-{uuid.uuid4().hex}", 64, [float(x) for x in first["embedding"]])
    made.save()
    made.insert(e.where("vec_id % 2 = 0"))
    made.insert(e.where("vec_id % 2 = 1"))
    return made


@query("insert_and_read", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def insert_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append in two batches, save, load, read."""
    from vectorloom.sources.store import VectorTable

    return VectorTable.load(spark, stored(spark, sf_dir).path).read().select("vec_id", "label", F.round(V.total(V.vec("embedding")), 6).alias("total"))


@query("delete_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0")
def delete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(spark, sf_dir)
    own.delete(table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select("vec_id"))
    return own.read().select("vec_id", "label")


@query("update_vector", "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def update_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(spark, sf_dir)
    own.update(table(spark, sf_dir, "embeddings").where("vec_id % 11 = 0").withColumn("label", F.col("label") + 100))
    own.optimize()
    return own.read().select("vec_id", "label")


@query("delete_sequence", "SELECT vec_id, label FROM embeddings WHERE vec_id // 100 <> 1")
def delete_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("seq_id", F.expr("vec_id div 100"))
    gone = spark.createDataFrame([(1,)], "seq_id bigint")
    return e.join(F.broadcast(gone), "seq_id", "left_anti").select("vec_id", "label")


@query("latest_sequence", "SELECT vec_id // 100 AS seq_id, count(*) AS vector_count FROM embeddings GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def latest_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("seq_id", F.expr("vec_id div 100"))
    return e.groupBy("seq_id").agg(F.count("*").alias("vector_count")).orderBy(F.desc("seq_id")).limit(1)


@query("table_stats", "SELECT count(*) AS vectors, 64 AS dimensions, count(*) * 256 AS raw_bytes, 2::BIGINT AS batches FROM embeddings")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).stats().select("vectors", "dimensions", "raw_bytes", "batches")


@query("table_search", f"{WITH}, s AS (SELECT vec_id, label, {COS} AS score FROM e WHERE label >= 3) {TOP.format('s', 10)}")
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = stored(spark, sf_dir)
    return shown(own.search(own.reference, 10, filters={"label": {"$gte": 3}}))


@query("synthetic_vectors")
def synthetic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded generators, as many rows as embeddings has."""
    from vectorloom.sources import generators as G

    n = table(spark, sf_dir, "embeddings").count()
    kinds = {"random": G.random_vectors, "normalized": G.normalized_vectors, "correlated": G.correlated_vectors, "clustered": G.clustered_vectors}
    out = None
    for kind, make in kinds.items():
        part = make(spark, n, 16).agg(F.count("*").alias("n"), F.round(F.avg(V.norm(E())), 3).alias("mean_norm")).select(F.lit(kind).alias("kind"), "n", "mean_norm")
        out = part if out is None else out.unionByName(part)
    return out


# ---- set operations


@query("set_intersect", "SELECT vec_id FROM embeddings WHERE label < 6 INTERSECT SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.where("label < 6").select("vec_id").intersect(e.where("vec_id % 3 = 0").select("vec_id"))


@query("set_symdiff", "(SELECT vec_id FROM embeddings WHERE (label < 6) <> (vec_id % 3 = 0))")
def set_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.where("label < 6").select("vec_id"), e.where("vec_id % 3 = 0").select("vec_id")
    return a.union(b).groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 1").select("vec_id")


@query("union_shards", "SELECT label, count(*) AS n FROM (SELECT label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT label FROM embeddings WHERE vec_id % 3 = 0) GROUP BY label")
def union_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.where("vec_id % 2 = 0").unionByName(e.where("vec_id % 3 = 0")).groupBy("label").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_filtered(spark, sf_dir)

