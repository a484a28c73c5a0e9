"""Angular ordering, compression and neighbour structures over `embeddings`.

The reference vector is that of vec_id 0.  Angles near 0 are ill-conditioned, so that row's own angle is compared as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import angular, ann, compress, search
from vectorloom.operators.ranking import global_rank, with_previous
from vectorloom.plans.registry import query, table
from vectorloom.plans.vector_queries import E, queries_of

THETA = "CASE WHEN vec_id = 0 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, list_cosine_similarity(v, q)))) END"
BASE = f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, q FROM embeddings, q), t AS (SELECT vec_id, label, v, {THETA} AS theta, sqrt(list_inner_product(v, v)) AS radius FROM e), o AS (SELECT *, row_number() OVER (ORDER BY theta, vec_id) - 1 AS ordinal FROM t), "
SEQ = BASE + "p AS (SELECT *, vec_id // 100 AS seq_id, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY theta, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY vec_id // 100) AS n FROM t), k AS (SELECT *, (pos % 16 = 0 OR pos = n - 1) AS is_anchor, CASE WHEN pos % 16 <= least(pos - pos % 16 + 16, n - 1) - pos THEN pos - pos % 16 ELSE least(pos - pos % 16 + 16, n - 1) END AS anchor_pos FROM p), d AS (SELECT k.*, a.v AS anchor, list_transform(list_zip(k.v, a.v), lambda p: p[1] - p[2]) AS delta FROM k JOIN k a ON k.seq_id = a.seq_id AND k.anchor_pos = a.pos WHERE NOT k.is_anchor), "
ID = BASE.replace("row_number() OVER (ORDER BY theta, vec_id)", "row_number() OVER (ORDER BY vec_id)")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    own = angular.transform(e, search.one_vector(e, 0))
    return own.withColumn("theta", F.when(F.col("vec_id") == 0, 0.0).otherwise(F.col("theta")))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with ordinal by vec_id."""
    return global_rank(table(spark, sf_dir, "embeddings"), ["vec_id"])


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.in_sequences(placed(spark, sf_dir))


@query("spiral_transform", BASE[:-2] + " SELECT vec_id, round(theta, 6) AS theta, round(radius, 6) AS radius FROM t")
def spiral_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("vec_id", F.round("theta", 6).alias("theta"), F.round("radius", 6).alias("radius"))


@query("spiral_sort", BASE[:-2] + " SELECT vec_id, ordinal FROM o")
def spiral_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angular.sort(placed(spark, sf_dir)).select("vec_id", "ordinal")


@query("spiral_clusters", BASE[:-2] + " SELECT vec_id, least(ordinal // ((SELECT count(*) FROM t) // 7), 6)::INT AS cluster_id FROM o")
def spiral_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angular.clusters(placed(spark, sf_dir), 7).select("vec_id", "cluster_id")


@query("spiral_neighbors", BASE + "x AS (SELECT theta AS qt, radius AS qr FROM t WHERE vec_id = 5) SELECT vec_id, round(0.7 * abs(theta - qt) + 0.3 * abs(radius - qr), 6) AS distance FROM t, x ORDER BY 0.7 * abs(theta - qt) + 0.3 * abs(radius - qr), vec_id LIMIT 5")
def spiral_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = placed(spark, sf_dir)
    target = own.where("vec_id = 5").select(F.col("theta").alias("qt"), F.col("radius").alias("qr"))
    both = own.join(F.broadcast(target), how="cross")
    return angular.neighbours(both, F.col("qt"), F.col("qr"), 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query("spiral_potential", BASE + "s AS (SELECT theta - lag(theta) OVER (ORDER BY ordinal) AS step FROM o) SELECT round(greatest(0, least(1, 1 - avg(abs(step)) / pi())), 6) AS potential FROM s")
def spiral_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angular.potential(placed(spark, sf_dir)).select(F.round("potential", 6).alias("potential"))


@query("spiral_regions", BASE[:-2] + " SELECT vec_id, floor(theta / (2 * pi()) * 100)::INT AS region_id FROM t")
def spiral_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("vec_id", angular.region(F.col("theta")).alias("region_id"))


@query("region_histogram", BASE[:-2] + " SELECT floor(theta / (2 * pi()) * 100)::INT AS region_id, count(*) AS n FROM t GROUP BY 1")
def region_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiral_regions(spark, sf_dir).groupBy("region_id").agg(F.count("*").alias("n"))


REGION = "g AS (SELECT *, floor(theta / (2 * pi()) * 100)::INT AS region_id FROM t), x AS (SELECT theta AS qt, radius AS qr, region_id AS qg FROM g WHERE vec_id = 5), r AS (SELECT region_id, arg_min(radius, vec_id) AS fr FROM g GROUP BY 1), w AS (SELECT region_id, ((region_id - qg + 100) % 100) AS apart, abs(fr - qr) / greatest(qr, 0.1) <= 0.2 AS alike FROM r, x)"


@query("relevant_regions", BASE + REGION + " SELECT region_id, (apart <= 1 OR apart >= 99) AS near, alike FROM w")
def relevant_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = placed(spark, sf_dir).withColumn("region_id", angular.region(F.col("theta")))
    target = own.where("vec_id = 5").select(F.col("theta").alias("qt"), F.col("radius").alias("qr"))
    firsts = own.join(F.broadcast(target), how="cross")
    first = firsts.groupBy("region_id").agg(F.min_by("radius", "vec_id").alias("radius"), F.first("qt").alias("qt"), F.first("qr").alias("qr")).withColumn("vec_id", F.lit(0)).withColumn("theta", F.lit(0.0))
    apart = F.pmod(F.col("region_id") - angular.region(F.col("qt")), F.lit(angular.REGIONS))
    alike = F.abs(F.col("radius") - F.col("qr")) / F.greatest(F.col("qr"), F.lit(0.1)) <= 0.2
    return first.select("region_id", ((apart <= 1) | (apart >= 99)).alias("near"), alike.alias("alike"))


@query("candidate_join", BASE + REGION + " SELECT g.vec_id, g.region_id FROM g JOIN w USING (region_id) WHERE apart <= 1 OR apart >= 99")
def candidate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = placed(spark, sf_dir).withColumn("region_id", angular.region(F.col("theta")))
    near = relevant_regions(spark, sf_dir).where("near").select("region_id")
    return own.join(F.broadcast(near.limit(angular.REGIONS)), "region_id").select("vec_id", "region_id")


@query("search_spiral", BASE + "x AS (SELECT v AS qv FROM t WHERE vec_id = 5), s AS (SELECT vec_id, greatest(0, (list_cosine_similarity(v, qv) + 1) / 2) AS similarity FROM t, x) SELECT vec_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, vec_id LIMIT 10")
def search_spiral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the relevant regions (near or alike), exactly rescored."""
    own = placed(spark, sf_dir).withColumn("region_id", angular.region(F.col("theta")))
    regions = relevant_regions(spark, sf_dir).where("near or alike").select("region_id").limit(angular.REGIONS)
    rows = search.with_query(own.join(F.broadcast(regions), "region_id"), search.one_vector(table(spark, sf_dir, "embeddings"), 5))
    found = rows.withColumn("similarity", V.similarity("cosine", E(), F.col("q"))).orderBy(F.desc("similarity"), "vec_id").limit(10)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("search_spiral_pruned")
def search_spiral_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only regions near in angle: approximate, with the recall against the exact search."""
    own = placed(spark, sf_dir).withColumn("region_id", angular.region(F.col("theta")))
    asked = queries_of(own).join(own.select(F.col("vec_id").alias("query_id"), F.col("region_id").alias("own")), "query_id")
    near = asked.withColumn("region_id", F.explode(F.array(*(F.pmod(F.col("own") + d, F.lit(100)) for d in (-1, 0, 1)))))
    pairs = near.join(own, "region_id").select("query_id", "vec_id", V.cosine(F.col("q"), E()).alias("score"))
    found = search.top_per_group(pairs, "query_id", F.col("score"), 10, "vec_id")
    truth = search.knn_join(queries_of(own), own, 10)
    return search.recall_at_k(found, truth).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 3).alias("recall"))


XY = "round(radius, 6) AS radius, round(angle, 6) AS angle"


@query("spiral_xy_v0", ID + "x AS (SELECT vec_id, abs(list_avg(v)) AS radius, 0.1::DOUBLE * ordinal - 2 * pi() * floor(0.1::DOUBLE * ordinal / (2 * pi())) AS angle FROM o) SELECT vec_id, " + XY + " FROM x")
def spiral_xy_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return angular.xy_simple(numbered(spark, sf_dir), F.col("ordinal")).select("vec_id", F.round("radius", 6).alias("radius"), F.round("angle", 6).alias("angle"))


V1 = ID + "x AS (SELECT vec_id, radius, list_sum(list_transform(v, lambda x, i: x * i)) / (radius + 1e-8) + 0.1::DOUBLE * ordinal AS angle FROM o)"


def xy_shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", *(F.round(c, 6).alias(c) for c in ("radius", "angle", "x", "y")))


@query("spiral_xy_v1", V1 + f" SELECT vec_id, {XY}, round(radius * cos(angle), 6) AS x, round(radius * sin(angle), 6) AS y FROM x")
def spiral_xy_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xy_shown(angular.xy_weighted(numbered(spark, sf_dir), F.col("ordinal")))


@query(
    "spiral_xy_v2",
    ID + "c AS (SELECT *, list_sum(list_transform(v, lambda x, i: abs(x) * sqrt(i))) AS c, v[2] / (abs(v[1]) + 1e-8) AS r FROM o), x AS (SELECT vec_id, radius * (3.0::DOUBLE + 1.0/3) / (1 + 0.5 + 1.0::DOUBLE/3) AS radius, CASE WHEN v[1] >= 0 THEN r / (1 + abs(r)) WHEN v[2] >= 0 THEN pi() - r / (1 + abs(r)) ELSE -pi() - r / (1 + abs(r)) END + 0.1::DOUBLE * ordinal + pi() * c / ((SELECT max(c) FROM c) + 1e-8) AS angle FROM c) "
    f"SELECT vec_id, {XY}, round(radius * cos(angle), 6) AS x, round(radius * sin(angle), 6) AS y FROM x",
)
def spiral_xy_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xy_shown(angular.xy_levels(numbered(spark, sf_dir), F.col("ordinal")))


@query("spiral_xy_search", V1 + ", y AS (SELECT vec_id, radius * cos(angle) AS x, radius * sin(angle) AS y FROM x), z AS (SELECT vec_id, sqrt((x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5)) AS d FROM y) SELECT vec_id, round(d, 6) AS distance FROM z WHERE d <= 1.0 ORDER BY d, vec_id LIMIT 10")
def spiral_xy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = angular.xy_weighted(numbered(spark, sf_dir), F.col("ordinal"))
    return angular.xy_search(own, 0.5, 0.5, 10, 1.0).select("vec_id", F.round("distance", 6).alias("distance"))


@query("spiral_order_radius", ID[:-2] + " SELECT vec_id, row_number() OVER (ORDER BY round(radius * (1 + vec_id % 7), 6), vec_id) - 1 AS position FROM o")
def spiral_order_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by norm; the table's vectors are of unit length, so each is stretched by its id modulo 7."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", V.scale(E(), 1.0 + F.col("vec_id") % 7).alias("embedding"))
    own = own.withColumn("radius", F.round(V.norm(F.col("embedding")), 6))
    return global_rank(own.select("vec_id", "radius"), ["radius", "vec_id"], "position").select("vec_id", "position")


STEPS = (
    ID.replace("WITH ", "WITH RECURSIVE ", 1) + "s AS (SELECT 0 AS step, v AS r FROM o WHERE ordinal = 0 UNION ALL SELECT step + 1, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) FROM "
    "(SELECT s.step, list_transform(list_zip(s.r, o.v), lambda p: 0.99::DOUBLE * p[1] + 0.01::DOUBLE * p[2] / sqrt(list_inner_product(o.v, o.v))) AS m FROM s JOIN o ON o.ordinal = s.step * 100)) "
)


@query("reference_ema", STEPS + "SELECT step::INT AS step, round(r[1], 6) AS first, round(r[64], 6) AS last FROM s")
def reference_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states of the drifting reference."""
    states = angular.reference_states(numbered(spark, sf_dir), search.one_vector(table(spark, sf_dir, "embeddings"), 0))
    return states.select("step", F.round(F.element_at("reference", 1), 6).alias("first"), F.round(F.element_at("reference", 64), 6).alias("last"))


# ---- compression


@query("sequence_scan", SEQ[:-2] + " SELECT vec_id, pos FROM p WHERE seq_id = 2")
def sequence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).where("seq_id = 2").select("vec_id", F.col("pos").cast("long").alias("pos")).orderBy("pos")


@query("anchors", SEQ[:-2] + " SELECT vec_id, seq_id, pos FROM k WHERE is_anchor")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.with_size(sequences(spark, sf_dir))
    return own.where(compress.is_anchor(F.col("pos"), F.col("n"), 16)).select("vec_id", "seq_id", F.col("pos").cast("long").alias("pos"))


@query("nearest_anchor", SEQ[:-2] + " SELECT vec_id, anchor_pos FROM k")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.with_size(sequences(spark, sf_dir))
    return own.select("vec_id", compress.anchor_pos(F.col("pos"), F.col("n"), 16).cast("long").alias("anchor_pos"))


@query("delta_encode", SEQ[:-2] + ", l AS (SELECT vec_id, unnest([0, 1, 2, 3])::INT AS level, delta FROM d) SELECT vec_id, level, round(list_sum(list_transform(delta, lambda x: abs(x))) * 0.5::DOUBLE ** level, 6) AS size FROM l")
def delta_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.deltas(sequences(spark, sf_dir))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), compress.level(F.col("delta"), k).alias("d")) for k in range(4)))
    out = own.select("vec_id", F.explode(levels).alias("l"))
    return out.select("vec_id", "l.level", F.round(V.total(F.transform("l.d", lambda x: F.abs(x))), 6).alias("size"))


CODE = ", b AS (SELECT s.s AS subspace, c.c AS code, o.v[s.s * 16 + 1 : s.s * 16 + 16] AS centroid FROM range(4) s(s), range(8) c(c), o WHERE o.ordinal = c.c * (SELECT count(*) FROM o) // 8), f AS (SELECT vec_id, subspace, code, list_sum(list_transform(list_zip({v}[subspace * 16 + 1 : subspace * 16 + 16], centroid), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM {t}, b), m AS (SELECT vec_id, subspace, code FROM f QUALIFY row_number() OVER (PARTITION BY vec_id, subspace ORDER BY d, code) = 1)"


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight codes in four subspaces, from rows spread over the ids."""
    return compress.codebook_from_rows(numbered(spark, sf_dir), 8, 4, 64)


@query("pq_encode", ID[:-2] + CODE.format(v="o.v", t="o") + " SELECT vec_id, subspace::INT AS subspace, code::INT AS code FROM m")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.pq_encode(table(spark, sf_dir, "embeddings"), codebook(spark, sf_dir))
    return own.select("vec_id", F.posexplode("codes").alias("subspace", "code")).select("vec_id", "subspace", F.col("code").cast("int").alias("code"))


@query("pq_decode", ID[:-2] + CODE.format(v="o.v", t="o") + ", g AS (SELECT vec_id, flatten(list(centroid ORDER BY m.subspace)) AS decoded FROM m JOIN b ON m.subspace = b.subspace AND m.code = b.code GROUP BY vec_id) SELECT vec_id, round(list_distance(o.v, decoded), 6) AS error FROM g JOIN o USING (vec_id)")
def pq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = codebook(spark, sf_dir)
    own = compress.pq_decode(compress.pq_encode(table(spark, sf_dir, "embeddings"), book), book)
    return own.select("vec_id", F.round(V.euclidean(E(), F.col("decoded")), 6).alias("error"))


@query("pq_train")
def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    book = compress.train_codebook(e, 3, 4, 64, iterations=5)
    own = compress.pq_decode(compress.pq_encode(e, book), book)
    return compress.reconstruction(own, "embedding", "decoded")


DELTA_CODE = SEQ[:-2] + ", o2 AS (SELECT *, vec_id AS vid FROM d)" + CODE.replace("FROM {t}, b)", "FROM o2, b)").format(v="o2.delta", t="o2").replace("o.v[", "(SELECT list_transform(list_zip(x.v, y.v), lambda p: p[1] - p[2]) FROM t x, t y WHERE x.vec_id = o.vec_id AND y.vec_id = 0)[").replace("o.ordinal = c.c * (SELECT count(*) FROM o) // 8", "o.vec_id = c.c * (SELECT count(*) FROM o) // 8")


@query("delta_decode", DELTA_CODE + ", g AS (SELECT vec_id, flatten(list(centroid ORDER BY m.subspace)) AS decoded FROM m JOIN b ON m.subspace = b.subspace AND m.code = b.code GROUP BY vec_id) SELECT vec_id, round(list_distance(d.v, list_transform(list_zip(anchor, decoded), lambda p: p[1] + p[2])), 6) AS error FROM g JOIN d USING (vec_id)")
def delta_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas coded with eight codes, rows spread over the ids less row 0, and decoded on their anchors."""
    e = numbered(spark, sf_dir)
    zero = search.with_query(e, search.one_vector(e, 0)).withColumn("embedding", V.subtract(E(), F.col("q"))).drop("q")
    book = compress.codebook_from_rows(zero, 8, 4, 64)
    own = compress.pq_encode(compress.deltas(sequences(spark, sf_dir)), book, vector="delta")
    own = compress.pq_decode(own, book)
    return own.select("vec_id", F.round(V.euclidean(E(), V.add(F.col("anchor"), F.col("decoded"))), 6).alias("error"))


@query("encode_sequence", DELTA_CODE + " SELECT k.vec_id, k.seq_id, k.pos, k.is_anchor, coalesce(string_agg(code::VARCHAR, ',' ORDER BY subspace), '') AS codes FROM k LEFT JOIN m USING (vec_id) GROUP BY ALL")
def encode_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence as anchors, which are kept, and the codes of the deltas of all others."""
    e = numbered(spark, sf_dir)
    zero = search.with_query(e, search.one_vector(e, 0)).withColumn("embedding", V.subtract(E(), F.col("q"))).drop("q")
    own = compress.with_size(sequences(spark, sf_dir)).withColumn("is_anchor", compress.is_anchor(F.col("pos"), F.col("n"), 16))
    coded = compress.pq_encode(compress.deltas(sequences(spark, sf_dir)), compress.codebook_from_rows(zero, 8, 4, 64), vector="delta")
    out = own.join(coded.select("vec_id", "codes"), "vec_id", "left")
    return out.select("vec_id", "seq_id", F.col("pos").cast("long").alias("pos"), "is_anchor", F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"))


LEVELS = DELTA_CODE.replace("o2 AS (SELECT *, vec_id AS vid FROM d)", "o2 AS (SELECT vec_id, list_transform(delta, lambda x: x * 0.5::DOUBLE ** {k}) AS delta FROM d)")


def encoded(spark: SparkSession, sf_dir: str):
    """A table of encoded sequences with a fixed codebook: eight codes in four subspaces, the same at both levels."""
    import uuid

    from vectorloom.plans.scratch import shared_dir
    from vectorloom.sources.encoded import EncodedTable

    e = numbered(spark, sf_dir)
    zero = search.with_query(e, search.one_vector(e, 0)).withColumn("embedding", V.subtract(E(), F.col("q"))).drop("q")
    book = compress.codebook_from_rows(zero, 8, 4, 64)
    own = EncodedTable(spark, f"{shared_dir(spark)}/vectorloom/encoded-{uuid.uuid4().hex}", 64)
    own.set_codebook(book.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))))
    own.write(sequences(spark, sf_dir).select("seq_id", "pos", "vec_id", "label", "embedding"))
    return EncodedTable.load(spark, own.path)


@query("stored_encoded", DELTA_CODE + " SELECT k.vec_id, k.seq_id, k.pos, k.label, coalesce(string_agg(code::VARCHAR, ',' ORDER BY subspace), '') AS codes FROM k LEFT JOIN m USING (vec_id) GROUP BY ALL")
def stored_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each row: codes of the first level, none for anchors."""
    own = encoded(spark, sf_dir).stored()
    return own.select("vec_id", F.col("seq_id").cast("long").alias("seq_id"), F.col("pos").cast("long").alias("pos"), "label", F.coalesce(F.array_join(F.col("codes")[0], ","), F.lit("")).alias("codes"))


@query("encode_levels", LEVELS.format(k=1) + " SELECT vec_id, string_agg(code::VARCHAR, ',' ORDER BY subspace) AS codes FROM m GROUP BY 1")
def encode_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the second level, at half the scale."""
    return encoded(spark, sf_dir).stored().where("codes is not null").select("vec_id", F.array_join(F.col("codes")[1], ",").alias("codes"))


@query("decode_stored", DELTA_CODE + ", g AS (SELECT vec_id, flatten(list(centroid ORDER BY m.subspace)) AS decoded FROM m JOIN b ON m.subspace = b.subspace AND m.code = b.code GROUP BY vec_id) SELECT vec_id, k.label, round(CASE WHEN decoded IS NULL THEN 0.0 ELSE list_distance(d.v, list_transform(list_zip(anchor, decoded), lambda p: p[1] + p[2])) END, 6) AS error FROM k LEFT JOIN g USING (vec_id) LEFT JOIN d USING (vec_id)")
def decode_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows read back, with their metadata and how far the decoded vector is from the one written."""
    own = encoded(spark, sf_dir).read().select("vec_id", "label", F.col("embedding").alias("decoded"))
    both = own.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return both.select("vec_id", "label", F.round(V.euclidean(E(), F.col("decoded")), 6).alias("error"))


@query("compression_size", SEQ + "s AS (SELECT seq_id, count(*) AS n, count(*) FILTER (is_anchor) AS anchors FROM k GROUP BY 1), z AS (SELECT seq_id, n * 256 AS raw_bytes, anchors * 256 + (n - anchors) * 8 * 4 + 1024 + 16 * anchors + 32 AS encoded_bytes FROM s) SELECT seq_id, raw_bytes, encoded_bytes, round(1 - encoded_bytes / raw_bytes, 6) AS ratio, round(least(0.7, greatest(0.3, 1 - encoded_bytes / raw_bytes)), 6) AS clamped_ratio FROM z")
def compression_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.sizes(sequences(spark, sf_dir), 64, 16, 8, 4)
    return own.select("seq_id", "raw_bytes", "encoded_bytes", F.round("ratio", 6).alias("ratio"), F.round("clamped_ratio", 6).alias("clamped_ratio"))


PAIR = BASE + "w AS (SELECT *, lag(v) OVER (ORDER BY ordinal) AS before FROM o), x AS (SELECT vec_id, list_transform(list_zip(v, before), lambda p: p[1] - p[2]) AS delta FROM w WHERE before IS NOT NULL), y AS (SELECT vec_id, delta, list_transform(delta, lambda x: CASE WHEN abs(x) <= 0.01 THEN 0.0 ELSE x END) AS kept FROM x)"


@query("delta_pairs", PAIR + " SELECT vec_id, round(list_distance(delta, kept), 6) AS error, round(1 - sqrt(list_inner_product(kept, kept)) / sqrt(list_inner_product(delta, delta)), 6) AS ratio FROM y")
def delta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_previous(angular.sort(placed(spark, sf_dir)), {"embedding": "before"}).where("before is not null")
    return compress.pairwise(own, "before").select("vec_id", F.round("error", 6).alias("error"), F.round("ratio", 6).alias("ratio"))


@query("dim_stddev", "WITH x AS (SELECT unnest(range(64))::INT AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT dim, round(stddev_pop(x), 6) AS scale FROM x GROUP BY dim")
def dim_stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress.moments(table(spark, sf_dir, "embeddings")).select("dim", F.round("scale", 6).alias("scale"))


@query("est_ratio", ID + "w AS (SELECT v, radius, lag(v) OVER (ORDER BY ordinal) AS before FROM o) SELECT round(greatest(0, least(0.9, 1 - 2 * avg(list_distance(v, before)) / avg(radius))), 6) AS ratio FROM w")
def est_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_previous(numbered(spark, sf_dir), {"embedding": "before"})
    return compress.estimated_ratio(own, "before").select(F.round("ratio", 6).alias("ratio"))


@query("accurate_ratio", SEQ + "s AS (SELECT seq_id, count(*) AS n, count(*) FILTER (is_anchor) AS anchors FROM k GROUP BY 1), z AS (SELECT 1 - (anchors * 256 + (n - anchors) * 32 + 1056 + 16 * anchors) / (n * 256) AS ratio FROM s) SELECT round(coalesce(least(0.7, greatest(0.0, avg(ratio))), 0.0), 6) AS ratio FROM z")
def accurate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.sizes(sequences(spark, sf_dir), 64, 16, 8, 4)
    return own.agg(F.round(F.coalesce(F.least(F.lit(0.7), F.greatest(F.lit(0.0), F.avg("ratio"))), F.lit(0.0)), 6).alias("ratio"))


QUALITY = SEQ + "x AS (SELECT v AS a, anchor AS b FROM d), y AS (SELECT list_cosine_similarity(a, b) AS cos, list_distance(a, b) ** 2 / 64 AS mse, list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / 64 AS mae, list_distance(a, b) / sqrt(list_inner_product(a, a)) AS rel, sqrt(list_inner_product(b, b)) / sqrt(list_inner_product(a, a)) AS mag FROM x)"


@query("recon_quality", QUALITY + " SELECT round(avg(cos), 6) AS cosine_mean, round(stddev_pop(cos), 6) AS cosine_std, round(min(cos), 6) AS cosine_min, round(quantile_cont(cos, 0.1), 6) AS cosine_p10, round(avg(mse), 6) AS mse, round(avg(mae), 6) AS mae, round(avg(mag), 6) AS magnitude, round(0.8 * avg(cos) + 0.2 * (1 - avg(mae)), 6) AS quality_score FROM y")
def recon_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of standing in the nearest anchor for each vector."""
    own = compress.reconstruction(compress.deltas(sequences(spark, sf_dir)), "embedding", "anchor")
    return own.select(*(F.round(c, 6).alias(c) for c in ("cosine_mean", "cosine_std", "cosine_min", "cosine_p10", "mse", "mae", "magnitude", "quality_score")))


@query("recon_quality_v2", QUALITY + " SELECT round(avg(mse), 6) AS mse, round(avg(cos), 6) AS cosine_mean, round(avg(rel), 6) AS relative_error, round(avg(cos) * (1 - avg(rel)), 6) AS composite_score FROM y")
def recon_quality_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = compress.reconstruction(compress.deltas(sequences(spark, sf_dir)), "embedding", "anchor")
    return own.select(*(F.round(c, 6).alias(c) for c in ("mse", "cosine_mean", "relative_error", "composite_score")))


@query("distinct_subvectors", "SELECT s.s::INT AS subspace, count(DISTINCT list_transform((embedding::DOUBLE[])[s.s * 8 + 1:s.s * 8 + 8], lambda x: round(x, 6))) AS n FROM embeddings, range(8) s(s) GROUP BY 1")
def distinct_subvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different vectors in each of eight subspaces, at six decimals."""
    return compress.distinct_parts(table(spark, sf_dir, "embeddings"), 8, 64)


# ---- neighbours

CENTRES = "WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings), c0 AS (SELECT c.c::INT AS cluster_id, v AS centre FROM range(8) c(c), o WHERE ordinal = c.c * (SELECT count(*) FROM o) // 8), "
NEAR = "{a} AS (SELECT vec_id, cluster_id, v FROM o, {c} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster_id) = 1)"
MEANS = "{c} AS (SELECT cluster_id, list(x ORDER BY dim) AS centre FROM (SELECT cluster_id, dim, avg(x) AS x FROM (SELECT cluster_id, unnest(range(64)) AS dim, unnest(v) AS x FROM {a}) GROUP BY 1, 2) GROUP BY 1)"


def centres_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.first_centres(numbered(spark, sf_dir), 8, "ordinal")


@query("cluster_assign", CENTRES + NEAR.format(a="a0", c="c0") + " SELECT vec_id, cluster_id FROM a0")
def cluster_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.assign(table(spark, sf_dir, "embeddings"), centres_of(spark, sf_dir)).select("vec_id", "cluster_id")


@query("kmeans_lloyd")
def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From fixed rows until no centre moves, a hundred rounds at most."""
    made = ann.lloyd(numbered(spark, sf_dir), 8)
    return made.select("cluster_id", F.posexplode("centre").alias("dim", "x")).select("cluster_id", "dim", F.round("x", 6).alias("value"))


@query("ivf_lists", CENTRES + NEAR.format(a="a0", c="c0") + " SELECT cluster_id, count(*) AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id) AS members FROM a0 GROUP BY 1")
def ivf_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ann.inverted_lists(ann.assign(table(spark, sf_dir, "embeddings"), centres_of(spark, sf_dir)))
    return own.select("cluster_id", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


@query("ivf_probe", CENTRES + NEAR.format(a="a0", c="c0") + ", n AS (SELECT vec_id AS query_id, v AS q, cluster_id FROM o, c0 WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(v, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), cluster_id) <= 7), s AS (SELECT query_id, vec_id, list_cosine_similarity(v, q) AS score FROM n JOIN a0 USING (cluster_id)) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10")
def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven of eight lists: the table's vectors point anywhere, so true neighbours are spread over many lists."""
    e = table(spark, sf_dir, "embeddings")
    centres = centres_of(spark, sf_dir)
    found = ann.probe(queries_of(e), ann.assign(e, centres), centres, 7)
    return search.top_per_group(found, "query_id", F.col("score"), 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


PLANES = "WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), pl AS (SELECT vec_id - 1 AS h, v AS plane FROM o WHERE vec_id BETWEEN 1 AND 16), bits AS (SELECT o.vec_id, h, (list_inner_product(v, plane) > 0)::INT AS bit FROM o, pl), "


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen planes: the vectors of ids 1 to 16."""
    return table(spark, sf_dir, "embeddings").where("vec_id between 1 and 16").select((F.col("vec_id") - 1).alias("h"), E().alias("plane"))


@query("lsh_buckets", PLANES + "c AS (SELECT vec_id, sum(bit * 2 ** h)::BIGINT AS bucket FROM bits GROUP BY 1) SELECT bucket, count(*) AS n FROM c GROUP BY 1")
def lsh_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ann.band_codes(table(spark, sf_dir, "embeddings"), planes(spark, sf_dir), 1)
    return codes.groupBy(F.col("code").alias("bucket")).agg(F.count("*").alias("n"))


def candidates_sql(bands: int, least: int) -> str:
    size = 16 // bands
    return PLANES + f"b AS (SELECT vec_id, h // {size} AS band, sum(bit * 2 ** (h % {size}))::BIGINT AS code FROM bits GROUP BY 1, 2), x AS (SELECT q.vec_id AS query_id, r.vec_id, count(*) AS shared FROM b q JOIN b r ON q.band = r.band AND q.code = r.code WHERE q.vec_id % 20 = 0 GROUP BY 1, 2 HAVING count(*) >= {least})"


def candidates(spark: SparkSession, sf_dir: str, bands: int, least: int) -> DataFrame:
    """Pairs of a query and a row that share at least so many of the band tables."""
    own = ann.band_codes(table(spark, sf_dir, "embeddings"), planes(spark, sf_dir), bands)
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "band", "code")
    return asked.join(own, ["band", "code"]).groupBy("query_id", "vec_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


@query("lsh_candidates", candidates_sql(4, 2) + " SELECT query_id, vec_id, shared FROM x")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of four tables."""
    return candidates(spark, sf_dir, 4, 2)


@query("lsh_search", candidates_sql(8, 1) + ", s AS (SELECT query_id, x.vec_id, list_cosine_similarity(q.v, r.v) AS score FROM x JOIN o q ON q.vec_id = query_id JOIN o r ON r.vec_id = x.vec_id) SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 10")
def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share one of eight tables of two planes, scored exactly."""
    e = table(spark, sf_dir, "embeddings")
    found = ann.lsh_join(queries_of(e), e, planes(spark, sf_dir), 8, 10)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("knn_graph", "WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a, o b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) <= 4) SELECT a, b FROM n UNION SELECT b, a FROM n")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's four nearest others, made symmetric."""
    e = table(spark, sf_dir, "embeddings")
    found = search.knn_join(e.select(F.col("vec_id").alias("query_id"), E().alias("q")), e, 5).where("query_id <> vec_id")
    own = search.top_per_group(found.drop("rank"), "query_id", F.col("score"), 4, "vec_id").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))
    return own.union(own.select("b", "a")).distinct()
