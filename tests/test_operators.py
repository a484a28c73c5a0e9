"""Invariants of search, filters, ordering, compression, storage and state machines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions import vectors as V
from vectorloom.operators import angular, ann, compress, routing, search
from vectorloom.operators.filters import apply_filter
from vectorloom.operators.quantiles import quantiles
from vectorloom.operators.ranking import global_rank, with_previous
from vectorloom.sources import generators
from vectorloom.sources.store import VectorTable
from vectorloom.sources.text_vectors import read_word_vectors

rng = np.random.default_rng(42)
X = rng.standard_normal((200, 16))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, x.tolist(), f"cat_{i % 5}", i * 0.1, i % 2 == 0, [f"tag_{i % 3}"], None if i % 4 else i) for i, x in enumerate(X)]
    return spark.createDataFrame(data, "vec_id bigint, embedding array<float>, category string, score double, active boolean, tags array<string>, extra int").cache()


def ids(df):
    return [r.vec_id for r in df.collect()]


def test_search(rows):
    q = X[7].astype(np.float32).astype(float)
    c = X.astype(np.float32).astype(float)
    for metric, s in (("cosine", c @ q / np.linalg.norm(c, axis=1) / np.linalg.norm(q)), ("dot", c @ q), ("euclidean", -np.linalg.norm(c - q, axis=1)), ("manhattan", -np.abs(c - q).sum(1))):
        assert ids(search.topk(rows, q.tolist(), 10, metric)) == sorted(range(200), key=lambda i: (-s[i], i))[:10]
    assert ids(search.topk(rows, q.tolist(), 1)) == [7]
    assert len(ids(search.topk(rows, q.tolist(), 500))) == 200
    assert ids(search.topk(rows.limit(0), q.tolist(), 5)) == []


def test_knn_join_in_blocks(rows):
    q = rows.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    one, many = search.knn_join(q, rows, 5), search.knn_join(q, rows, 5, block=7)
    assert sorted(one.collect()) == sorted(many.collect())
    assert search.recall_at_k(many, one).where("recall < 1 or precision < 1").count() == 0


def test_knn_join_ties(spark):
    same = [(i, [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(40)] + [(40, None), (41, [0.0, 0.0])]
    rows = spark.createDataFrame(same, "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8])], "query_id bigint, q array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.knn_join(q, rows, 4).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 4, (0, 4): 5, (1, 1): 0, (1, 2): 3, (1, 3): 6, (1, 4): 9}
    assert search.knn_join(q, rows, 50).count() == 2 * 41 and search.knn_join(q.limit(0), rows, 4).count() == 0


def test_range_join(spark):
    unit = X / np.linalg.norm(X, axis=1, keepdims=True)
    unit = np.concatenate([unit, unit[:20], unit[:20] + 0.01, 3 * unit[:5]])
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit)], "vec_id bigint, embedding array<double>")
    q = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    apart = np.linalg.norm(unit[:, None] - unit[None], axis=2)
    for radius in (0.0, 0.05, 0.9, 1.3):
        got = sorted((r.query_id, r.vec_id) for r in search.range_join(q, e, radius).collect())
        assert got == [(a, b) for a in range(0, len(unit), 3) for b in range(len(unit)) if apart[a, b] <= radius]


def test_quantiles(spark):
    data = [(k, float(v)) for k in (None, "a", "b") for v in rng.integers(0, 30, 101)] + [("one", 7.0), ("none", None), ("a", None)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(5)
    of = {"low": 0.0, "tenth": 0.1, "median": 0.5, "p95": 0.95, "high": 1.0}
    for r in quantiles(rows, ["k"], "v", of).collect():
        own = [v for k, v in data if k == r.k and v is not None]
        assert [r[n] for n in of] == (pytest.approx(np.quantile(own, list(of.values()))) if own else [None] * 5)
    assert quantiles(rows, ["k"], "v", of).count() == 5
    every = np.quantile([v for _, v in data if v is not None], list(of.values()))
    assert list(quantiles(rows, [], "v", of).first()) == pytest.approx(every)
    assert list(quantiles(rows.limit(0), [], "v", of).first()) == [None] * 5


def test_folds_of_odd_rows(spark):
    data = [("a", 0, True), ("a", 1, True), ("a", None, None), (None, 5, True), ("b", 9, None), ("b", 9, True), (None, 6, False), ("a", 100, False)]
    rows = spark.createDataFrame(data, "k string, s int, f boolean").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.k, r.t and r.t.timestamp(), r.f): r.state for r in routing.breaker(rows, "k", "t", "f", failures=2, timeout_s=60, successes=2).collect()}
    assert got == {("a", 0, True): "closed", ("a", 1, True): "open", ("a", 100, False): "half_open", ("a", None, None): "closed", (None, 5, True): "closed", (None, 6, False): "closed", ("b", 9, None): "closed", ("b", 9, True): "closed"}
    assert routing.breaker(rows.limit(0), "k", "t", "f").count() == 0
    assert routing.token_bucket(rows, "k", "t", rate=1.0, burst=1.0).where("allowed").count() == 6


def test_filters(rows):
    keep = lambda f: set(ids(apply_filter(rows, f)))
    assert keep({"category": "cat_2"}) == {i for i in range(200) if i % 5 == 2}
    assert keep({"score": {"$gte": 2.0, "$lt": 4.0}}) == set(range(20, 40))
    assert keep({"tags": ["tag_0", "tag_2"]}) == {i for i in range(200) if i % 3 != 1}
    assert keep({"extra": {"$ne": 0}}) == {i for i in range(1, 200) if i % 4 == 0}  # a missing value is rejected
    assert keep({"extra": {"$nin": [4]}}) == {i for i in range(200) if i % 4 == 0 and i != 4}
    assert keep({}) == set(range(200)) == keep(None)
    assert keep(F.col("extra") > 100) == {i for i in range(101, 200) if i % 4 == 0} == keep(lambda df: (df.vec_id > 100) & (df.vec_id % 4 == 0))
    for bad in ({"score": {"$near": 1}}, {"nothing": 1}):
        with pytest.raises(ValueError):
            apply_filter(rows, bad)


def test_order(spark, rows):
    own = angular.transform(rows, X[0].tolist())
    ranked = [(r.ordinal, r.theta, r.vec_id) for r in angular.sort(own).orderBy("ordinal").collect()]
    assert [o for o, _, _ in ranked] == list(range(200)) and ranked == sorted(ranked, key=lambda r: (r[1], r[2]))
    sizes = [r.n for r in angular.clusters(own, 7).groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy("cluster_id").collect()]
    assert sizes == [28] * 6 + [32]
    assert angular.clusters(own, 500).select("cluster_id").distinct().count() == 200
    assert 0 <= angular.potential(own).first()[0] <= 1 and angular.potential(own.limit(1)).first()[0] == 0
    two = spark.createDataFrame([(1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.theta, r.radius) for r in angular.transform(two, [1.0, 0.0]).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 2) and got[3][0] == pytest.approx(np.pi / 2) and got[4][0] == pytest.approx(np.pi)
    assert global_rank(two.limit(0), ["vec_id"]).count() == 0
    before = {r.vec_id: r.before for r in with_previous(global_rank(two, ["vec_id"]), {"vec_id": "before"}).collect()}
    assert before == {1: None, 2: 1, 3: 2, 4: 3}


@pytest.mark.parametrize(("n", "stride"), [(1, 4), (5, 4), (9, 4), (10, 4), (50, 16)])
def test_anchors(spark, n, stride):
    own = spark.range(n).select(F.lit(0).alias("seq_id"), F.col("id").cast("int").alias("pos"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    got = {r.pos: r.a for r in compress.with_size(own).select("pos", compress.anchor_pos(F.col("pos"), F.col("n"), stride).alias("a")).collect()}
    anchors = sorted({*range(0, n, stride), n - 1})
    assert got == {p: min(anchors, key=lambda a: abs(a - p)) for p in range(n)}
    deltas = compress.deltas(own, stride)
    assert deltas.count() == n - len(anchors)
    assert all(r.back == r.embedding for r in deltas.select("embedding", V.add(F.col("anchor"), F.col("delta")).alias("back")).collect())


def test_codes(rows, spark):
    own = global_rank(rows.select("vec_id", "embedding"), ["vec_id"])
    book = compress.codebook_from_rows(own, 8, 4, 16)
    coded = compress.pq_decode(compress.pq_encode(own, book), book)
    cents = {(r.subspace, r.code): np.array(r.centroid) for r in book.collect()}
    for r in coded.collect():
        x = np.array(r.embedding)
        want = [min(range(8), key=lambda c: (((x[s * 4 : s * 4 + 4] - cents[s, c]) ** 2).sum(), c)) for s in range(4)]
        assert list(r.codes) == want and np.allclose(r.decoded, np.concatenate([cents[s, c] for s, c in enumerate(want)]))
    assert compress.subspaces(63, 8) == 7 and compress.subspaces(64, 8) == 8 and compress.subspaces(5, 9) == 5
    assert compress.fitting_bits(1280, 8, 8) == 8 and compress.fitting_bits(100, 8, 8) == 3 and compress.fitting_bits(1, 8, 8) == 1
    centres = ann.lloyd(own, 6, iterations=5)
    near = ann.assign(own, centres)
    assert centres.count() == 6 and near.where("cluster_id between 0 and 5").count() == 200


def test_store(spark, rows, tmp_path):
    own = VectorTable(spark, f"file://{tmp_path}/t", 16, X[0].tolist())
    own.save()
    own.insert(rows.where("vec_id < 100"))
    own.insert(rows.where("vec_id >= 100"))
    own = VectorTable.load(spark, f"file://{tmp_path}/t")
    assert own.read().count() == 200 and own.get(5)["category"] == "cat_0" and own.get(5)["embedding"] == pytest.approx(X[5], abs=1e-6)
    assert own.delete(spark.createDataFrame([(3,), (3,), (999,)], "vec_id bigint")) == 1
    with pytest.raises(ValueError):
        own.get(3)
    own.update(rows.where("vec_id = 4").withColumn("category", F.lit("new")))
    assert own.get(4)["category"] == "new" and own.read().count() == 199
    own.insert(rows.where("vec_id = 3"))
    assert own.read().count() == 200
    before = sorted(ids(own.read()))
    own.optimize()
    assert sorted(ids(own.read())) == before and own.stats().first().vectors == 200
    assert ids(own.search(X[9].tolist(), 1)) == [9] and len(ids(own.search(X[9].tolist(), 5, mode="pruned"))) <= 5
    own.backup(f"file://{tmp_path}/copy")
    assert VectorTable.load(spark, f"file://{tmp_path}/copy").read().count() == 200
    with pytest.raises(ValueError):
        own.search([1.0], 1)
    with pytest.raises(Exception, match="expected 16 dimensions"):
        own.insert(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>"))


def test_sources(spark, tmp_path):
    (tmp_path / "v.txt").write_text("the 1 2 3\nbad 1\nof -1 0.5 2\n")
    assert [(r.word, r.embedding) for r in read_word_vectors(spark, f"file://{tmp_path}/v.txt", 3).orderBy("word").collect()] == [("of", [-1, 0.5, 2]), ("the", [1, 2, 3])]
    made = generators.normalized_vectors(spark, 50, 8).select(V.norm(F.col("embedding")).alias("n")).collect()
    assert len(made) == 50 and all(abs(r.n - 1) < 1e-9 for r in made)


def test_state_machines(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    log = spark.createDataFrame([(1, s, f) for s, f in [(0, True), (1, True), (2, False), (70, False), (71, False), (72, True)]], "k int, s int, f boolean").withColumn("t", at(F.col("s")))
    states = [r.state for r in routing.breaker(log, "k", "t", "f", failures=2, timeout_s=60, successes=2).orderBy("t").collect()]
    assert states == ["closed", "open", "open", "half_open", "closed", "closed"]
    allowed = [r.allowed for r in routing.token_bucket(log, "k", "t", rate=0.5, burst=2.0).orderBy("t").collect()]
    assert allowed == [True, True, True, True, True, True]
    allowed = [r.allowed for r in routing.token_bucket(log, "k", "t", rate=0.01, burst=1.0).orderBy("t").collect()]
    assert allowed == [True, False, False, False, False, False]


def test_lloyd_like_numpy(spark):
    """Rounds until nothing moves."""
    own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "ordinal bigint, embedding array<double>")
    centres, rounds = X[[i * 200 // 5 for i in range(5)]], 0
    while rounds < 100:
        near = ((X[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([X[near == c].mean(0) if (near == c).any() else X[c] for c in range(5)])
        moved, centres, rounds = np.abs(new - centres).sum(), new, rounds + 1
        if moved < 1e-6:
            break
    got = {r.cluster_id: r.centre for r in ann.lloyd(own, 5).collect()}
    assert rounds > 3 and np.allclose([got[c] for c in range(5)], centres)


@pytest.mark.parametrize("name", ["ivf_probe", "lsh_search"])
def test_recall(spark, name):
    """At least 0.9 of the true ten nearest, for every twentieth vector."""
    from vectorloom.queries import QUERIES

    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    truth = search.knn_join(asked, e, 10)
    got = search.recall_at_k(QUERIES[name](spark, "/root/testdata/sf0.1"), truth).agg(F.count("*").alias("n"), F.avg("recall").alias("recall")).first()
    assert got.n == 100 and got.recall >= 0.9


def test_lsh_join(spark, monkeypatch):
    """Like all pairs that share a table, scored one by one, with blocks and parts of any size; no row for a pair."""
    own = np.concatenate([X, X[:30], X[:30] * 3, np.zeros((2, 16))]).astype(np.float32)
    own[262 - 1] = own[4] - own[4]
    data = [(i, x.tolist()) for i, x in enumerate(own)] + [(None, X[3].tolist()), (900, None), (901, [1.0] * 4), (902, [None] + [1.0] * 15)]
    e = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(3)
    planes = e.where("vec_id < 6").select(F.col("vec_id").alias("h"), F.col("embedding").alias("plane"))
    asked = e.where("vec_id % 7 = 0 or vec_id > 250").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    codes = (own.astype(float) @ own[:6].astype(float).T > 0).reshape(len(own), 2, 3)
    unit = own.astype(float) / np.maximum(np.linalg.norm(own.astype(float), axis=1, keepdims=True), 1e-300)
    want = {}
    for q in [i for i in range(len(own)) if i % 7 == 0 or i > 250]:
        shared = np.flatnonzero((codes == codes[q]).all(2).any(1))
        best = sorted((-round(float(unit[q] @ unit[i]), 9), int(i)) for i in shared)[:5]
        want[q] = [(i, -s) for s, i in best]
    for block, tile, pairs in [(1000, 2048, 65536), (9, 4, 50)]:
        monkeypatch.setattr(ann, "TILE", tile)
        monkeypatch.setattr(ann, "PAIRS", pairs)
        found = ann.lsh_join(asked, e, planes, 2, 5, block=block)
        assert "Join" not in found._jdf.queryExecution().toString()
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert got == want
    assert ann.lsh_join(asked, e, planes.where("h > 90"), 2).count() == 0


def test_encoded_table(spark, tmp_path):
    """Trained on differences, stored, loaded and decoded at every level."""
    from vectorloom.sources.encoded import EncodedTable

    base = rng.standard_normal((5, 16))
    v = np.concatenate([b + 0.1 * np.cumsum(rng.standard_normal((64, 16)), 0) / 8 for b in base])
    rows = spark.createDataFrame([(i, i // 64, i % 64, x.tolist(), f"c{i % 3}") for i, x in enumerate(v)], "vec_id bigint, seq_id int, pos int, embedding array<double>, category string")
    own = EncodedTable(spark, f"file://{tmp_path}/e", 16)
    own.train(rows, bits=4, m=4, levels=2, iterations=5)
    own.write(rows.where("seq_id < 3"))
    own.write(rows.where("seq_id >= 3"))
    back = EncodedTable.load(spark, f"file://{tmp_path}/e")
    assert back.stored().where("codes is null").count() == 5 * 5 and back.levels() == 2
    for level in range(2):
        got = {r.vec_id: r for r in back.read(level).collect()}
        assert len(got) == 320 and all(got[i].category == f"c{i % 3}" for i in got)
        assert np.allclose(got[0].embedding, v[0])
        error = np.mean([np.linalg.norm(got[i].embedding - v[i]) for i in got])
        assert error < 0.5 * np.mean([np.linalg.norm(v[i] - v[i // 64 * 64]) for i in got])
    assert {r.vec_id for r in back.read(sequence=2).collect()} == set(range(128, 192))
    assert back.sizes(4).where("encoded_bytes > 0").count() == 5


def test_rewrite_that_ends_early(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id bigint, embedding array<double>")
    own = VectorTable(spark, path, 16, X[0].tolist())
    own.insert(rows)
    own.delete(rows.where("vec_id < 50"))
    own.insert(rows.where("vec_id < 10"))
    rows.limit(3).write.parquet(f"{path}/data-2")  # a rewrite whose mark is missing
    (tmp_path / "v" / "data-2" / "_SUCCESS").unlink()
    live = {*range(10), *range(50, 200)}
    assert own.version() == 1 and set(ids(own.read())) == live
    own.optimize()
    assert own.version() == 2 and set(ids(own.read())) == live and not (tmp_path / "v" / "data-1").exists()
    own.delete(rows.where("vec_id = 3"))
    own.insert(rows.where("vec_id = 20"))
    assert set(ids(own.read())) == live - {3} | {20}


def test_rebuild_for_another_reference(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id bigint, embedding array<double>")
    own = VectorTable(spark, path, 16, X[0].tolist())
    own.save()
    own.insert(rows)
    own.delete(rows.where("vec_id < 5"))
    own.rebuild(X[1].tolist())
    back = VectorTable.load(spark, path)
    assert back.version() == 2 and back.reference == own.reference == X[1].tolist()
    got = {r.vec_id: (r.theta, r.region_id) for r in back.read(system=True).collect()}
    other = VectorTable(spark, f"file://{tmp_path}/other", 16, X[1].tolist())
    other.insert(rows.where("vec_id >= 5"))
    assert got == {r.vec_id: (r.theta, r.region_id) for r in other.read(system=True).collect()}
    own.rebuild()
    assert own.version() == 3 and own.read().count() == 195 and VectorTable.load(spark, path).reference == X[1].tolist()


def test_strategies_and_shard_maps(spark):
    nodes, keys = [f"n{k}" for k in range(5)], spark.range(2000).withColumn("key", F.col("id").cast("string"))
    for strategy in ("consistent", "hash", "range"):
        placed = routing.assign(keys, strategy, nodes, F.col("key"))
        own = {r.node: r["count"] for r in placed.groupBy("node").count().collect()}
        assert set(own) == set(nodes) and sum(own.values()) == 2000
        if strategy != "consistent":
            assert min(own.values()) > 300
    with pytest.raises(ValueError):
        routing.assign(keys, "nearest", nodes, F.col("key"))
    data = [("a", "n0", 5), ("a", "n1", 6), ("a", "n1", None), ("b", "n0", 10)]
    got = routing.shard_map(spark.createDataFrame(data, "shard string, node string, bytes bigint"), 10)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "n0", 1, 5, True), ("a", "n1", 2, 6, True), ("b", "n0", 1, 10, False)]
