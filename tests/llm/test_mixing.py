import random

from pyspark.sql import functions as F

from tests.llm.util import prose, words
from vectorloom.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string"


def water(sizes, weights=(5, 2, 1), cap=3):
    """{source: words} to targets: reshare what goes beyond until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in over}
        free -= over
    return out


def rows(seed=4, n=400):
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.choice([0, 3, 40, 200])), rng.choice(["a", "a", "a", "b", "Z", "é", None]), "x") for i in range(n)]
    return out + [(n, "tiny tiny", "b2", None), (n, "tiny tiny", "b2", None), (None, "x", "b2", None), (n + 1, None, "none", None), (n + 2, prose(rng, 20_000), "a", None)]


def test_targets_and_taking(spark):
    data = rows()
    got = mixing.plan(spark.createDataFrame(data, SCHEMA)).collect()
    sizes, most = {}, {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
        most[s] = max(most.get(s, 0), len(words(t)))
    want = water(sizes)
    assert len(got) == len(data)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
    for s in sizes:
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - want[s]) <= 3 * most[s]
    again = mixing.plan(spark.createDataFrame(data[::-1], SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_taken(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    plan, out = mixing.plan(df), mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    by_id = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert by_id == {r.doc_id: r.n for r in plan.groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert [r.target for r in mixing.plan(spark.createDataFrame([(1, "", "a", "")], SCHEMA)).collect()] == [0.0]


def test_names_that_the_operator_uses(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit(k) for k, c in enumerate(("id", "mark", "copies", "n", "copy", "c0_", "__copies", "__id", "key", "target"))})
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == mixing.plan(df).agg(F.sum("copies")).first()[0]


def test_one_offset_by_hand(spark, monkeypatch):
    """Every document in its place along its source, one after another, with slices of any width."""
    import hashlib
    from math import floor

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    data = rows(9) + [(7, prose(random.Random(k), 4), "a", "same id") for k in range(50)] + [(None, f"no id {k}", "a", None) for k in range(50)]
    klass = lambda n: n if n < 8 else n.bit_length() * 8 + (n >> n.bit_length() - 4) % 8
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    aims, want = water(sizes), []
    for s in sizes:
        own = sorted((klass(len(words(t))), md5(f"{'' if i is None else i}:{md5(t or '')}"), -1 if i is None else i, len(words(t)), t or "") for i, t, x, _ in data if x == s)
        each, at = aims[s] / sizes[s] if sizes[s] else 0.0, int(md5(f"mix:{s or ''}")[:8], 16) / 2**32
        for k, (_, _, i, n, t) in enumerate(own):
            want.append((i, s, n, floor((k + 1) * each + at) - floor(k * each + at) if n else 0))
    for width in (4096, 2):
        monkeypatch.setattr(mixing, "SLICE", width)
        got = mixing.plan(spark.createDataFrame(data, SCHEMA)).collect()
        assert sorted(map(str, want)) == sorted(str((-1 if r.doc_id is None else r.doc_id, r.source, r.size, r.copies)) for r in got)
