import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.util import components, corpus, near_copy, prose, shingles
from vectorloom.llm import minhash
from vectorloom.llm.textscan import Texts

SCHEMA = "doc_id bigint, text string"


def result(spark, rows, schema=SCHEMA, **kw):
    return {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, schema), **kw).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    texts = corpus(seed)
    want, sets = components(texts, 85)
    got = result(spark, sorted(texts.items()))
    assert {i: r.component_id for i, r in got.items()} == {i: want[i] if sets[i] else i for i in texts}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("stars", [1, 3])
def test_group_over_several_blocks(spark, monkeypatch, stars):
    """Copies with a few changes each, of which many are linked by way of others only; and chains of copies of copies."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "STARS", stars)
    rng = random.Random(5)
    base = prose(rng, 200)
    texts = {i: near_copy(rng, base, rng.randrange(1, 6)) for i in range(40)} | {100 + i: prose(rng, 60) for i in range(10)}
    texts[200] = base
    for i in range(201, 212):
        texts[i] = near_copy(rng, texts[i - 1], 2)
    want, _ = components(texts, 85)
    assert {i: r.component_id for i, r in result(spark, sorted(texts.items())).items()} == want


def test_odd_rows(spark):
    long = prose(random.Random(9), 30_000)
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f g", "x"), (4, "a b c d e f g", "x"), (4, "a b c d e f g", "y"), (5, long, None), (6, long.upper(), None), (None, None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, node string")).collect()
    got = sorted((r.doc_id or -1, r.n_shingles > 0, r.component_id) for r in out)
    assert got == [(-1, False, None), (-1, True, 4), (1, False, 1), (2, False, 2), (4, True, 4), (4, True, 4), (5, True, 5), (6, True, 5)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, node string"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 4, 5]


def test_null_and_repeated_ids(spark):
    rng = random.Random(31)
    a, b, c = prose(rng, 300), prose(rng, 300), prose(rng, 300)
    rows = [(None, a), (7, near_copy(rng, a, 2)), (7, b), (8, near_copy(rng, b, 2)), (None, c), (None, near_copy(rng, c, 2)), (None, None), (None, None), (3, ""), (3, ""), (9, b), (9, b), (5, c[:90]), (5, c[:90])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([(-1, 7), (7, 7), (7, 7), (8, 7), (-1, -1), (-1, -1), (-1, -1), (-1, -1), (3, 3), (3, 3), (9, 7), (9, 7), (5, 5), (5, 5)])
    names = {n: F.lit(k) for k, n in enumerate(("id", "mark", "of", "as", "n", "c0_", "c1_", "__id", "node", "root", "component"))}
    kept = minhash.keep_one(df.withColumns(names))
    assert kept.columns == [*df.columns, *names]
    found = sorted((r.doc_id or -1, r.text or "") for r in kept.collect())
    one = {r for r in found if r[0] == -1 and r[1]}
    assert len(one) == 1 and one < {(-1, rows[4][1]), (-1, rows[5][1])}
    assert [r for r in found if r not in one] == sorted([(7, rows[1][1]), (7, b), (-1, ""), (-1, ""), (3, ""), (3, ""), (5, c[:90])])


def test_recall_at_the_threshold():
    """Of pairs with a similarity of 0.85 to 0.86, the share that has a table in common."""
    rng, texts = random.Random(3), []
    while len(texts) < 2000:
        a = prose(rng, 400, 10**6)
        b = near_copy(rng, a, 7)
        x, y = shingles(a), shingles(b)
        if 0.85 <= len(x & y) / len(x | y) <= 0.86:
            texts += [a, b]
    values, off = minhash.shingle_sets(Texts(pa.array(texts), fold=True), 5)
    bands = minhash.band_values(values, off)
    same = bands[::2] == bands[1::2]
    found = same[:, : minhash.LEFT].any(1) & same[:, minhash.LEFT :].any(1)
    assert found.mean() > 0.99


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
