import random

import pyarrow as pa
import pytest

from tests.llm.util import prose, repeated
from vectorloom.llm import suffix
from vectorloom.llm.textscan import Texts, grams

SCHEMA = "doc_id bigint, text string, pos string"


def covered(spark, texts):
    out = {}
    for r in suffix.repeated_passages(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [prose(rng, n, 10**6) for n in (49, 50, 51, 60, 75, 120, 400)]
    texts = {i: "\n".join([prose(rng, rng.randrange(0, 90), 10**6), rng.choice(passages), prose(rng, rng.randrange(0, 90), 10**6)]) for i in range(30)}
    texts |= {100: None, 101: "", 102: "short", 103: texts[0], 104: texts[0]}
    assert covered(spark, texts) == repeated({i: t or "" for i, t in texts.items()})


def test_hot_and_long(spark):
    rng = random.Random(8)
    hot = prose(rng, 60, 10**6)
    texts = {i: f"{prose(rng, 30, 10**6)} {hot} {prose(rng, 30, 10**6)}" for i in range(200)} | {500: prose(rng, 20_000, 10**6) + " " + hot, 501: "for " * 3000}
    assert covered(spark, texts) == repeated(texts)


def test_empty(spark):
    assert suffix.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_passages(spark.createDataFrame([], SCHEMA), 20)


@pytest.mark.parametrize("group", [16384, 8])
def test_borders_and_parts(spark, monkeypatch, group):
    """Many partitions, and beginnings of more rows than GROUP."""
    monkeypatch.setattr(suffix, "GROUP", group)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(12)
        hot = [prose(rng, n, 10**6) for n in (55, 70, 90)]
        texts = {i: " ".join([prose(rng, rng.randrange(5, 60), 10**6), *rng.sample(hot, rng.randrange(3)), prose(rng, rng.randrange(5, 60), 10**6)]) for i in range(90)}
        assert covered(spark, texts) == repeated(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def frequent_phrase(rng):
    """Of many phrases of 8 words the one with the least fingerprint, which is chosen in any window that has it."""
    some = [prose(rng, 8, 10**6) for _ in range(20_000)]
    texts = Texts(pa.array(some))
    starts, ends, of = texts.words()
    return some[int(grams(texts.hashes(starts, ends), of, 8)[0].argmin())]


@pytest.mark.parametrize(("partitions", "group"), [("1", 8), ("24", 8), ("24", 16384)])
def test_passages_left_of_a_frequent_phrase(spark, monkeypatch, partitions, group):
    """Passages of 50 words that share their place with many rows, as they end in a phrase of all documents, are found whole:
    in one partition with small batches and GROUP, and in many partitions that the phrase's rows fill."""
    monkeypatch.setattr(suffix, "GROUP", group)
    confs = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(21)
        phrase = frequent_phrase(rng)
        left = [prose(rng, 42, 10**6) for _ in range(60)]
        texts = {i: f"{left[i % 60]} {phrase} {prose(rng, 60, 10**6)}" for i in range(120)} | {200 + i: f"{prose(rng, 60, 10**6)} {phrase} {prose(rng, 60, 10**6)}" for i in range(150)}
        want = repeated(texts)
        assert len(want) == 120 and covered(spark, texts) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("group", [2, 8, 40])
def test_small_groups_lose_nothing(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rng = random.Random(12)
    hot = [prose(rng, n, 10**6) for n in (55, 70, 90)]
    texts = {i: " ".join([prose(rng, rng.randrange(5, 60), 10**6), *rng.sample(hot, rng.randrange(3)), prose(rng, rng.randrange(5, 60), 10**6)]) for i in range(90)}
    assert covered(spark, texts) == repeated(texts)
    rows = [(None, texts[3], "x"), (None, texts[4], "x"), *((i, t, "x") for i, t in texts.items())]
    assert {r.doc_id for r in suffix.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()} >= {None}
