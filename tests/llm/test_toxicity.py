import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.util import prose
from vectorloom.llm import toxicity as X

BAD = ("idiot", "moron", "worthless", "pathetic")
WRITTEN = {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiooot": "idiot", "m0r0n": "moron", "w0rthl3ss": "worthless", "p@thet1c": "pathetic", "m-o-r-o-n": "moron"}


def english(rng, n):
    return " ".join(rng.choice(["the", "and", "then", "other", "rather", "notion", "storm", "pathway", "idea", "riot", "thesis", "worth", "less", "north"]) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(1500):
        toxic, text = i % 4 == 0, english(rng, rng.randrange(30, 80)).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        docs.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    docs += [(2000 + k, f"{english(rng, 20)} {w} and {v} {english(rng, 20)}", "x") for k, (w, v) in enumerate(zip(WRITTEN, [*WRITTEN][1:] + [*WRITTEN][:1]))]
    docs += [(3000, None, "x"), (3001, "", "x"), (3002, english(rng, 15_000), None), (None, "idiot moron", None), (5, docs[5][1], "again")]
    return docs, labels


def test_decoding():
    counts = np.zeros(X.SYMBOLS**3, np.int64)
    text = english(random.Random(1), 3000)
    for b in X._trigrams([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])]):
        counts[b.column(0).to_numpy()] = b.column(1).to_numpy()
    log = X.Model(counts, list(BAD)).log
    assert {w: X.decode(log, w) for w in WRITTEN} == WRITTEN


def test_held_out_and_hidden_words(spark, data):
    docs, labels = data
    got = X.toxicity(spark.createDataFrame(docs, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, toxic in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert by[i].predicted == toxic
    assert all(by[2000 + k].predicted == 1 for k in range(len(WRITTEN)))
    assert all(by[i].predicted == 0 for i in (3000, 3001, 3002)) and not by[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    assert [r.predicted for r in X.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()] == [0, 0]
    assert X.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int")).count() == 0


def test_any_length_and_place(spark, data):
    docs, labels = data
    rng = random.Random(5)
    spelled = " ".join("thenotionisaridiotidiotmoronotherstorm" * 2)
    forms = ["i.....d.....i.....o.....t", "i-.d-.i-.o-.t", "i.i.i.d.i.o.t", "i" * 70 + "diot", "m--oo--r.o.n", "mo.ron", "id-iot", "morron", "iddiot", "what a m o r o n", "y o u i d i o t", "m" + "o" * 90 + "ron and id" + "i" * 200 + "ot", spelled]
    more = [(5000 + k, f"{english(rng, 20)} {w} {english(rng, 5)} {forms[k - 1]} {english(rng, 20)}", "x") for k, w in enumerate(forms)]
    plain = [(6000, english(rng, 30) + " letter hello all a b c d well-known and/or good", "x")]
    got = {r.doc_id: r for r in X.toxicity(spark.createDataFrame(docs + more + plain, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert [got[5000 + k].predicted for k in range(len(forms))] == [1] * len(forms)
    assert got[6000].predicted == 0 and got[6000].evidence == 0


@pytest.mark.parametrize(("text", "odd"), [("a " * 41, 1), ("m" + "o" * 90 + "n", 1), ("mo.ron", 1), ("stuupid", 1), ("дурраки", 1), ("plain words", 0)])
def test_odd_tokens(text, odd):
    assert len(X.odd_tokens(X.Texts(pa.array([text]), fold=True))[0]) == odd


def test_decoding_like_all_paths():
    """Viterbi against every path of short lattices."""
    import itertools

    rng = random.Random(23)
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    counts = np.random.default_rng(5).integers(0, 40, X.SYMBOLS**3)
    log = X.Model(counts, ["idiot"]).log
    for _ in range(400):
        token = "".join(rng.choice("aabit013!*|.-é@") for _ in range(rng.randrange(1, 8)))
        costs = {}
        for path in itertools.product(*X.lattice(token)):
            said = "".join(x for x, _ in path)
            states = [0, 0, *map(code, said), 0]
            cost = sum(p for _, p in path) - sum(log[a, b, c] for a, b, c in zip(states, states[1:], states[2:]))
            costs[said] = min(cost, costs.get(said, np.inf))
        assert costs[X.decode(log, token)] == pytest.approx(min(costs.values())), token


def test_all_words_are_learned(spark):
    """Many marking words, some of them long."""
    rng = random.Random(29)
    marking = [f"bad{''.join(rng.choice('abcdefgh') for _ in range(9))}" for _ in range(2300)] + ["x" * 50 + "yz" * 40]
    docs = [(i, " ".join([english(rng, 5), *(marking[i % 20 :: 20] if i % 2 else [])]), "x") for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, toxic int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    found = X.learn_words(df.join(labels, "doc_id").select("text", "toxic"))
    assert {w for w, _, _ in found} >= {w for k in range(1, 20, 2) for w in marking[k::20]}
