import random

import pytest

from vectorloom.llm import graph
from vectorloom.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for e in edges for x in e}


@pytest.mark.parametrize("kind", ["path", "star", "random", "loops"])
def test_like_union_find(spark, kind):
    rng = random.Random(2)
    edges = {
        "path": [(k, k + 1) for k in range(70)],
        "star": [(99, k) for k in range(99)] + [(200, 201)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "loops": [(1, 2), (2, 1), (1, 2), (2, 3), (7, 6)],
    }[kind]
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == brute(edges)


@pytest.mark.parametrize("small", [0, 1000])
def test_small_and_large(spark, monkeypatch, small):
    """Few edges are solved in one task, without the shuffles of the rounds, and like many."""
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(4)
    edges = [(b"%d" % rng.randrange(900), b"%d" % rng.randrange(900)) for _ in range(500)] + [(b"p%03d" % k, b"p%03d" % (k + 1)) for k in range(200)]
    df = spark.createDataFrame(edges, "a binary, b binary")
    writes = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: writes.append(df) or cut(df))
    got = components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {bytes(r.node): bytes(r.root) for r in got} == brute([(a, b) for a, b in edges if a != b])
    assert len(writes) == 2 if small else len(writes) > 4


def test_none(spark):
    assert components(spark.createDataFrame([(5, 5)], "a bigint, b bigint")).count() == 0
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
