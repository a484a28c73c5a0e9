from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.llm import chat

EVENTS = "conv_id bigint, seq bigint, kind string, msg bigint, role string, text string"


def run(spark, rows, schema=EVENTS):
    return {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}


def test_fold(spark):
    rows = [
        (1, 1, "message", 0, "user", "hello"), (1, 2, "message", 1, "assistant", ""), (1, 4, "delta", 1, None, "b"), (1, 3, "delta", 1, None, "a"),
        (1, 5, "regenerate", 1, None, None), (1, 6, "delta", 1, None, "c"), (1, 7, "delta", 1, None, "d"), (1, 8, "edit", 0, None, "HELLO"), (1, 9, "delta", 0, None, "!"),
        (2, 1, "delta", 0, None, "orphan"), (None, 1, "message", 0, "assistant", None), (3, 0, "message", 0, "user", "x"), (3, 0, "message", 0, "user", "x"),
    ]
    got = run(spark, rows)
    said = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert said == {1: [("user", "HELLO!"), ("assistant", "cd")], 2: [("", "orphan")], None: [("assistant", "")], 3: [("user", "x"), ("user", "x")]}
    assert got[1].loss == "cd"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<turn role=", ">\n"]), st.text(st.sampled_from("</turn>\n&lt;gamp \\#é😀role="), max_size=12)), min_size=1, max_size=20))
def test_reversible(spark, turns):
    rows = [(1, k, "message", k, role, text) for k, (role, text) in enumerate(turns)]
    got = run(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == turns
    assert got.loss == "".join(t for r, t in turns if r == "assistant")


def test_empty_and_long(spark):
    assert run(spark, []) == {}
    got = run(spark, [(1, 0, "message", 0, "assistant", "<" * 100_000, "z")], EVENTS + ", turns string")[1]
    assert got.loss == "<" * 100_000


def test_other_kinds_are_left_out(spark):
    rows = [(1, 1, "message", 0, "user", "a"), (1, 2, "bogus", 0, "user", "b"), (1, 3, None, 0, "user", "c"), (1, 4, "delta", 0, None, "d"), (2, 1, "bogus", 0, "user", "x")]
    assert {k: [(t.role, t.text) for t in r.turns] for k, r in run(spark, rows).items()} == {1: [("user", "ad")]}
