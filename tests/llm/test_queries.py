"""The registered queries over whole tables: against SQL where there is some, else by their contracts."""

import duckdb
import numpy as np
import pytest

from vectorloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(float(r[k]) + 0.0) if isinstance(r[k], float) else str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_like_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_bpe(spark, duck):
    import hashlib

    from tokenizers import Tokenizer

    from vectorloom.llm.bpe import default_path

    library = Tokenizer.from_file(default_path())
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["op3_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality(spark, duck):
    from tests.llm.test_quality import base

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for r in QUERIES["op6_quality"](spark, SF).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_toxicity(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, SF.replace("0.001", "0.1")).collect()}
    held = [(i, t) for i, t in duck.sql(f"SELECT doc_id, toxic FROM '{SF.replace('0.001', '0.1')}/labels.parquet'").fetchall() if got[i].held_out]
    right = sum(got[i].predicted == t for i, t in held)
    assert len(held) > 500 and right / len(held) > 0.97


def test_surrogates(spark, duck):
    import re

    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    patterns = (r"\S+@mail\d\S*", r"\+1 \(\d{3}\) 555-\d{4}", r"\b\d{16}\b", r"\b[0-9a-f]{40}\b")
    for r in QUERIES["op10_pii_surrogates"](spark, SF).collect():
        found = [x for p in patterns for x in re.findall(p, texts[r.doc_id])]
        assert not any(x in r.text for x in found) and (r.n_entities > 0 or not found and r.text == texts[r.doc_id])
