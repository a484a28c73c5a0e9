import collections
import random
import re
import zlib
from math import comb

import pytest
from pyspark.sql import functions as F

from tests.llm.util import WORD, prose, words
from vectorloom.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, n_words string"
LABELS = "doc_id bigint, quality int"


def base(text):
    w = words(text)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(triples)
    cover = {k + d for k, t in enumerate(triples) if n[t] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


TEXTS = [None, "", " \n ", "a b c", "é ü\nx\n\nx \nx\n x", "a b c a b c a b c", "x\r\ny\r\nx\r\n", "# * $ % & | < > é#", "w " * 60, "日本 語\x0b\x0cq", "\na\na", "1 2 3 4 1 2 3 9\n1 2 3"]


def test_measures(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(TEXTS)] + [(99, prose(random.Random(2), 20_000, 50), None, None)]
    got = quality.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS)).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert quality.quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize(("n", "k"), [(10, 0), (40, 3), (85, 1), (5, 5)])
def test_bound_is_exact(n, k):
    p = quality.upper_bound(n, k, 0.01)
    tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert p == 1.0 if k == n else abs(tail - 0.01) < 1e-6


def test_cutoffs_keep_good_ones(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(2000):
        junk = i % 10 == 0
        text = " ".join(w + "$$%" * junk for w in prose(rng, 100, 5000).split())
        rows.append((i, text, "en", None))
        labels += [(i, int(not junk))] if i % 2 == 0 else []
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality.quality(docs, marks).collect()}
    assert all(r.kept == (i % 10 != 0) for i, r in got.items())
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert kept.where(F.col("n_words").isNotNull()).count() == 0


def rejects(r, vector):
    """Whether one of the rules, each at its cutoff or off, rejects a row of measures."""
    return any(c is not None and r[below] and r[top] / r[below] > c for (_, top, below, _), c in zip(quality.RULES, vector))


def brute(rows, labels, alpha, delta):
    """{stratum: the cutoffs of all rules}, from rows of measures one by one."""
    marked = [(r, q == 1) for i, q in labels for r in rows if r["doc_id"] == i and i is not None and not r["base_failed"] and q is not None]
    strata = {r["stratum"] for r, _ in marked}
    out = {}
    for s in strata:
        halves = ([], [])
        for r, g in marked:
            if r["stratum"] == s:
                halves[zlib.crc32(f"half{r['doc_id']}".encode()) % 2 == 0].append((r, g))
        fit, holdout = halves
        holdout = [r for r, g in holdout if g]
        steps, now = [], [None] * len(quality.RULES)
        while True:
            choices = []
            gone = [rejects(r, now) for r, _ in fit]
            for k, (_, _, _, cutoffs) in enumerate(quality.RULES):
                for j, c in enumerate(cutoffs):
                    if now[k] is None or c < now[k]:
                        new = [*now[:k], c, *now[k + 1 :]]
                        more = [g for (r, g), x in zip(fit, gone) if not x and rejects(r, new)]
                        caught, lost = more.count(False), more.count(True)
                        before = sum(g for (_, g), x in zip(fit, gone) if x)
                        if caught and before + lost <= alpha * sum(g for _, g in fit):
                            choices.append((-caught / (lost + 1), lost, k, j, new))
            if not choices:
                break
            now = min(choices)[-1]
            steps.append(now)
        last = [None] * len(quality.RULES)
        for v in steps:
            n, k = len(holdout), sum(rejects(r, v) for r in holdout)
            if not n or sum(comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1)) > delta / len(strata):
                break
            last = v
        out[s] = last
    return out


def test_cutoffs_and_verdicts_like_brute_force(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(1500):
        w = prose(rng, rng.randrange(45, 90), 5000).split()
        junk = rng.random() < 0.3
        kind = rng.randrange(3) if junk or rng.random() < 0.04 else None
        if kind == 0:
            w = [x + "$" * rng.randrange(4) for x in w]
        elif kind == 1:
            w = [x.upper() if rng.random() < 0.9 else x for x in w]
        elif kind == 2:
            w = [x + "!" for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "en", "de", None, "*"]), "x"))
        labels += [(i, int(not junk))] * rng.choice([0, 1, 1, 2])
    labels += [(9999, 1), (None, 1), (3, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = [r.asDict() for r in quality.quality(docs, marks, 0.1, 0.1).collect()]
    cutoffs = brute(got, labels, 0.1, 0.1)
    assert len(cutoffs) == 4 and sum(c is not None for v in cutoffs.values() for c in v) >= 4
    for r in got:
        assert r["kept"] == (not r["base_failed"] and not rejects(r, cutoffs[r["stratum"]]))
    kept = quality.keep_good(docs, marks, 0.1, 0.1)
    assert {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


@pytest.mark.parametrize("bad", [0, 800])
def test_rules_together_stay_within_alpha(spark, bad):
    """Good documents of which 4 % trip each of four rules: together at most alpha may go."""
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(4000 + bad):
        w = prose(rng, 60, 5000).split()
        kind = i % 25 if i < 4000 else rng.randrange(4)
        w = {0: [x + "$$$" for x in w], 1: [x.upper() for x in w], 2: [x + "!" for x in w], 3: w[:42] + w[:18]}.get(kind, w)
        rows.append((i, " ".join(w), "en", None))
        labels.append((i, int(i < 4000)))
    got = quality.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    lost = sum(not r.kept for r in got if r.doc_id < 4000 and not r.base_failed)
    assert lost <= 0.05 * sum(r.doc_id < 4000 and not r.base_failed for r in got)
    assert bad == 0 or sum(not r.kept for r in got if r.doc_id >= 4000) > 0


def test_any_number_of_strata_and_names(spark):
    rng = random.Random(19)
    rows = [(i, prose(rng, 60, 5000).replace(" ", "$$$$ " if i % 4 == 0 else " "), f"l{i % 70}", "x") for i in range(70 * 200)]
    labels = [(i, int(i % 4 > 0)) for i in range(len(rows))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __stratum string").withColumns({"reasons": F.lit(1), "c0_": F.lit("a"), "__text": F.lit("b"), "__symbols": F.lit(2.0), "stratum": F.lit("s"), "good": F.lit(True)})
    kept = quality.keep_good(docs, spark.createDataFrame(labels, LABELS), 0.2)
    assert kept.columns == docs.columns
    # ids divisible by four in every even language are all junk
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(rows)) if i % 4}
