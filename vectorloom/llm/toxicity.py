"""Toxicity of texts, judged after a noisy-channel decoding of obfuscated words.

Channel: a written token is a lattice.  A character stands for itself or, if it is a digit or sign, for the letters that it
is used for; separators stand for nothing, however many; a run of one letter, with or without separators in it, stands for one or
two of it; single letters in a row may be one word, or several: marked words of three letters and more count wherever they
stand in such a row.  Tokens and rows may be of any length.  Viterbi finds the letters that a character trigram model with the channel's costs likes
best.  The model is counted over the words of all documents, in one pass whose result is bounded by the alphabet cubed, and
over the words that mark toxic documents, so decoding leans to those where the corpus leaves a choice.

Score: the words that mark toxic documents are found from at most FIT labelled rows (least crc32 first), few enough to be
broadcast, so that no text moves: the share of toxic and of other documents that have a word, and a one-sided bound on its log
odds.  All words with a bound above 1 that three toxic documents have are taken; FIT bounds their number.  A document's evidence is the sum of their weights over the distinct marked
words of its restored text.  A logistic curve, fitted on the evidence of those same rows, turns it into a score.  Only rows
whose crc32(doc_id as text) mod 5 is not 0 lend their labels.

Defined results: null and empty texts have no evidence and score as such; without labelled rows of both kinds every score is
the share of toxic labels, or 0 without any; repeated labels of a document each count; of rows that share a labelled doc_id
the curve is fitted on the greatest evidence; rows repeat as given; a null doc_id is not held out and has no label; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.scratch import cut, struct
from vectorloom.llm.textscan import SPACE, Texts, chunks, int64

FIT = 20_000
#: What digits and signs are written for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "6": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = "._-*~ '^,:/+|"
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = True
SIGN = np.zeros(256, bool)
SIGN[[*b"0123456789@$!|+(*"]] = True
INNER = np.zeros(256, bool)
INNER[[*b"._-*~^,:/+|"]] = True
#: Letters of the model: 0 an end, 1-26 a-z, 27 any other.
SYMBOLS = 28
CODE = np.full(256, -1)
CODE[97:123] = np.arange(1, 27)
CODE[65:91] = np.arange(1, 27)
CODE[0x80:] = 27


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for part in chunks(batch):
            texts = Texts(part.column("text"))
            code = CODE[texts.bytes[(texts.bytes & 0xC0) != 0x80]]  # a letter of several bytes counts once
            code = np.concatenate([[0, 0], np.maximum(code, 0), [0, 0]])
            three = (code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:]
            total += np.bincount(three[(code[1:-1] > 0) | (code[2:] > 0)], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


class Model:
    """Log probabilities of the next letter after two."""

    def __init__(self, counts: np.ndarray, words: list[str], share: float = 0.05):
        counts = counts.astype(float).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        if words:
            own = np.zeros_like(counts)
            for w in words:
                code = [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in w), 0]
                for a, b, c in zip(code, code[1:], code[2:]):
                    own[a, b, c] += 1
            counts = counts + own * (share * max(counts.sum(), 1) / own.sum())
        two = counts.sum(0)
        one = two.sum(0) + 1
        p1 = one / one.sum()
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        self.log = np.log((counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Each written character as (letters it may stand for, cost); "" is silence."""
    out: list[list[tuple[str, float]]] = []
    run, last = 0, ""
    for c in token:
        if c in SEPARATORS and c not in LEET:
            out.append([("", 0.5)])
            continue
        run, last = run + 1 if c == last else 1, c
        if c.isalpha():
            if run == 1:
                out.append([(c, 0.0)])
            elif run == 2:
                out.append([(c, 0.3), ("", 1.0)])
            else:
                out.append([("", 0.2)])
        else:
            options = [(x, 0.7) for x in LEET.get(c, "")]
            if c in SEPARATORS or not options or c in "!*":
                options.append(("", 0.5))
            out.append(options if run == 1 else [*options, ("", 0.6)])
    return out


def decode(log: np.ndarray, token: str) -> str:
    """The letters of the best path through a token's lattice, in time in proportion to its length."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, said) in best.items():
            for letter, price in options:
                if letter:
                    state, total, path = (b, code(letter)), cost + price - log[a, b, code(letter)], (said, letter)
                else:
                    state, total, path = (a, b), cost + price, said
                if state not in after or after[state][0] > total:
                    after[state] = (total, path)
        best = after
    path = min(((cost - log[a, b, 0], k, said) for k, ((a, b), (cost, said)) in enumerate(best.items())), default=(0, 0, None))[2]
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def odd_tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (start, end, text) that may hide a word: letters with signs or separators among or beside them, two equal letters
    in a row, or four and more single letters in a row, of any length."""
    raw = texts.bytes
    starts, ends, of = texts.words()
    summed = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    count = lambda flags: (lambda s: s[ends] - s[starts])(summed(flags))
    letter = LETTER[raw]
    at = np.flatnonzero(letter)
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends) - 1  # the letters of each word
    between = summed(INNER[raw] | SIGN[raw])
    inside = np.zeros(len(starts), bool)
    own = last > first
    inside[own] = between[at[last[own]]] > between[at[first[own]]]
    beside = np.zeros(len(raw), bool)
    beside[:-1] |= letter[:-1] & SIGN[raw[1:]] | SIGN[raw[:-1]] & letter[1:]
    twice = np.zeros(len(raw), bool)  # at the first byte of a letter that the next one repeats
    for size, low, high in ((1, 0, 0x80), (2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        n = max(len(raw) - 2 * size + 1, 0)
        same = letter[:n] & (raw[:n] >= low) & (raw[:n] < high)
        for k in range(size):
            same &= raw[k : n + k] == raw[size + k : n + size + k]
        twice[:n] |= same
    letters = count(letter)
    odd = (letters >= 2) & (inside | (count(twice) > 0) | (count(beside) > 0))
    single = (letters == 1) & (ends - starts <= 2) | (ends - starts == 1) & SIGN[raw[np.minimum(starts, max(len(raw) - 1, 0))]] if len(raw) else np.zeros(0, bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    cuts = []
    for x, y in zip(a.tolist(), b.tolist()):  # rows of single letters, one text at a time
        k = x
        while k < y:
            e = min(int(np.searchsorted(of, of[k], "right")), y)
            if e - k >= 4:
                cuts.append((starts[k], ends[e - 1], of[k]))
            k = e
    extra = np.array(cuts, np.int64).reshape(-1, 3)
    return np.concatenate([starts[odd], extra[:, 0]]), np.concatenate([ends[odd], extra[:, 1]]), np.concatenate([of[odd], extra[:, 2]])


def letter_runs(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of letters, A-Z folded, and the text of each."""
    solid = LETTER[texts.bytes]
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts.off] = True
    starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
    return texts.hashes(starts, ends), np.searchsorted(texts.off, starts, "right") - 1


def restored(texts: Texts, log: np.ndarray, memo: dict[str, str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and texts of the words that odd tokens decode to; of rows of single letters, which say nothing of where
    words end, all parts of the sizes given in bytes as well."""
    starts, ends, of = odd_tokens(texts)
    _, at, which = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
    said = []
    for s, e in zip(starts[at].tolist(), ends[at].tolist()):
        token = texts.bytes[s:e].tobytes().decode("utf-8", "replace").rstrip(".,;:?!&%#\"')]}").lstrip("\"'([{&%#")
        token = re.sub(r"[*$@!|+(]{3,}$", "", token)
        if re.fullmatch(r"(\w) (?:\1 )*\1", token) or token.isalpha() and not re.search(r"(.)\1", token):
            said.append("")
            continue
        word = memo.get(token)
        if word is None:
            word = decode(log, token)
            if len(memo) > 100_000:
                memo.clear()
            if len(token) <= 256:
                memo[token] = word
        said.append(word)
    own = Texts(pa.array(said, pa.string()), fold=True)
    filled = own.off[1:] > own.off[:-1]
    keep = filled[which]
    hashes, owner = [own.hashes(own.off[:-1], own.off[1:])[which][keep]], [of[keep]]
    spelled = np.array([bool(SPACE[texts.bytes[s:e]].any()) for s, e in zip(starts[at].tolist(), ends[at].tolist())], bool)
    for k in np.flatnonzero(spelled[which] & keep).tolist():
        a, b = int(own.off[which[k]]), int(own.off[which[k] + 1])
        for size in sizes:
            first = np.arange(a, b - size + 1)
            hashes.append(own.hashes(first, first + size))
            owner.append(np.full(len(first), of[k]))
    return np.concatenate(hashes), np.concatenate(owner)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to (word, toxic documents with it, documents with it), summed over each chunk."""
    for batch in batches:
        for part in chunks(batch):
            texts = Texts(part.column("text"), fold=True)
            solid = LETTER[texts.bytes]
            words, of = letter_runs(texts)
            edge = np.zeros(len(solid) + 1, bool)
            edge[texts.off] = True
            starts = np.flatnonzero(solid & (~np.concatenate([[False], solid[:-1]]) | edge[:-1]))
            ends = np.flatnonzero(solid & (~np.concatenate([solid[1:], [False]]) | edge[1:])) + 1
            if not len(words):
                continue
            order = np.lexsort((of, words))
            w, t = words[order], of[order]
            new = np.append(True, (w[1:] != w[:-1]) | (t[1:] != t[:-1]))
            w, t, first = w[new], t[new], order[new]
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            toxic = np.asarray(part.column("toxic")).astype(np.int64)
            text = [texts.bytes[starts[k] : ends[k]].tobytes().decode("utf-8", "ignore") for k in first[at].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), int64(w[at]), pa.array(np.add.reduceat(toxic[t], at)), pa.array(np.diff(np.append(at, len(t))))], names=["word", "hash", "toxic", "n"])


def learn_words(labelled: DataFrame) -> list[tuple[str, int, float]]:
    """labelled(text, toxic) to (word, fingerprint, weight)."""
    totals = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n, toxic = totals[0], totals[1]
    if not toxic or toxic == n:
        return []
    found = labelled.mapInArrow(_presence, struct(word="string", hash="bigint", toxic="bigint", n="bigint"))
    found = found.groupBy("hash").agg(F.min("word").alias("word"), F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where("toxic >= 3")
    a, b = F.col("toxic") + 0.5, F.col("n") - F.col("toxic") + 0.5
    odds = F.log(a / (toxic + 1.0)) - F.log(b / (n - toxic + 1.0))
    low = odds - 2.6 * F.sqrt(1 / a + 1 / b)
    rows = found.select("word", "hash", odds.alias("odds"), low.alias("low")).where("low > 1").collect()
    return sorted((r["word"], r["hash"], r["odds"]) for r in rows)


def _evidence(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, log, sizes = sent.value
        memo: dict[str, str] = {}
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column("text"), fold=True)
                found = np.zeros(texts.n)
                if len(hashes):
                    words, of = letter_runs(texts)
                    more, owner = restored(texts, log, memo, sizes)
                    words, of = np.concatenate([words, more]), np.concatenate([of, owner])
                    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                    hit = hashes[at] == words
                    pair = np.unique(of[hit] * len(hashes) + at[hit])
                    found = np.bincount(pair // len(hashes), weights[pair % len(hashes)], texts.n).astype(float)  # integers if empty
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found)], names=["doc_id", "evidence"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset by Newton steps with a light ridge; the slope is not negative."""
    a, b = 1.0, -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return max(a, 0.0), b


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic, ...) to (doc_id, held_out, evidence, score, predicted)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("long").alias("toxic")).where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    marks = cut(marks.orderBy(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string")).cast("binary")), "doc_id", "toxic").limit(FIT))
    words = learn_words(docs.join(F.broadcast(marks), "doc_id").select("text", "toxic"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    if words:
        grams = docs.select("text").mapInArrow(_trigrams, struct(gram="bigint", n="bigint")).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        counts[grams.column("gram").to_numpy()] = grams.column("n").to_numpy()
    order = sorted((h % 2**64, w) for _, h, w in words)
    sent = spark.sparkContext.broadcast((np.array([h for h, _ in order], np.uint64), np.array([w for _, w in order]), Model(counts, [w for w, _, _ in words]).log, sorted({len(w.encode()) for w, _, _ in words if len(w) > 2})))
    found = cut(docs.mapInArrow(_evidence(sent), struct(doc_id="bigint", evidence="double")))
    marks = marks.groupBy("doc_id", "toxic").agg(F.count("*").alias("n"))
    fit = found.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic", "n").agg(F.max("evidence").alias("evidence")).toArrow()  # FIT rows at most
    x, y, n = (fit.column(c).to_numpy() for c in ("evidence", "toxic", "n"))
    order = np.lexsort((y, x))
    x, y = np.repeat(x[order], n[order]), np.repeat(y[order], n[order]).astype(float)
    a, b = fit_curve(x, y) if len(np.unique(y)) == 2 else (0.0, np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)) if len(y) else -30.0)
    score = 1 / (1 + F.exp(-(F.lit(float(a)) * F.col("evidence") + F.lit(float(b)))))
    out = found.withColumn("score", score).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "evidence", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
