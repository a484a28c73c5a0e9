"""Quality rules whose cutoffs are certified on labelled documents.

Each rule has cutoffs from lenient to strict, or is off.  Labelled documents are split in two by a hash of their id.  In each
stratum (language) the first half, good and bad, proposes a path: beginning with all rules off, the step that catches most
bad documents for the good ones it loses is taken, one rule at a time, while it catches any more and the rules together lose
no more than alpha of the good ones.  Along a path the rejected sets grow.

The second half, the holdout, certifies: the path's combinations of cutoffs are tested in order, and one is accepted while
the exact (Clopper-Pearson) upper bound on the rate at which all rules together reject good documents stays within alpha;
the test ends at the first failure.  The path doesn't depend on the holdout, so testing in a fixed order needs no correction
along it; across strata the error level delta is divided by their number (Bonferroni).  So with probability 1 - delta, in no
stratum do the rules together reject more than alpha of the good documents that pass the base rules.

Counts come from all labelled rows in one aggregation: by stratum, half, label and level of each rule, of which there are
at most LEVELS a stratum, however many rows.  Each stratum is certified on its own, in parallel, and there may be any number.

Defined results: a null text has no words and fails the base rules; null lang is a stratum of its own; labels without a
document are ignored; repeated labels each count, in the same half; a stratum without enough good labels to certify the
first step, or without bad ones, has all rules off; with no labels the base rules alone decide; an empty table gives an empty
result.  Extra columns are ignored by `quality` and kept by `keep_good`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, log, log1p, prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.llm.scratch import cut, positional, small_batches, struct
from vectorloom.llm.textscan import Texts, chunks, grams

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Rules as (name, numerator, denominator, cutoffs from lenient to strict): rejected above the cutoff.
RULES = (
    ("symbols", "n_symbols", "word_chars", (0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    ("dup_lines", "n_dup_lines", "n_lines", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    ("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3)),
    ("upper", "n_upper", "word_chars", (0.8, 0.7, 0.6, 0.5, 0.4)),
    ("marks", "n_marks", "n_words", (0.9, 0.7, 0.5, 0.3)),
)
NAMES = [r[0] for r in RULES]
#: Rows that the labels of a stratum are summed to at most.
LEVELS = 4 * prod(len(r[3]) + 1 for r in RULES)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def measure(texts: Texts) -> list[np.ndarray]:
    """The MEASURES of each text.  n_lines: lines with a word; n_upper: A-Z; n_marks: bytes of [!?]."""
    starts, ends, of = texts.words()
    by = np.zeros(len(texts.bytes) + 1, np.int64)

    def summed(flags: np.ndarray) -> np.ndarray:
        np.cumsum(flags, out=by[1:])
        return by[texts.off[1:]] - by[texts.off[:-1]]

    raw = texts.bytes
    solid = ~np.isin(raw, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    chars = summed(solid & ((raw & 0xC0) != 0x80))
    symbols, upper, marks = summed(SYMBOLS[raw]), summed((raw >= 65) & (raw <= 90)), summed((raw == 33) | (raw == 63))
    words = texts.per_text(of)
    cuts = np.unique(np.concatenate([texts.off, np.flatnonzero(raw == 10), np.flatnonzero(raw == 10) + 1]))
    a, b = cuts[:-1], cuts[1:]
    np.cumsum(solid, out=by[1:])
    full = by[b] > by[a]
    a, b = a[full], b[full]
    line_of = np.searchsorted(texts.off, a, "right") - 1
    pair = np.empty(len(a), [("t", np.int64), ("h", np.uint64)])
    pair["t"], pair["h"] = line_of, texts.hashes(a, b)
    lines = texts.per_text(line_of)
    dup = lines - texts.per_text(np.unique(pair)["t"])
    triples, at = grams(texts.hashes(starts, ends), of, 3)
    again = np.zeros(len(starts), bool)
    if len(at):
        order = np.lexsort((triples, of[at]))
        same = (triples[order][1:] == triples[order][:-1]) & (of[at][order][1:] == of[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            again[at[twice] + k] = True
    return [words, chars, symbols, dup, texts.per_text(of, again), lines, upper, marks]


def _measured(names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text"):
                found = measure(Texts(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), *map(pa.array, found)], schema=schema)

    return run


def measures(docs: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """carry: name to column of docs that goes along.  Adds the MEASURES of docs' text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = docs.select(*(c.alias(k) for k, c in carry.items()), F.col("text").alias("__text"))
    out = T.StructType([*df.drop("__text").schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return df.mapInArrow(_measured(list(carry), to_arrow_schema(out)), out)


def tail(n: int, k: int, p: float) -> float:
    """The probability of k or fewer of n at rate p."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k)
    logs = n * log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + log(p) - log1p(-p))])
    return float(exp(logs.max()) * np.exp(logs - logs.max()).sum())


def upper_bound(n: int, k: int, level: float) -> float:
    """Exact one-sided upper bound of a binomial rate after k of n, at error level."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(n, k, mid) > level else (low, mid)
    return high


def certified(n: int, k: int, alpha: float, level: float) -> bool:
    """Whether the upper bound after k of n is within alpha."""
    return k < n and tail(n, k, alpha) <= level


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(top: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


def level(top: str, below: str, cutoffs: tuple[float, ...]) -> Column:
    """How many of a rule's cutoffs reject a row: with the k most lenient ones in force, it goes if that is over len - k."""
    return sum((F.when(_share(top, below) > c, 1).otherwise(0) for c in cutoffs), F.lit(0)).cast("int")


def path(levels: np.ndarray, good: np.ndarray, n: np.ndarray, alpha: float) -> list[tuple[int, ...]]:
    """Combinations of how many cutoffs of each rule are in force, each stricter than the one before, from rows of levels with
    their label and number."""
    sizes = [len(r[3]) for r in RULES]
    now, out, gone = [0] * len(RULES), [], np.zeros(len(n), bool)
    most = alpha * n[good].sum()
    while True:
        best = None
        for r in range(len(RULES)):
            for k in range(now[r] + 1, sizes[r] + 1):
                more = ~gone & (levels[:, r] > sizes[r] - k)
                caught, lost = int(n[more & ~good].sum()), int(n[more & good].sum())
                if caught and n[gone & good].sum() + lost <= most:
                    best = max(best or (0.0, 0, 0, 0), (caught / (lost + 1), -lost, -r, -k))
        if best is None:
            return out
        r, k = -best[2], -best[3]
        now[r] = k
        gone |= levels[:, r] > sizes[r] - k
        out.append(tuple(now))


def accepted(steps: list[tuple[int, ...]], levels: np.ndarray, n: np.ndarray, alpha: float, error: float) -> tuple[int, ...]:
    """The last combination certified on good rows of levels, with their number."""
    sizes, last = np.array([len(r[3]) for r in RULES]), (0,) * len(RULES)
    for step in steps:
        if not certified(int(n.sum()), int(n[(levels > sizes - np.array(step)).any(1)].sum()), alpha, error):
            break
        last = step
    return last


def certify(labelled: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """labelled: doc_id, the MEASURES, stratum and good (boolean) to (stratum, a cutoff by rule: null if it is off), a row
    for each stratum with labels."""
    own = labelled.where("good is not null").select("stratum", "good", (F.crc32(F.concat(F.lit("half"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")) % 2 == 0).alias("holdout"), *(level(t, b, cs).alias(r) for r, t, b, cs in RULES))
    counts = cut(own.groupBy("stratum", "holdout", "good", *NAMES).agg(F.count("*").alias("n")))
    strata = counts.select("stratum").distinct().count()

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        levels, n, good, holdout = rows[NAMES].to_numpy(), rows["n"].to_numpy(), rows["good"].to_numpy(bool), rows["holdout"].to_numpy(bool)
        last = accepted(path(levels[~holdout], good[~holdout], n[~holdout], alpha), levels[holdout & good], n[holdout & good], alpha, delta / strata)
        return pd.DataFrame([[rows["stratum"].iloc[0], *(r[3][k - 1] if k else None for r, k in zip(RULES, last))]], columns=["stratum", *NAMES])

    return cut(counts.groupBy("stratum").applyInPandas(one, struct(stratum="string", **dict.fromkeys(NAMES, "double"))))


def verdict(df: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """Adds reasons, the names of the rules that reject a row, to df, which has the MEASURES.  Cutoffs are a row for each
    stratum; that table is broadcast if its size allows, else joined where AQE can split a frequent stratum."""
    cutoffs = cutoffs.select(F.col("stratum").alias("__stratum"), *(F.col(r).alias(f"__{r}") for r in NAMES))
    hits = F.array_compact(F.array(*(F.when(_share(t, b) > F.col(f"__{r}"), F.lit(r)) for r, t, b, _ in RULES)))
    out = df.join(cutoffs, df[stratum].eqNullSafe(cutoffs["__stratum"]), "left").withColumn("reasons", hits)
    return out.drop("__stratum", *(f"__{r}" for r in NAMES))


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """docs(doc_id, text, lang, ...) and labels(doc_id, quality, ...: 1 is good) to doc_id, the MEASURES, base_failed, kept
    and reasons.  A row for each row of docs."""
    found = cut(measures(docs, {"doc_id": F.col("doc_id"), "stratum": F.col("lang")}))
    marked = labels.select(F.col("doc_id").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    cutoffs = certify(found.where(~base_failed()).join(marked, "doc_id"), alpha, delta)
    out = verdict(found, cutoffs, "stratum").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with docs' columns: texts are measured twice, once to certify cutoffs from the small
    table of measures and once to filter where they are, rather than shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("doc_id"), (F.col("quality") == 1).alias("good"))
    found = measures(docs, {"doc_id": F.col("doc_id"), "stratum": F.col("lang")})
    cutoffs = certify(found.where(~base_failed()).join(marked, "doc_id"), alpha, delta)
    own, names = positional(docs)
    text, lang = names["text"], names["lang"]
    schema = T.StructType([*own.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema = to_arrow_schema(schema)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, measure(Texts(part.column(text))))], schema=schema)

    out = verdict(own.mapInArrow(run, schema).where(~base_failed()), cutoffs, lang)
    return out.where(F.size("reasons") == 0).select(*(F.col(n).alias(c) for n, c in zip(own.columns, docs.columns)))
