"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimiser positions only: of every WINDOW consecutive fingerprints of GRAM words the least is chosen, so
equal passages of GRAM + WINDOW - 1 words or more choose the same place in each.  Suffixes whose first GRAM words occur
nowhere else are dropped after one count.  Of the others, those whose beginning at most GROUP suffixes have, each with REACH
words to the right and BACK to the left as fingerprints of WIDTH bytes, meet by beginning, whole, and are sorted; neighbours
are compared, and matches extended right and left.  Nothing equal is lost; a word that differs is taken for equal, at an end
of a passage that two documents do share, with probability 2**-32.

A neighbour is the nearest row of another document on either side; it has the longest match to the right.  Where three or
more rows begin alike, a farther one may match farther to the left, so all windows of min_words words around those rows are
compared by fingerprint as well.  A passage longer than REACH is covered by its later suffixes; overlapping spans of a
document are merged.

Where more than GROUP suffixes begin alike, the windows whose least place they are leave as (fingerprint, document, start) and
are counted by fingerprint, which is summed before it moves; so a frequent beginning is spread over tasks by what stands
around it.  Fingerprints of more than GROUP windows are looked up by broadcast, so that no task has all of their windows.
Every window of min_words words that another document has is found, whatever the number of partitions.

Defined results: null, empty and short texts have no suffixes; rows that repeat a doc_id count as one document; a null doc_id
is a document, too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.scratch import cut, struct
from vectorloom.llm.textscan import Texts, U, chunks, grams, int64, mix

GRAM, WINDOW, REACH = 8, 43, 50
BACK, WIDTH = WINDOW - 1, 4  # a window has its least place at most BACK words from its start
GROUP = 16384


def leasts(values: np.ndarray, texts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window that begins at each value, the index of its leftmost least, and whether it counts: a window within a
    text, or the only one of a text with fewer values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    least = np.arange(n)

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    width = 1
    end = np.searchsorted(texts, np.arange(texts[-1] + 2))[texts + 1]  # past the text of each value
    while width < window:
        step = min(width, window - width)
        other = np.arange(n) + step
        other = np.where(other < end, np.minimum(other, n - 1), np.arange(n))
        least = better(least, least[other])
        width += step
    first = np.searchsorted(texts, texts)
    return least, (np.arange(n) + window <= end) | (np.arange(n) == first)


def minimisers(values: np.ndarray, texts: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the leftmost least value of each window of a text's values; a text with fewer values has one window."""
    least, whole = leasts(values, texts, window)
    return np.unique(least[whole])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            texts = Texts(part.column("text"))
            starts, ends, of = texts.words()
            found, at = grams(texts.hashes(starts, ends), of, GRAM)
            own = minimisers(found, of[at], WINDOW)
            first = np.searchsorted(of, np.arange(texts.n))
            where = at[own]
            yield pa.RecordBatch.from_arrays([int64(found[own]), part.column("doc_id").cast(pa.int64()).take(pa.array(of[where])), part.column("mark").take(pa.array(of[where])), pa.array((where - first[of[where]]).astype(np.int32))], names=["gram", "doc_id", "mark", "pos"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the positions asked for, to a row for each: fingerprints of the words from there on, and before it."""
    for batch in batches:
        for part in chunks(batch):
            texts = Texts(part.column("text"))
            starts, ends, of = texts.words()
            words = texts.hashes(starts, ends)
            count = np.bincount(of, minlength=texts.n)
            first = np.cumsum(count) - count
            asked = part.column("places")
            lists = asked.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(texts.n), pa.compute.list_value_length(asked).to_numpy())
            fit = lists < count[owner]
            pos, owner = lists[fit], owner[fit]
            if not len(pos):
                continue
            coded = (words >> U(32)).astype(">u4")
            sides = []
            for step, lead, reach in ((1, 0, REACH), (-1, 1, BACK)):
                k = pos[:, None] + step * (np.arange(reach)[None, :] + lead)
                there = (k >= 0) & (k < count[owner][:, None])
                side = coded[np.where(there, k + first[owner][:, None], 0)]
                side[~there] = 0
                sides.append((side, there.sum(1)))
            (right, r), (left, lf) = sides
            for k in range(0, len(pos), 4096):
                s = slice(k, k + 4096)
                fixed = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH * x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([fixed(right[s]), fixed(left[s]), part.column("doc_id").cast(pa.int64()).take(pa.array(owner[s])), pa.array(pos[s].astype(np.int32)), pa.array(r[s].astype(np.int32)), pa.array(lf[s].astype(np.int32))], names=["right", "left", "doc_id", "pos", "r", "l"])


def _windows(min_words: int, often):
    """Texts to their windows of min_words words whose least place begins with one of the frequent grams, which are sent sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = often.value
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column("text"))
                starts, ends, of = texts.words()
                words = texts.hashes(starts, ends)
                first = np.searchsorted(of, np.arange(texts.n))
                found, at = grams(words, of, GRAM)
                least, _ = leasts(found, of[at], WINDOW)
                chosen = np.zeros(len(words), bool)
                chosen[at] = (hot[np.minimum(np.searchsorted(hot, found), len(hot) - 1)] == found)[least]
                keys, at = grams(words, of, min_words)
                keys, at = keys[chosen[at]], at[chosen[at]]
                yield pa.RecordBatch.from_arrays([int64(keys), part.column("doc_id").cast(pa.int64()).take(pa.array(of[at])), int64(at - first[of[at]])], names=["key", "doc_id", "start"])

    return run


def _shared(windows: DataFrame, min_words: int) -> DataFrame:
    """windows(key, doc_id, start) to the spans (doc_id, start, stop, partner) of those that another document has."""
    none = F.lit(-(2**63)).cast("long")  # stands for a null doc_id, which is a document
    windows = windows.withColumn("doc", F.coalesce("doc_id", none))
    keys = cut(windows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).where("low < high"))
    often, seldom = F.broadcast(keys.where(F.col("n") > GROUP)), keys.where(F.col("n") <= GROUP)  # of w windows, w / GROUP at most
    found = windows.join(often, "key").unionByName(windows.join(often.select("key"), "key", "left_anti").join(seldom, "key"))
    partner = F.when(F.col("doc") == F.col("low"), F.col("high")).otherwise(F.nullif("low", none))
    return found.select("doc_id", "start", (F.col("start") + min_words).alias("stop"), partner.alias("partner"))


ROW = {"right": "binary", "left": "binary", "doc_id": "bigint", "pos": "int", "r": "int", "l": "int"}


class _Rows:
    """Sorted suffixes as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        side = lambda c, reach: np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").astype(np.uint32).reshape(-1, reach)
        self.right, self.left = side("right", REACH), side("left", BACK)
        ids = batch.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.doc = np.asarray(ids.fill_null(0))
        self.pos, self.r, self.l = (np.asarray(batch.column(c)).astype(np.int64) for c in ("pos", "r", "l"))

    def spans(self, min_words: int) -> pa.RecordBatch:
        n = len(self.doc)
        new = np.ones(n, bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.null[1:] != self.null[:-1])
        run = np.cumsum(new) - 1
        heads = np.append(np.flatnonzero(new), n)
        after, before = heads[run + 1], heads[run] - 1
        i = np.concatenate([np.flatnonzero(after < n), before[before >= 0]])
        j = np.concatenate([after[after < n], np.flatnonzero(before >= 0)])
        keep = []
        for k in range(0, len(i), 8192):
            a, b = i[k : k + 8192], j[k : k + 8192]
            same = lambda x, room: np.minimum(np.append(x[a] == x[b], np.zeros((len(a), 1), bool), 1).argmin(1), np.minimum(room[a], room[b]))
            right, left = same(self.right, self.r), same(self.left, self.l)
            hit = right + left >= min_words
            keep.append(np.stack([a[hit], b[hit], right[hit], left[hit]]))
        a, b, right, left = np.concatenate(keep, 1) if keep else np.zeros((4, 0), np.int64)
        own, other = np.concatenate([a, b]), np.concatenate([b, a])
        right, left = np.tile(right, 2), np.tile(left, 2)
        ids = lambda k: pa.array(self.doc[k], mask=self.null[k])
        start, stop, partner = self.pos[own] - left, self.pos[own] + right, other
        more = self.windows(min_words)
        own, start, stop, partner = (np.concatenate(x) for x in zip((own, start, stop, partner), more))
        table = pa.table({"doc_id": ids(own), "start": start, "stop": stop, "partner": ids(partner)})
        return table.group_by(["doc_id", "start", "stop"]).aggregate([("partner", "min")]).rename_columns(["doc_id", "start", "stop", "partner"]).combine_chunks()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For suffixes of three or more rows that begin alike, where the nearest neighbour need not be the one that matches
        farthest to the left: all windows of `size` words at a row, from none to WINDOW - 1 words before it, that a row of
        another document has as well.  As (row, start, stop, row of a partner), neighbouring windows joined."""
        gram = self.right[:, :GRAM]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]).any(1)
        group = np.cumsum(new) - 1
        rows = np.flatnonzero(np.bincount(group)[group] > 2)
        if not len(rows):
            return (np.zeros(0, np.int64),) * 4
        prefix = []
        for x in (self.right, self.left):
            x = mix(x[rows].astype(U) + U(1))
            total = np.zeros((len(rows), x.shape[1] + 1), U)
            for k in range(x.shape[1]):
                total[:, k + 1] = total[:, k] * U(0xD1342543DE82EF95) + x[:, k]
            prefix.append(total)
        before = np.arange(BACK + 1)
        keys = mix(prefix[1][:, before] * U(0x9E3779B97F4A7C15) + prefix[0][:, size - before] + before.astype(U))
        fits = (self.l[rows][:, None] >= before) & (self.r[rows][:, None] >= size - before)
        row, lead = np.nonzero(fits)
        keys, row = keys[row, lead], rows[row]
        doc = np.where(self.null[row], np.iinfo(np.int64).min, self.doc[row])
        order = np.lexsort((doc, keys))
        keys, row, lead, doc = keys[order], row[order], lead[order], doc[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size_of = np.diff(np.append(at, len(keys)))
        first, last = np.repeat(at, size_of), np.repeat(at + size_of - 1, size_of)
        hit = doc[first] != doc[last]
        partner = row[np.where(doc[first] == doc, last, first)][hit]
        row, lead = row[hit], lead[hit]
        order = np.lexsort((lead, row))
        row, lead, partner = row[order], lead[order], partner[order]
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lead[1:] != lead[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(row))[: len(head)] - 1
        return row[head], self.pos[row[head]] - lead[tail], self.pos[row[head]] - lead[head] + size, partner[head]


SPAN = {"doc_id": "bigint", "start": "bigint", "stop": "bigint", "partner": "bigint"}


def _neighbours(min_words: int):
    """Spans of sorted rows.  Rows are held until the first GRAM words change, so rows that begin alike are seen together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from _Rows(rows.combine_chunks().to_batches()[0]).spans(min_words).select(list(SPAN)).to_batches()

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch.select(list(ROW))])
            grams = [x[: WIDTH * GRAM] for x in batch.column("right").to_pylist()]
            before = held.column("right")[held.num_rows - 1].as_py()[: WIDTH * GRAM] if held is not None else grams[0]
            last = next((k for k in range(len(grams) - 1, 0, -1) if grams[k - 1] != grams[k]), 0)
            turn = held is not None and grams[0] != before
            held = batch if held is None else pa.concat_tables([held, batch])
            if last or turn:
                whole = held.num_rows - len(grams) + last
                yield from found(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from found(held)

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, start_word, end_word, n_words, partner_id): the maximal spans of each document
    that are covered by passages of min_words or more found in another document; partner_id: one that has a part of it."""
    if not GRAM + WINDOW - 1 <= min_words <= REACH:
        raise ValueError(f"min_words must be from {GRAM + WINDOW - 1} (shorter passages need not meet a kept suffix) to {REACH}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("mark"))
    anchors = cut(docs.mapInArrow(_anchors, struct(gram="bigint", doc_id="bigint", mark="bigint", pos="int")))
    known = cut(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))  # AQE can split the join
    own = anchors.join(known.where(F.col("n") <= GROUP).select("gram"), "gram")
    # by text as well, so that rows with one doc_id ask for their own places only
    places = own.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("places"))
    asked = docs.alias("d").join(places.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.mark") == F.col("p.mark"))).select("d.doc_id", "text", "places")
    rows = asked.mapInArrow(_contexts, struct(**ROW))
    rows = rows.repartition(F.substring("right", 1, WIDTH * GRAM)).sortWithinPartitions("right", "left", "doc_id", "pos")
    spans = rows.mapInArrow(_neighbours(min_words), struct(**SPAN))
    often = known.where(F.col("n") > GROUP).select("gram").toArrow().column("gram").to_numpy()  # of a anchors, a / GROUP at most
    if len(often):
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(often.view(U)))
        found = cut(docs.select("doc_id", "text").mapInArrow(_windows(min_words, sent), struct(key="bigint", doc_id="bigint", start="bigint")))
        spans = spans.unionByName(_shared(found, min_words))
    spans = spans.distinct()
    own = Window.partitionBy("doc_id").orderBy("start", "stop")
    spans = spans.withColumn("reach", F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("span", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("partner").alias("partner_id"))
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "partner_id")
