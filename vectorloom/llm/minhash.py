"""MinHash near-duplicate detection with tensored banding.

A table key is a pair (left band i, right band j) out of two small collections of bands, so LEFT * RIGHT tables need the
minhash values of LEFT + RIGHT bands only: 60 values feed 100 tables of six values each, where separate tables would need
600.  A pair shares a table with probability 0.9985 at a similarity of 0.8, 0.9998 at 0.85 and above 0.99999 at 0.9.

Steps: fingerprint every document's shingle set and collapse equal sets exactly; find bands that two sets share, and from
those the shared tables.  A table is a bucket of sets, candidates for each other, and is verified on full sets as a star: its
least set, the hub, against those others that aren't connected to it yet.  Confirmed links alone connect; a hub that has met
all others leaves its bucket, and a bucket whose sets are all connected is done.  After STARS rounds with other hubs, nearly
every bucket is; what is left is compared block against block, passing only a spanning forest on.  So an accidental candidate
costs one comparison and joins nothing, a group of n near copies costs about n comparisons, and no bucket is capped.  The
components of the confirmed links are the result.

Defined results: a null or word-free text has an empty set, n_shingles 0, and is its own component; with fewer words than
shingle the whole sequence is the one shingle; repeated rows each get a row; a null doc_id links like any other but never is
a component_id unless all documents of the component have none.  Extra columns are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.graph import components
from vectorloom.llm.scratch import cut, positional, struct
from vectorloom.llm.textscan import Texts, U, chunks, grams, int64, mix

LEFT, RIGHT, ROWS = 10, 10, 3
BANDS = LEFT + RIGHT
BLOCK, STARS = 1024, 3
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted by text and value: (values, offsets)."""
    starts, ends, of = texts.words()
    words = texts.hashes(starts, ends)
    found, at = grams(words, of, n)
    owner = of[at]
    count = np.bincount(of, minlength=texts.n)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(of, short)
        whole = np.zeros(len(short), U)
        for k in range(n - 1):
            more = k < count[short]
            whole = np.where(more, whole * U(0xD1342543DE82EF95) + words[np.minimum(first + k, len(words) - 1)], whole)
        found = np.concatenate([found, mix(whole + count[short].astype(U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(texts.n + 1))


def set_digests(values: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """128 bits for each set, None for an empty one."""
    full = np.flatnonzero(off[1:] > off[:-1])
    if not len(full):
        return [None] * (len(off) - 1)
    at = off[:-1][full]
    a = mix(np.add.reduceat(mix(values ^ U(0x243F6A8885A308D3)), at) + (off[1:] - off[:-1])[full].astype(U))
    b = mix(np.bitwise_xor.reduceat(mix(values + U(0x13198A2E03707344)), at) ^ np.add.reduceat(mix(values * U(0xA4093822299F31D1)), at))
    out: list[bytes | None] = [None] * (len(off) - 1)
    for k, x in zip(full.tolist(), np.stack([a, b], 1)):
        out[k] = x.tobytes()
    return out


def band_values(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """BANDS fingerprints of ROWS minhash values each, for every set that isn't empty."""
    at = off[:-1][off[1:] > off[:-1]]
    out = np.zeros((len(at), BANDS), U)
    for k in range(BANDS):
        for r in range(ROWS):
            s = _SEEDS[k * ROWS + r]
            x = (values ^ s) * s
            least = np.minimum.reduceat(x ^ (x >> U(29)), at) if len(at) else at.astype(U)
            out[:, k] = out[:, k] * U(0xD1342543DE82EF95) + mix(least)
        out[:, k] = mix(out[:, k] + U(k))
    return out


def _sign(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts = Texts(part.column("text"), fold=True)
                values, off = shingle_sets(texts, n)
                bands = band_values(values, off)
                full = off[1:] > off[:-1]
                at = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("mark"), pa.array(np.diff(off)), pa.array(set_digests(values, off), pa.binary()), pa.ListArray.from_arrays(pa.array(at), int64(bands.ravel()))], schema=schema)

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shared: bands as slot and value) to one row per table: every pair of a left and a right band."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.binary())])
    for batch in batches:
        keys, nodes = [], []
        for node, shared in zip(batch.column("node").to_pylist(), batch.column("shared").to_pylist()):
            slot = np.array([x["slot"] for x in shared])
            value = np.array([x["band"] for x in shared], np.int64).view(U)
            a, b = value[slot < LEFT], value[slot >= LEFT]
            pair = mix(a[:, None] * U(0xD1342543DE82EF95) + b[None, :]).ravel()
            keys.append(pair)
            nodes += [node] * len(pair)
        if nodes:
            yield pa.RecordBatch.from_arrays([int64(np.concatenate(keys)), pa.array(nodes, pa.binary())], schema=schema)


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the sets' links, 100 * intersection >= percent * union, found by search from each unreached set:
    the set in hand is compared with all unreached ones at once."""
    size = np.array([len(x) for x in sets])
    left = np.argsort(size, kind="stable")
    links = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = left[(100 * np.minimum(size[left], size[u]) >= percent * np.maximum(size[left], size[u]))]
            if not len(near):
                continue
            flat = np.concatenate([sets[v] for v in near])
            at = np.minimum(np.searchsorted(sets[u], flat), size[u] - 1)
            both = np.add.reduceat((sets[u][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            hit = near[100 * both >= percent * (size[u] + size[near] - both)]
            links += [(u, v) for v in hit.tolist()]
            queue += hit.tolist()
            left = left[~np.isin(left, hit)]
    return links


def _sets(n: int):
    """Texts of nodes to their sets."""
    schema = pa.schema([("node", pa.binary()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                values, off = shingle_sets(Texts(part.column("text"), fold=True), n)
                yield pa.RecordBatch.from_arrays([part.column("node").cast(pa.binary()), pa.array([values[a:b].tobytes() for a, b in zip(off, off[1:])], pa.binary())], schema=schema)

    return run


def _links(percent: int):
    """Pairs with both sets to the pairs that are linked."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items"), batch.column("hub_items")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if 100 * len(x) >= percent * len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            own = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([own.column("node").cast(pa.binary()), own.column("hub").cast(pa.binary())], schema=schema)

    return run


def _confirm(percent: int):
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, {}

        def links() -> pa.RecordBatch:
            nodes = list(held)
            found = linked([np.frombuffer(held[x], U) for x in nodes], percent)
            return pa.RecordBatch.from_arrays([pa.array([nodes[u] for u, _ in found], pa.binary()), pa.array([nodes[v] for _, v in found], pa.binary())], schema=schema)

        for batch in batches:
            for t, node, items in zip(*(batch.column(x).to_pylist() for x in ("task", "node", "items"))):
                if t != task:
                    if len(held) > 1:
                        yield links()
                    task, held = t, {}
                held[node] = items
        if len(held) > 1:
            yield links()

    return run


def _verified(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """buckets(key, node): candidates of each table; sets(node, items) to links(a, b) that connect all that are linked within
    a bucket."""
    links = None
    for turn in range(STARS):
        placed = buckets
        if links is not None:
            roots = components(links)
            placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
            placed = cut(placed.join(apart, "key"))
            if not placed.limit(1).count():
                return links
        else:
            placed = placed.withColumn("root", F.col("node"))
        # the first hub is the least of all nodes, so that few pairs are asked for; later ones differ from table to table
        order = F.col("node") if not turn else F.sha1(F.concat("node", F.col("key").cast("string").cast("binary")))
        hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("turn"), F.col("node").alias("hub"), F.col("root").alias("hub_root"))).alias("h")).select("key", "h.hub", "h.hub_root")
        asked = placed.join(hubs, "key").where("node <> hub")
        pairs = asked.where("root <> hub_root").select("node", "hub").distinct()
        both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("items").alias("hub_items")), "hub")
        found = cut(both.mapInArrow(_links(percent), struct(a="binary", b="binary")))
        links = found if links is None else cut(links.unionByName(found))
        buckets = cut(asked.select("key", "node"))
    roots = components(links)
    placed = cut(buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    apart = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("hub")).where("low <> high").select("key", "hub")
    groups = cut(components(placed.join(apart, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()))
    if not groups.limit(1).count():
        return links
    sized = groups.join(groups.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "root").join(sets, "node")
    own = F.pmod(F.crc32("node"), F.col("blocks")).cast("int")
    tasks = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.concat("root", F.concat_ws(",", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).cast("binary"))
    tasks = tasks.select(task.alias("task"), "node", "items")
    return links.unionByName(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_confirm(percent), struct(a="binary", b="binary")))


def grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """docs(doc_id, text) to (doc_id, mark, n_shingles, node, root, component): mark is a hash of the text, node the 128-bit
    identity of the shingle set, root that of its component, component the least doc_id of that.  A row for each of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("mark"))
    signed = cut(docs.mapInArrow(_sign(shingle), struct(doc_id="bigint", mark="bigint", n_shingles="bigint", node="binary", bands="array<bigint>")))
    own = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("row"), F.any_value("bands").alias("bands"))
    own = cut(own)
    bands = own.select("node", F.posexplode("bands").alias("slot", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = bands.join(shared, "band").groupBy("node").agg(F.collect_list(F.struct("slot", "band")).alias("shared"))
    keys = cut(shared.mapInArrow(_tables, struct(key="bigint", node="binary")))
    several = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    buckets = cut(keys.join(several, "key"))
    asked = own.join(buckets.select("node").distinct(), "node").select(F.col("row.doc_id").alias("of"), F.col("row.mark").alias("as"), "node")
    texts = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as"))).dropDuplicates(["node"])
    sets = cut(texts.select("node", "text").mapInArrow(_sets(shingle), struct(node="binary", items="binary")))
    found = components(_verified(buckets, sets, percent))
    named = found.join(own.select("node", "least"), "node")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "root", "component")
    whole = own.select("node", "least").join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component", "least").alias("component"))
    whole = cut(whole)  # so that the join below stands between plain exchanges, and AQE can split a set with many copies
    return signed.select("doc_id", "mark", "n_shingles", "node").join(whole, "node", "left")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_shingles, component_id, kept, node), a row for each row of docs.  node is the
    128-bit identity of the shingle set, null where that is empty."""
    out = grouped(docs, shingle, percent).withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """The rows of docs that stay, with docs' columns, whatever their names: of each component one row, that with the least
    doc_id, null last, and of those the one with the least hash of its text; rows without words all stay.  Rows that share a
    doc_id but not their text are documents of their own."""
    own, names = positional(docs)
    columns, doc_id, text = own.columns, F.col(names["doc_id"]), F.col(names["text"])
    marked = cut(grouped(own.select(doc_id.alias("doc_id"), text.alias("text")), shingle, percent).select("doc_id", "mark", "root"))
    first = marked.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("row"))
    first = first.select(F.col("row.doc_id").alias("of"), F.col("row.mark").alias("as")).alias("f")
    alike = marked.where("root is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).alias("m")
    first = first.join(alike, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("as") == F.col("mark"))).select("of", "as", "n")
    none = marked.where("root is null").select(F.col("doc_id").alias("of"), F.col("mark").alias("as")).distinct().withColumn("n", F.lit(1).cast("long"))
    stay = cut(first.unionByName(none))
    hit = own.withColumns({"id": doc_id.cast("long"), "mark": F.xxhash64(text)}).join(stay, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")))
    out = hit.where("n = 1").unionByName(hit.where("n > 1").dropDuplicates(["id", "mark"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(columns, docs.columns)))
