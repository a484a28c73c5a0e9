"""Mixing sources to target weights by systematic sampling, native.

Targets: sources in code point order (null last) weigh 5, 2, 1 and so on, and share all words by weight; no target exceeds
3 times its source's words, and what goes beyond is shared among the others by weight until none is above.  That ends at
min(3 * source_size, weight * level) with one level for all, found from sums over the sources in order of 3 * size / weight.

Sampling: all documents of a source expect target / source_size copies.  Along the source's documents in order of size class
(8 classes per doubling) and then of md5(doc_id), expected copies are prefix-summed from one random offset, seeded by the
source's name, and a document is emitted once for each integer passed.  So a document has its expected copies on average, and
size order makes the words taken follow the target closely; a source of a few documents may be off by about its largest.
Positions come from counts at three levels (size class, slice of the key, row within the slice), so no task orders a whole
source.  The key is md5(doc_id) followed by a hash of the text, so rows that share a doc_id, or have none, spread over slices;
a slice is as many of the key's first digits as leave about SLICE rows of the largest class in each.

Defined results: a null or word-free text has size 0 and takes 0 words; a source without words has target 0; a null source is
a source, the last; a null doc_id is a doc_id of its own; repeated rows are documents of their own, with the same multiset of
results at each run; an empty table gives an empty result.  Extra columns are ignored by `plan` and kept by `mix`, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.llm.scratch import cut, positional

WEIGHTS = (5, 2, 1)
CAP = 3
SLICE = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(size, length(bin(size)) - 4)") % 8).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size): a row for each source.  Adds target."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    own = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("most", F.col("source_size") * cap)
    own = own.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("capped", F.coalesce(F.sum("most").over(by_ratio), F.lit(0)))
    own = own.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    own = own.withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("left"))
    # the first source at whose turn the level is no higher than its own ratio: it and all after it stay below their caps
    own = own.withColumn("settled", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything))
    free = F.col("ratio") >= F.col("settled.ratio")
    return own.select("source", "source_size", F.when(free, F.col("weight") * F.col("settled.level")).otherwise(F.col("most")).cast("double").alias("target"))


def mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def planned(docs: DataFrame, seed: str) -> DataFrame:
    """docs(doc_id, text, source) to (doc_id, mark, source, size, source_size, target, copies), a row for each row of docs."""
    sized = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), words(F.col("text")).alias("size"), mark(F.col("text")).alias("mark"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark").cast("binary"))
    sized = cut(sized.withColumn("key", key).withColumn("class", size_class(F.col("size"))))
    counted = cut(sized.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    digits, most = 1, counted.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > SLICE * 16**digits:
        digits += 1
    sized = sized.withColumn("slice", F.substring("key", 1, digits))
    groups = ["source", "class", "slice"]
    before = lambda own, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*own).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    aims = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")))
    classes = counted.withColumn("classes_before", before(["source"], "class")).drop("n", "words").alias("c")
    slices = sized.groupBy(*groups).agg(F.count("*").alias("n")).withColumn("slices_before", before(["source", "class"], "slice")).drop("n").alias("s")
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    offsets = slices.join(classes, same("s", "c", ["source", "class"])).join(aims.alias("t"), same("s", "t", ["source"]))
    offsets = offsets.select("s.source", "s.class", "s.slice", (F.col("classes_before") + F.col("slices_before")).alias("before"), "source_size", "target")
    row = F.row_number().over(Window.partitionBy(*groups).orderBy("key", "doc_id", "size"))
    placed = sized.withColumn("row", row).alias("d").join(offsets.alias("o"), same("d", "o", groups))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d.source"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    passed = lambda k: F.floor(k * each + start)
    place = F.col("before") + F.col("row")
    copies = F.when(F.col("size") > 0, passed(place) - passed(place - 1)).otherwise(0).cast("long")
    return placed.select("d.doc_id", "mark", "d.source", "size", "source_size", "target", copies.alias("copies"))


def plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source, ...) to (doc_id, source, size, source_size, target, copies), a row for each row of docs."""
    return planned(docs, seed).drop("mark")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with docs' columns.  Rows without words are taken never.  Rows
    alike in doc_id, text and source share their copies evenly, and one of them has what is left over."""
    own, names = positional(docs)
    columns, text = own.columns, F.col(names["text"])
    own = own.withColumns({"id": F.col(names["doc_id"]), "source": F.col(names["source"]), "mark": mark(text)})
    taken = planned(own.select(F.col("id").alias("doc_id"), text.alias("text"), "source"), seed).where("size > 0")
    twins = taken.groupBy(F.col("doc_id").alias("id"), "source", "mark").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    keys = ["id", "source", "mark"]
    hit = own.alias("a").join(twins.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]).select("a.*", "copies", "n")
    shared = hit.withColumn("copies", F.expr("copies div n"))
    rest = hit.where("copies % n > 0").dropDuplicates(keys).withColumn("copies", F.expr("copies % n"))
    out = shared.where("copies > 0").unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(n).alias(c) for n, c in zip(columns, docs.columns)))
