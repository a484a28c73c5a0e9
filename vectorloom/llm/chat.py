"""Chat formatting from an event log, native.

Events: conv_id, seq, kind, msg, role, text.  Kinds: "message" opens a message, "delta" appends a streamed piece to message
msg, "edit" replaces its text, "regenerate" empties it for the deltas that follow.  Events are grouped by conversation and
message, sorted by (seq, kind, role, text), and folded: a message's text is that of its last opening, edit or regeneration
with all later deltas behind it.  Repeated openings of one msg are turns of their own, in that order.

Template: "<turn role=ROLE>\\nTEXT</turn>\\n" per message.  Text has & and < written as &amp; and &lt;, so no control string
can occur in it; roles have > and line ends written so as well.  Loss spans are code point ranges of assistant text.

Defined results: null text or role is empty; a null seq or msg sorts first; a null conv_id is a conversation; a delta
without an opening starts an empty message of role ""; events of any other kind, or none, are left out, so a conversation of
only such gives no row; repeated events are folded as often as they stand; an empty log gives no conversations.  Extra columns
are ignored.  A conversation is one row of the result, so its events meet in one task; their number isn't limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("message", "delta", "edit", "regenerate")
OPEN, BODY, CLOSE = "<turn role=", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("&#10;"))


def unescape(c: Column) -> Column:
    for a, b in (("&#10;", "\n"), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def fold(events: DataFrame) -> DataFrame:
    """An event log to (conv_id, turns: array of (role, text)), a row for each conversation."""
    item = F.struct(F.col("seq"), F.col("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    events = events.where(F.col("kind").isin(*KINDS))
    log = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(item)).alias("log"))
    opens = F.filter(F.sequence(F.lit(1), F.size("log")), lambda k: (F.element_at("log", k)["kind"] == "message") | (k == 1))
    log = log.withColumn("opens", opens)

    def turn(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get("opens", k + 1), F.size("log") + 1)
        own = F.slice("log", at, after - at)
        last = F.coalesce(F.array_max(F.filter(F.transform(own, lambda e, i: F.when(e["kind"] != "delta", i + 1)), lambda x: x.isNotNull())), F.lit(1))
        texts = F.transform(F.slice(own, last, F.size(own) - last + 1), lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"]))
        return F.struct(F.when(F.element_at(own, 1)["kind"] == "message", F.element_at(own, 1)["role"]).otherwise("").alias("role"), F.array_join(texts, "").alias("text"))

    said = log.select("conv_id", "msg", F.transform("opens", turn).alias("said"))
    return said.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("msg", "said"))), lambda x: x["said"])).alias("turns"))


def render(conversations: DataFrame) -> DataFrame:
    """Adds formatted and loss_spans (array of (start, end), code points, end exclusive) to conv_id and turns."""
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    out = conversations.withColumn("pieces", pieces)
    out = out.withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    return out.select("conv_id", "turns", "formatted", F.aggregate("pieces", zero, step)["spans"].alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone: conv_id, turns, loss (the unescaped text under the mask)."""
    found = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    body = lambda p: F.substr(p, F.instr(p, BODY) + len(BODY))
    role = lambda p: F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, BODY) - len(OPEN) - 1)
    turns = F.transform(found, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")


def format_chats(events: DataFrame) -> DataFrame:
    """An event log to (conv_id, turns, formatted, loss_spans)."""
    return render(fold(events))
