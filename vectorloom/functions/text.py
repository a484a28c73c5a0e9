"""Text expressions: tokens, hashing embeddings, pattern scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word lists and patterns that results depend on, in their given order.
DENIAL = (
    "no liability", "not liable", "denies.*liability", "denies.*responsibility",
    "no fault", "not at fault", "rejects.*claims", "rejects.*responsibility",
)
OFFER = (
    "offer.*payment", "settle.*amount", "compensation",
    "monetary.*settlement", "pay.*damages", "financial.*remedy",
    "settle.*case", "payment.*nok", "settle.*payment",
)
URGENCY = (
    "act now", "limited time", "expires soon", "hurry",
    "don't miss out", "last chance", "urgent", "immediate",
)
SECRETS = {
    "critical": {
        "api_key": r"""(?i)(api[_-]?key|apikey)\s*[=:]\s*["']?[a-zA-Z0-9_-]{20,}""",
        "secret_key": r"""(?i)(secret[_-]?key|secretkey)\s*[=:]\s*["']?[a-zA-Z0-9_-]{20,}""",
        "access_token": r"""(?i)(access[_-]?token|accesstoken)\s*[=:]\s*["']?[a-zA-Z0-9_.-]{20,}""",
        "bearer": r"""(?i)(bearer\s+[a-zA-Z0-9_.-]{20,})""",
        "password": r"""(?i)(password|pwd)\s*[=:]\s*["'][^"']{3,}["']""",
        "mongodb": r"""(?i)mongodb://[^/\s]+:[^@\s]+@""",
        "postgres": r"""(?i)postgres://[^/\s]+:[^@\s]+@""",
        "aws_id": r"""(?i)aws[_-]?access[_-]?key[_-]?id\s*[=:]\s*["']?[A-Z0-9]{20}""",
        "aws_secret": r"""(?i)aws[_-]?secret[_-]?access[_-]?key\s*[=:]\s*["']?[A-Za-z0-9/+=]{40}""",
    },
    "warning": {
        "price": r"""\$[0-9,]+\s*(?:per|/)\s*(?:month|year|user|query)""",
        "project": r"""(?i)project[_-]?(?:aurora|nebula|quantum|genesis)""",
        "team": r"""(?i)team[_-]?(?:alpha|beta|gamma|delta)[_-]?(?:internal|private)""",
    },
}
RED_FLAGS = ("spiritual", "sacred", "consciousness", "love", "healing", "divine")
# end of fixed values
#: A rule of our own for the tables at hand.
SECRETS["critical"]["token"] = 'token = "[0-9a-f]{40}"'


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), 0)


def count_of(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def bucket(word: Column, size: int) -> Column:
    """The md5 as one number, modulo size."""
    digest = F.md5(word.cast("binary"))
    if 2**32 % size == 0:  # only the last part matters
        return (F.conv(F.substring(digest, 25, 8), 16, 10).cast("long") % size).cast("int")
    high, low = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 25))
    mid = [F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (9, 17)]
    out = high % size
    for part in (*mid, low):
        out = (out * (2**32 % size) + part) % size
    return out.cast("int")


def hash_embedding(docs: DataFrame, dimensions: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs(key, text, ...) to (key, embedding), a row for each key: counts of tokens by bucket; places 0 to 3 hold the
    numbers of words, of a few function words, of question marks and of full stops; unit length.  Tokens are counted where
    they are, so a row per key, bucket and task is shuffled."""
    own = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    words = reduce(lambda a, b: a + b, (count_of(F.col("__t"), w) for w in ("the", "and", "is")))
    # a step of its own: what stands beside explode would be computed again for each token
    own = own.select(key, words.alias("__1"), count_of(F.col("__t"), "?").alias("__2"), count_of(F.col("__t"), ".").alias("__3"), tokens(F.col("__t")).alias("__ts"))
    own = own.select(key, "__1", "__2", "__3", F.explode_outer("__ts").alias("__w"))
    own = own.withColumn("__b", F.when(F.col("__w").isNotNull(), bucket(F.col("__w"), dimensions)))
    counts = own.groupBy(key, "__b").agg(F.count("__w").cast("double").alias("__n"), *(F.any_value(f"__{k}").cast("double").alias(f"__{k}") for k in (1, 2, 3)))
    held = F.map_from_entries(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__n"))))
    counts = counts.groupBy(key).agg(held.alias("__m"), F.sum("__n").alias("__0"), *(F.any_value(f"__{k}").alias(f"__{k}") for k in (1, 2, 3)))
    tail = F.transform(F.sequence(F.lit(4), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(0.0)))
    raw = counts.select(key, F.concat(F.array("__0", "__1", "__2", "__3"), tail).alias("__raw"))
    raw = raw.withColumn("__n", F.sqrt(F.aggregate("__raw", F.lit(0.0), lambda s, x: s + x * x)))
    return raw.select(key, F.when(F.col("__n") > 0, F.transform("__raw", lambda x: x / F.col("__n"))).otherwise(F.col("__raw")).alias("embedding"))


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns occur, case aside."""
    return reduce(lambda a, b: a + b, (F.coalesce(text.rlike(f"(?i){p}").cast("int"), F.lit(0)) for p in patterns))


def urgency(text: Column) -> Column:
    n = hits(text, URGENCY)
    return F.when(n >= 2, F.least(F.lit(1.0), n / len(URGENCY) * 2)).otherwise(0.0)


def contradiction(text: Column) -> Column:
    """Struct of confidence and severity where a denial meets an offer."""
    both = (hits(text, DENIAL) > 0) & (hits(text, OFFER) > 0)
    return F.struct(F.when(both, 0.94).otherwise(0.0).alias("confidence"), F.when(both, 0.8).otherwise(0.0).alias("severity"))


def content_score(text: Column) -> Column:
    """0.8, less 0.3 times the severity of a significant urgency: confidence 0.7 or more, severity 0.3 or more."""
    severity = urgency(text)
    return F.when((severity >= 0.7) & (severity >= 0.3), 0.8 - 0.3 * severity).otherwise(0.8)


def behaviour(user: Column, gain: Column, community: Column) -> Column:
    net = user + community - gain
    return F.when(net > 0.1, "service").when(net < -0.1, "extraction").otherwise("neutral")


def rewrite(text: Column, terms: dict[str, str]) -> Column:
    """Terms replaced, the longest first, case aside, one after another."""
    import re

    for term in sorted(terms, key=lambda t: (-len(t), t)):
        text = F.regexp_replace(text, "(?i)" + re.sub(r"([^\w\s])", r"\\\1", term), terms[term].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def red_flags(text: Column, audience: Column) -> Column:
    """Words that texts for readers in business shouldn't have; none for other readers."""
    lower, strict = F.lower(text), F.lower(audience).isin("business", "investor", "executive")
    return F.array_compact(F.array(*(F.when(strict & F.contains(lower, F.lit(w)), F.lit(w)) for w in RED_FLAGS)))


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", cut: int = 100) -> DataFrame:
    """(key, severity, rule, line, match): all matches with their line numbers, cut at 100 characters."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content"))

    def matches(severity: str, rule: str, regex: str) -> Column:
        every = F.regexp_extract_all("content", F.lit(f"({regex})"), 1)
        return F.transform(every, lambda m: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.substring(m, 1, cut).alias("match")))

    found = F.flatten(F.array(*(matches(s, r, x) for s, rules in SECRETS.items() for r, x in rules.items())))
    hint = reduce(lambda a, b: a | b, (F.col("content").rlike(r) for rules in SECRETS.values() for r in rules.values()))
    return lines.where(hint).select(key, (F.col("line") + 1).alias("line"), F.explode(found).alias("f")).select(key, "line", "f.severity", "f.rule", "f.match")


def scan_summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: documents scanned, matches in all and by severity, and what comes of it."""
    of = lambda s: F.count_if(F.col("severity") == s)
    found = secret_scan(docs, key, text).agg(F.count("*").alias("issues"), of("critical").alias("critical"), of("warning").alias("warnings"))
    status = F.when(F.col("critical") > 0, "FAIL").when(F.col("warnings") > 0, "WARNING").otherwise("PASS")
    return docs.agg(F.count("*").alias("scanned")).join(found, how="cross").withColumn("status", status)


def answer(texts: Column) -> Column:
    """From documents, best first: of the first three, the first two sentences if they have over ten characters; the first
    three of those, joined."""
    own = F.flatten(F.transform(F.slice(texts, 1, 3), lambda t: F.filter(F.transform(F.slice(F.split(t, r"\."), 1, 2), lambda s: F.trim(s)), lambda s: F.length(s) > 10)))
    found = F.concat(F.lit("Based on the retrieved documents: "), F.array_join(F.slice(own, 1, 3), ". "), F.lit("."))
    return F.when(F.size(own) > 0, found).otherwise("The retrieved documents don't answer this.")


def context(titles: Column, texts: Column, limit: int = 2000) -> Column:
    """Numbered documents with the first 500 characters of each, as many as fit into limit characters."""
    parts = F.transform(F.arrays_zip(titles.alias("a"), texts.alias("b")), lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), d["a"], F.lit("\n"), F.substring(d["b"], 1, 500), F.lit("...")))
    sizes = F.transform(parts, lambda p, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda s, x: s + F.length(x)))
    fitting = F.filter(F.arrays_zip(parts.alias("p"), sizes.alias("n")), lambda x: x["n"] <= limit)
    return F.array_join(F.transform(fitting, lambda x: x["p"]), "\n\n")


