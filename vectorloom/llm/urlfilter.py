"""URL filtering by pattern rules, native.

Every rule has a regular expression and the literal tokens that any match must contain as whole tokens.  A rule is indexed
under the one of its tokens that is rarest among the urls; a url's tokens fetch candidate rules, and only those run their
expression.  A rule without such a token is indexed under the empty token, which every url has.

Rules come as text: "allow example.org/es/" (a host, all its subdomains, and a start of the path) or a pattern, "block
^spam-farm^", in which ^ is a separator (any character but a-z, 0-9 after folding, or an end) and * anything.  Host-path
rules go before patterns; among them the longest wins, then a block, then text order.  Urls that nothing fits are allowed.

Defined results: a null url has an empty host and path and is allowed; one without "://" has an empty host and path as well,
so no host-path rule fits it, but patterns run over the whole url and may block it; repeated rows each get a row;
extra columns are ignored.  At most MAX_RULES rules are taken, which bounds the index that is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_PATH_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
PATTERN_RULES = tuple(f"block ^{x}^" for x in ("spam-farm", "cheap-pills", "ads-track", "adult-x", "casino", "porn", "warez", "phishing"))


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    ranked: bool


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9\x80-\U0010ffff])", r"\\\1", s)


def parse(line: str) -> Rule:
    action, _, text = line.strip().partition(" ")
    if action not in ("allow", "block") or not text:
        raise ValueError(f"not a rule: {line!r}")
    if "^" in text or "*" in text:
        parts = re.split(r"([*^])", text.translate(str.maketrans(UPPER, LOWER)))
        whole = [x for k, x in enumerate(parts) if k % 2 == 0]
        tokens = []
        for k, x in enumerate(whole):
            found = [m for m in re.finditer(r"[a-z0-9]+", x)]
            for m in found:
                left = m.start() > 0 or k > 0 and parts[2 * k - 1] == "^"
                right = m.end() < len(x) or 2 * k + 1 < len(parts) and parts[2 * k + 1] == "^"
                if left and right:
                    tokens.append(m[0])
        regex = "".join({"*": "(?s:.*)", "^": "(?:^|$|[^a-z0-9])"}.get(x, _quoted(x)) for x in parts)
        return Rule(text, action, regex, tuple(dict.fromkeys(tokens)), False)
    host, slash, path = text.partition("/")
    if not slash:
        raise ValueError(f"a rule of host and path needs a slash: {line!r}")
    host = host.translate(str.maketrans(UPPER, LOWER))
    inner = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"{host}/{path}".translate(str.maketrans(UPPER, LOWER)))
    return Rule(f"{host}/{path}", action, f"\\A(?:[^/]*\\.)?{_quoted(f'{host}/{path}')}", tuple(dict.fromkeys(inner)), True)


def fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(there, fold(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")
    return host, F.when(there, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def url_filter(pages: DataFrame, rules: Iterable[str]) -> DataFrame:
    """pages(page_id, url, ...) to (page_id, host, path, rule, verdict), a row for each row of pages."""
    parsed = list(dict.fromkeys(parse(x) for x in rules))
    if len(parsed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    table = spark.createDataFrame([(k, r.text, r.action, r.regex, list(r.tokens) or [""], r.ranked) for k, r in enumerate(parsed)], "id int, rule string, action string, regex string, tokens array<string>, ranked boolean")
    pages = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    urls = pages.where("url is not null").select("url").distinct()
    held = urls.select("url", F.concat(host, path).alias("place"), F.array_distinct(F.concat(F.split(fold(F.col("url")), "[^a-z0-9]+"), F.array(F.lit("")))).alias("own"))
    tokens = table.select("id", F.explode("tokens").alias("token"))
    seen = held.select(F.explode("own").alias("token")).join(F.broadcast(tokens.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = tokens.join(seen, "token", "left").groupBy("id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.length("token"), "token")).alias("token"))
    index = table.drop("tokens").join(rarest, "id")
    asked = held.select("url", "place", F.explode("own").alias("token")).join(F.broadcast(index), "token")
    fits = asked.where(F.when(F.col("ranked"), F.expr("rlike(place, regex)")).otherwise(F.expr(f"rlike(translate(url, '{UPPER}', '{LOWER}'), regex)")))
    order = F.struct("ranked", F.when(F.col("ranked"), F.length("rule")).otherwise(0), F.col("action") == "block", "rule")
    best = fits.groupBy("url").agg(F.max_by(F.struct("rule", "action", "ranked"), order).alias("best"))
    out = pages.join(best, "url", "left").withColumn("host", host).withColumn("path", path)
    return out.select("page_id", "host", "path", F.when(F.col("best.ranked"), F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
