"""The ten operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm.scratch import table

PII_KEY = "vectorloom-demo-key"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.urlfilter import HOST_PATH_RULES, PATTERN_RULES, url_filter

    return url_filter(table(spark, sf_dir, "pages"), HOST_PATH_RULES + PATTERN_RULES)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.chat import format_chats, read_back

    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("msg"), "role", "text")
    back = read_back(format_chats(events))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.mixing import plan

    out = plan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.pii import surrogates

    out = surrogates(table(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "n_entities", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["kind"]))), ",").alias("kinds"), "text")


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_url_filter, op4_chat_format, op5_mix, op6_quality, op10_pii_surrogates)}
ORACLE: dict[str, str] = {}


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.bpe import encode

    out = encode(table(spark, sf_dir, "documents"), decode=True, packed=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.suffix import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("partner_id")


QUERIES |= {f.__name__: f for f in (op3_bpe, op7_repeated_passages)}


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole text of every document whose id is divisible by 20, against all documents."""
    from vectorloom.llm.bm25 import search

    docs = table(spark, sf_dir, "documents")
    found = search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"))
    return found.withColumn("score", F.round("score", 6))


QUERIES[op8_bm25_topk.__name__] = op8_bm25_topk


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vectorloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES[op9_toxicity.__name__] = op9_toxicity


# ---- the same in DuckDB's SQL, where SQL can express it

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op1_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

_HOST = "CASE WHEN instr(url, '://') > 0 THEN " + FOLD.format("regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')") + " ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
ORACLE["op2_url_filter"] = f"""
WITH u AS (SELECT page_id, url, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT DISTINCT url, arg_max(h || p, length(h || p)) OVER (PARTITION BY url) AS rule, arg_max(action, length(h || p)) OVER (PARTITION BY url) AS action
      FROM (SELECT DISTINCT url, host, path FROM u), rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN regexp_matches({FOLD.format("u.url")}, '(^|[^a-z0-9])(spam-farm|cheap-pills|ads-track|adult-x|casino|porn|warez|phishing)($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON f.url = u.url
"""

_MARK = "length({0}) + 4 * (length({0}) - length(replace({0}, '&', ''))) + 3 * (length({0}) - length(replace({0}, '<', '')))"
ORACLE["op4_chat_format"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(21 + {_MARK.format("role")} + {_MARK.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLE["op5_mix"] = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
k AS (SELECT *, CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) % 8 END AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS most FROM s),
o AS (SELECT *, most / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(most) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS free, sum(source_size) OVER () AS total
      FROM o WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - capped)::DOUBLE / free::DOUBLE AS level FROM c),
z AS (SELECT ratio AS r0, level AS l0 FROM v WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio >= r0 THEN weight * l0 ELSE most END::DOUBLE AS target FROM v, z),
p AS (SELECT k.doc_id, k.source, size, source_size, target, row_number() OVER (PARTITION BY k.source ORDER BY class, key, k.doc_id, size) AS place,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each, ('0x' || substr(md5('mix:' || coalesce(k.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size > 0 THEN (floor(place * each + start) - floor((place - 1) * each + start))::BIGINT ELSE 0 END AS copies FROM p)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n
"""

ORACLE["op7_repeated_passages"] = f"""
WITH d AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS k, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, k, md5(array_to_string(w[k + 1:k + 50], ' ')) AS h FROM x),
r AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT DISTINCT doc_id, k FROM h JOIN r USING (h)),
g AS (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= 50 THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM g)
SELECT doc_id, min(k) AS start_word, max(k) + 50 AS end_word, max(k) + 50 - min(k) AS n_words FROM i GROUP BY doc_id, span
"""

ORACLE["op8_bm25_topk"] = f"""
WITH d AS (SELECT doc_id, {WORDS.format(FOLD.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, g GROUP BY term, n),
i AS (SELECT t.doc_id, term, idf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len(w) / mean)) AS impact FROM t JOIN f USING (term) JOIN d USING (doc_id), g),
s AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(i.idf * impact), 9) AS score FROM t q JOIN i USING (term) WHERE q.doc_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s QUALIFY rank <= 10
"""
