"""Tokens, embeddings, retrieval and scanners over `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import text as X
from vectorloom.functions import vectors as V
from vectorloom.operators import search
from vectorloom.plans.registry import query, table

TERMS = {"the": "le", "and the": "et le", "th": "z", "(c)": "copyright"}
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
PART = "('0x' || substr(md5(w), {}, 8))::BIGINT"
#: 2**32 is a multiple of the 64 dimensions, so the digest modulo 64 is its last part modulo 64.
BUCKET = PART.format(25) + " % 64"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("tokenize", f"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents) SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS digest FROM t")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).select("doc_id", X.tokens(F.col("text")).alias("w"))
    return own.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


EMBED = (
    f"WITH w AS (SELECT doc_id, unnest({TOKENS}) AS w FROM documents), c AS (SELECT doc_id, {BUCKET} AS b, count(*)::DOUBLE AS n FROM w GROUP BY 1, 2), "
    "h AS (SELECT doc_id, len(" + TOKENS + ")::DOUBLE AS n0, ((length(text) - length(replace(text, 'the', ''))) // 3 + (length(text) - length(replace(text, 'and', ''))) // 3 + (length(text) - length(replace(text, 'is', ''))) // 2)::DOUBLE AS n1, (length(text) - length(replace(text, '?', '')))::DOUBLE AS n2, (length(text) - length(replace(text, '.', '')))::DOUBLE AS n3 FROM documents), "
    "u AS (SELECT doc_id, b, n FROM c WHERE b > 3 UNION ALL SELECT doc_id, 0, n0 FROM h UNION ALL SELECT doc_id, 1, n1 FROM h UNION ALL SELECT doc_id, 2, n2 FROM h UNION ALL SELECT doc_id, 3, n3 FROM h), "
    "x AS (SELECT doc_id, b, n / nullif(sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 0) AS x FROM u)"
)


@query("doc_embed_hash", EMBED + " SELECT doc_id, (b + 1)::INT AS dim, round(coalesce(x, 0), 6) AS value FROM x WHERE coalesce(x, 0) <> 0")
def doc_embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.hash_embedding(docs(spark, sf_dir), 64)
    out = own.select("doc_id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0")
    return out.select("doc_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("value"))


@query("doc_lengths", r"SELECT doc_id, length(text)::INT AS content_length, len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+'))::INT AS word_count FROM documents")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.length("text").alias("content_length"), F.regexp_count("text", F.lit(r"[^ \t\n\r\x0B\x0C]+")).alias("word_count"))


@query("topn_docs", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def topn_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(10)


FOUND = EMBED + ", s AS (SELECT a.doc_id, sum(a.x * q.x) AS score FROM x a JOIN (SELECT b, x FROM x WHERE doc_id = 0) q USING (b) GROUP BY 1), f AS (SELECT s.doc_id, score FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE d.lang = 'en'), k AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 5)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five English documents most like document 0."""
    from pyspark.sql import Window

    d = docs(spark, sf_dir)
    q = search.one_vector(X.hash_embedding(d.where("doc_id = 0"), 64), 0, "doc_id")
    rows = search.with_query(X.hash_embedding(d.where("lang = 'en'"), 64), q).withColumn("score", V.dot(F.col("embedding"), F.col("q")))
    best = rows.select("doc_id", "score").orderBy(F.desc(F.round("score", 9)), "doc_id").limit(5)
    best = d.select("doc_id", "text").join(F.broadcast(best), "doc_id")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "doc_id")))


@query("rag_search", FOUND + " SELECT doc_id, round(score, 6) AS score, rank FROM k")
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query("rag_join_docs", FOUND + " SELECT k.doc_id, rank, d.lang, d.source, left(d.text, 40) AS title FROM k JOIN documents d USING (doc_id)")
def rag_join_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).select("doc_id", "rank")
    return docs(spark, sf_dir).join(F.broadcast(hits), "doc_id").select("doc_id", "rank", "lang", "source", F.substring("text", 1, 40).alias("title"))


@query("rag_answer", FOUND + ", p AS (SELECT rank, list_filter(list_transform(string_split(d.text, '.')[1:2], lambda s: trim(s, ' ')), lambda s: length(s) > 10) AS s FROM k JOIN documents d USING (doc_id) WHERE rank <= 3) SELECT 'Based on the retrieved documents: ' || array_to_string(flatten(list(s ORDER BY rank))[1:3], '. ') || '.' AS answer FROM p")
def rag_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("texts"))
    return hits.select(X.answer(F.col("texts")).alias("answer"))


def _sql_rule(severity: str, rule: str, regex: str) -> str:
    quoted = regex.replace("'", "''")
    return f"SELECT doc_id, line, '{severity}' AS severity, '{rule}' AS rule, left(unnest(regexp_extract_all(content, '{quoted}')), 100) AS match FROM l"


SCAN = "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, unnest(p) AS content, unnest(range(1, len(p) + 1))::INT AS line FROM s), m AS (" + " UNION ALL ".join(_sql_rule(s, r, x) for s, rules in X.SECRETS.items() for r, x in rules.items()) + ")"


@query("secret_scan", SCAN + " SELECT * FROM m")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.secret_scan(docs(spark, sf_dir))


@query("scan_summary", SCAN + ", c AS (SELECT count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings FROM m) SELECT (SELECT count(*) FROM documents) AS scanned, issues, critical, warnings, CASE WHEN critical > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM c")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all matches of the whole set of rules."""
    return X.scan_summary(docs(spark, sf_dir))


@query("path_check", "SELECT page_id FROM pages WHERE regexp_matches(url, '\\.html?($|[?#])')")
def path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"\.html?($|[?#])")).select("page_id")


def _hits(patterns: tuple[str, ...], column: str = "text") -> str:
    return "(" + " + ".join("regexp_matches({}, '(?i){}')::INT".format(column, p.replace("'", "''")) for p in patterns) + ")"


@query("urgency_score", f"WITH x AS (SELECT doc_id, {_hits(X.URGENCY)} AS h FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' Act now, hurry' ELSE '' END AS text FROM documents)) SELECT doc_id, CASE WHEN h >= 2 THEN least(1.0, h / 8 * 2) ELSE 0.0 END::DOUBLE AS score FROM x")
def urgency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth text gets an urgent ending, as the tables have none."""
    own = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Act now, hurry").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", X.urgency(own).alias("score"))


CONTRA = f"WITH x AS (SELECT conv_id, turn, {_hits(X.DENIAL)} > 0 AND {_hits(X.OFFER)} > 0 AS hit FROM (SELECT conv_id, turn, text || CASE WHEN conv_id % 5 = 0 THEN ' We are not liable, but offer a payment' ELSE '' END AS text FROM conversations))"


def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("text", F.when(F.col("conv_id") % 5 == 0, " We are not liable, but offer a payment").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.contradiction(own).alias("c")).select("conv_id", "turn", "c.*")


@query("contradiction", CONTRA + " SELECT conv_id, turn, CASE WHEN hit THEN 0.94 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN hit THEN 0.8 ELSE 0.0 END::DOUBLE AS severity FROM x")
def contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contradictions(spark, sf_dir)


@query("content_score", f"WITH x AS (SELECT doc_id, {_hits(X.URGENCY)} AS h FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' Act now, hurry, last chance' ELSE '' END AS text FROM documents)), y AS (SELECT doc_id, CASE WHEN h >= 2 THEN least(1.0, h / 8 * 2) ELSE 0.0 END::DOUBLE AS c FROM x) SELECT doc_id, round(CASE WHEN c >= 0.7 THEN 0.8 - 0.3 * c ELSE 0.8 END, 6)::DOUBLE AS score FROM y")
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Act now, hurry, last chance").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", F.round(X.content_score(own), 6).alias("score"))


@query("rag_context", FOUND + ", p AS (SELECT rank, 'Document ' || rank || ': ' || d.source || chr(10) || left(d.text, 500) || '...' AS t FROM k JOIN documents d USING (doc_id)), s2 AS (SELECT rank, t, sum(length(t)) OVER (ORDER BY rank) AS n FROM p) SELECT string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM s2 WHERE n <= 2000")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    own = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "source", "text"))).alias("h"))
    return own.select(X.context(F.transform("h", lambda h: h["source"]), F.transform("h", lambda h: h["text"])).alias("context"))


@query("behavior_class", "SELECT event_id, CASE WHEN net > 0.1 THEN 'service' WHEN net < -0.1 THEN 'extraction' ELSE 'neutral' END AS class FROM (SELECT event_id, (user_id % 10) / 10 + (user_id % 3) / 10 - (user_id % 7) / 7 AS net FROM events)")
def behavior_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", X.behaviour(u % 10 / 10, u % 7 / 7, u % 3 / 10).alias("class"))


@query("term_rewrite", "SELECT doc_id, md5(" + "".join("regexp_replace(" for _ in TERMS) + "text" + "".join(f", '{p}', '{v}', 'gi')" for p, v in (("and the", "et le"), ("\\(c\\)", "copyright"), ("the", "le"), ("th", "z"))) + ") AS digest FROM documents")
def term_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(X.rewrite(F.col("text"), TERMS).cast("binary")).alias("digest"))


AUDIENCE = "CASE WHEN doc_id % 2 = 0 THEN 'business' WHEN doc_id % 3 = 0 THEN 'Investor' ELSE 'academic' END"


@query("red_flags", f"SELECT doc_id, array_to_string(list_filter(['spiritual', 'sacred', 'consciousness', 'love', 'healing', 'divine'], lambda w: contains(lower(text), w) AND lower(audience) IN ('business', 'investor', 'executive')), ',') AS flags FROM (SELECT doc_id, {AUDIENCE} AS audience, text || CASE WHEN doc_id % 5 = 0 THEN ' a Divine, healing offer' ELSE '' END AS text FROM documents)")
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " a Divine, healing offer").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", F.array_join(X.red_flags(own, F.expr(AUDIENCE)), ",").alias("flags"))


@query("sql_functions", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS dot, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, in SQL."""
    V.register(spark)
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.vec("embedding").alias("v"))
    own = search.with_query(e, e.where("vec_id = 0").select(F.col("v").alias("q")).limit(1))
    return spark.sql("SELECT vec_id, round(vec_dot(v, q), 6) AS dot, round(vec_euclidean(v, q), 6) AS distance FROM {own}", own=own)
