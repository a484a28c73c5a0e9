"""From documents to token ids in five stages, each an operator over all rows that the one before has kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again.  All but
the last return the columns of documents, in order, and any more that docs has, whatever their names.

Defined results: null, empty and word-free texts fail the base rules and go in the first stage.  A null lang or source is one
of its own.  Rows that share a doc_id, or have none, are judged by their own texts: near copies among them go like others,
and what differs stays.  Of equal rows one stays, as of any near copies, and the mix may take it more than once.  Very long
texts go through whole.  An empty table of documents, or one of which nothing is kept, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import bpe, minhash, mixing, pii, quality
from vectorloom.llm.queries import PII_KEY
from vectorloom.llm.scratch import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, five words a shingle and a similarity of 0.8 or more, the document with the least id
    stays."""
    return minhash.keep_one(docs, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is replaced by surrogates."""
    return pii.replace(docs, PII_KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return bpe.encode(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("token_ids", token_ids)]

#: Certified cutoffs, similarity components and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
