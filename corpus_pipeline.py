"""The corpus pipeline: quality classifier, n-gram Jaccard join, PII, source mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; run() writes each
stage's rows as Parquet into the shared folder and hands the reread table to the next.

In every stage a null text counts as empty, ids may be null or repeated, an empty table gives an empty one, and extra
columns pass through whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webweft.llm import bpe, ngram_join, pii, quality, source_mix
from webweft.llm.common import in_small_batches, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score >= 0.3).  Without positive labels all are; an empty text is judged as
    a text without words; repeated rows fare alike."""
    return quality.accepted(in_small_batches(docs), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: five-word shingles, Jaccard 0.8 or more.  The smallest doc_id stays; rows
    without words or without an id stay; of rows that share id and words one stays."""
    return ngram_join.deduplicated(in_small_batches(docs), k=5, num=80, den=100)


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by format-preserving pseudonyms; n_chars set anew.  The key is the session's
    spark.webweft.pii.key (a public one where unset).  Null texts stay null."""
    return pii.pseudonymised(docs, pii.job_key(spark))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target proportions: a document comes once per pass that takes words of it.  Texts without words
    are never taken; repeated rows count as separate documents; a null source is one, the last."""
    return source_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the token ids and the text decoded from them (ids, decoded; with underscores behind
    them where documents has columns so named)."""
    return bpe.encode(in_small_batches(docs))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("pii", pseudonymised),
    ("source mix", mixed),
    ("bpe", encoded),
]

#: Training by gradient steps and merges by rank are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "_"))
    return docs
