"""A training corpus from raw documents: quality, exact and near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and any more that the table has. Rows may have
nulls in any column, repeat each other or share ids; an empty table goes through empty. What the stages make of null,
blank and very long texts is said where their operators are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scopewise.llm.bpe import code_column
from scopewise.llm.common import stage
from scopewise.llm.exact_dedup import exact_dedup
from scopewise.llm.mixing import mixed
from scopewise.llm.quality import keep_good
from scopewise.llm.similar_texts import similar_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; so do texts without a word."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that are equal without white space stays: the longest, of those the smallest doc_id, nulls last."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id, nulls last."""
    return similar_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them: not at all, once or twice."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the text that the ids decode to).

    A null text has no tokens; repeated rows give repeated rows.
    """
    return code_column(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokens),
]

#: SQL can't express the first stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
