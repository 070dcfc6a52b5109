"""The corpus pipeline: from raw documents to token ids, one operator of cartlake.llm per stage.

Each stage gets all rows that its predecessor kept, as a table read back from the shared folder, and
gives documents of the same columns; the last one adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.llm import bpe, mixing, pii, simhash, toxicity
from cartlake.llm.queries import PSEUDONYM_KEY, vocabulary_path
from cartlake.operators.staging import staged


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score reaches their language's threshold."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash group."""
    return simhash.representatives(docs, shingle=3, limit=3)


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal values in the texts; every document stays."""
    masked = pii.masked(docs, PSEUDONYM_KEY)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each document's text."""
    return bpe.encoded(docs, vocabulary_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("pseudonyms", with_pseudonyms),
    ("source_mix", mixed_sources),
    ("tokens", token_ids),
]

#: A trained network, bit votes of hashes, a keyed permutation and a tokenizer are not SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
