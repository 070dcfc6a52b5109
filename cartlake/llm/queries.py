"""Registered queries of this subpackage: each operator over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.llm import (
    bilinear, bpe, graph_index, licences, line_filters, mixing, pii, quality, sharding, simhash, simplex_clusters, toxicity, treap_search)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The key of the registered query and the pipeline; a real run passes a secret of its own.
PSEUDONYM_KEY = b"registered-query"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_registered
def op1_graph_neighbours(spark, folder):
    return graph_index.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_registered
def op2_feistel_pseudonyms(spark, folder):
    found = pii.masked(_table(spark, folder, "documents"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii_spans").alias("n_values"), "pii_spans")


@_registered
def op3_source_mix(spark, folder):
    return mixing.mixed(_table(spark, folder, "documents")).taken


@_registered
def op4_bilinear_scores(spark, folder):
    return bilinear.scored(_table(spark, folder, "documents"))


@_registered
def op5_line_frequency(spark, folder):
    return quality.judged(_table(spark, folder, "documents"))


@_registered
def op6_bounded_ring(spark, folder):
    return sharding.sharded(_table(spark, folder, "documents"))


@_registered
def op7_toxicity(spark, folder):
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_registered
def op8_bpe_tokens(spark, folder):
    return bpe.digests(_table(spark, folder, "documents"), vocabulary_path())


@_registered
def op9_simhash_near_duplicates(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"), shingle=3, limit=3)


@_registered
def op10_licence_digests(spark, folder):
    return licences.licence_scan(_table(spark, folder, "documents"), licences.known_licences(spark))


@_registered
def op11_treap_search(spark, folder):
    return treap_search.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_registered
def op12_bloom_line_dedup(spark, folder):
    return line_filters.digests(_table(spark, folder, "documents"))


@_registered
def op13_simplex_clusters(spark, folder):
    return simplex_clusters.clustered(_table(spark, folder, "embeddings"))


ORACLES["op5_line_frequency"] = quality.ORACLE
ORACLES["op10_licence_digests"] = licences.ORACLE
ORACLES["op11_treap_search"] = treap_search.ORACLE
ORACLES["op12_bloom_line_dedup"] = line_filters.ORACLE
ORACLES["op13_simplex_clusters"] = simplex_clusters.ORACLE
