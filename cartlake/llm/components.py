"""Connected components of a link table by alternating large-star and small-star steps.

Only pairs (a, b) with a > b travel between executors; no component is ever gathered in one
task. Each round is written to the shared folder, which cuts the lineage. A hub with many
links is one row per link, joined to its one smallest neighbour, a join that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.operators.staging import staged


def _starred(links: DataFrame, larger_only: bool) -> DataFrame:
    """One star step.

    Large star: every node's neighbours above it get linked to the smallest node around it.
    Small star: the node and its neighbours below it get linked to the smallest of these.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    if larger_only:
        both = both.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near")))
    least = both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("least"))
    joined = both.join(least, "node")
    if larger_only:
        moved = joined.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("near").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Links to itself, repeated links, links in both directions and links with a NULL end are allowed;
    the latter link nothing.
    """
    current = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    before = _fingerprint(current)
    while before[0]:
        current = staged(_starred(_starred(current, larger_only=True), larger_only=False), "links")
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
