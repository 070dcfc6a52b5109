"""Join shapes that keep their result exact and do not depend on unique keys or even data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only_keys_of(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` occurs in ``keys``; never multiplies rows."""
    return df.join(keys.select(on), on, "left_semi")


def attach_to_totals(totals: DataFrame, attributes: DataFrame, on: str, sums: list[str]) -> DataFrame:
    """Inner join per-key totals with descriptive columns and regroup by all of them.

    Aggregating the fact side first means a hot key is one row when it reaches the
    join. Should ``attributes`` repeat a key, each copy contributes the totals, as
    a join of the unaggregated rows would. The regrouping needs no further shuffle:
    rows are already partitioned by a subset of the grouping columns.
    """
    labels = [c for c in attributes.columns if c != on]
    keys = [c for c in totals.columns if c not in sums]
    joined = totals.join(attributes, on)
    return joined.groupBy(*keys, *labels).agg(*[F.sum(c).alias(c) for c in sums])


def left_join_totals(df: DataFrame, fact: DataFrame, on: str, *aggregates: Column) -> DataFrame:
    """Left join ``df`` with aggregates of ``fact`` per ``on``; unmatched rows get NULLs.

    A plain left join cannot be split when the fact side is skewed. Partial
    aggregation reduces every key to one row before the shuffle instead.
    """
    return df.join(fact.groupBy(on).agg(*aggregates), on, "left")


def null_safe_left_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left join in which a NULL key matches a NULL key (for joining grouped results)."""
    renamed = right.withColumnRenamed(on, "_key")
    return left.join(renamed, left[on].eqNullSafe(renamed["_key"]), "left").drop("_key")
