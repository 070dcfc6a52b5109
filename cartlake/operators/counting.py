"""Distinct counts under several conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, group: str, value: str, **conditions: Column) -> DataFrame:
    """Per ``group`` and condition, the number of distinct non-NULL values with a row that meets it.

    Rows are reduced to one per (group, value) with a flag for each condition; several
    distinct aggregates over the rows themselves would multiply these instead.
    """
    flags = [F.max(F.coalesce(met, F.lit(False))).alias(name) for name, met in conditions.items()]
    pairs = df.groupBy(group, value).agg(*flags)
    return pairs.groupBy(group).agg(*[
        F.count_if(F.col(name) & F.col(value).isNotNull()).alias(name) for name in conditions])
