"""Top-k, best-per-group and previous-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str, k: int, *tie_break: str) -> DataFrame:
    """The ``k`` rows with the greatest ``by``; ties are settled by ``tie_break``.

    Each task keeps k rows and only those meet, so nothing is sorted globally.
    """
    return df.orderBy(F.desc(by), *[F.asc(c) for c in tie_break]).limit(k)


def best_per_group(df: DataFrame, group: str, by: str) -> DataFrame:
    """All rows of each group that share its greatest ``by`` (rank 1, ties kept).

    The filter on the rank makes Spark drop the other rows of every group before
    the shuffle, so a group that holds most of the input does not meet in one task.
    """
    ranked = Window.partitionBy(group).orderBy(F.desc(by))
    return df.withColumn("_rank", F.rank().over(ranked)).where("_rank = 1").drop("_rank")


def with_previous(df: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Add the preceding value of ``order`` within ``group``.

    One group is handled by one task: pass rows that were reduced to a bounded
    number per group before (such as the distinct months of a customer).
    """
    return df.withColumn(name, F.lag(order).over(Window.partitionBy(group).orderBy(order)))
