"""Intermediate results that are used more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cartlake.session import run_dir


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and from then on the
    optimizer knows the true size: a join against the result is broadcast exactly
    when its files are below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled
    otherwise, with no hint that could be wrong for other data.
    """
    spark = df.sparkSession
    path = run_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
