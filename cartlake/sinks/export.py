"""Exports: Parquet, CSV, time slices, text files, records and batches."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.functions.expressions import CSV_NULL, escape_lines, text_file_name


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def export_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV files with a header each; quotes inside values are doubled.

    Line breaks and backslashes in texts are written as ``\\n``, ``\\r`` and ``\\\\``, so that a line is
    a row and files stay splittable; NULL is ``\\N``, which no text can be. ``scan_csv`` undoes this.
    """
    escaped = [escape_lines(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else F.col(f.name)
               for f in df.schema]
    (df.select(escaped).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("nullValue", CSV_NULL).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def time_slices(df: DataFrame, date_column: str, slice_column: str = "slice_year") -> DataFrame:
    """Add the year of ``date_column`` and gather each year in few partitions of sound size.

    Rebalancing splits a year that holds most rows over several tasks.
    """
    return df.withColumn(slice_column, F.year(date_column)).hint("rebalance", F.col(slice_column))


def write_time_slices(df: DataFrame, path: str, date_column: str, slice_column: str = "slice_year") -> None:
    """One folder per year of ``date_column``."""
    time_slices(df, date_column, slice_column).write.partitionBy(slice_column).parquet(path)


def read_time_slices(spark: SparkSession, path: str, date_column: str, since: datetime.date,
                     slice_column: str = "slice_year", schema: T.StructType | None = None) -> DataFrame:
    """Rows from ``since`` on; only the folders that can hold them are read.

    Columns that were added later are NULL in older slices. The given schema (with the slice
    column) saves reading the footers of all files.
    """
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    return reader.parquet(path).where(
        (F.col(slice_column) >= since.year) & (F.col(date_column) >= F.lit(since))
    ).drop(slice_column)


def named_texts(df: DataFrame, name: Column, content: Column, now: datetime.datetime, *order: str) -> DataFrame:
    """Resolve the file name of every text: time-stamped where missing, with the text suffix.

    The ``order`` columns, which say what was written last, are kept.
    """
    return df.select(text_file_name(name, now).alias("filename"), content.alias("value"), *order)


def last_write_wins(df: DataFrame, *order: str) -> DataFrame:
    """One content per file name, that of the greatest ``order``: writing a name again replaces its text.

    The order must be unique per name; of equal ones the greater text counts, so that reruns agree.
    """
    return df.groupBy("filename").agg(F.max_by("value", F.struct(*order, "value")).alias("value"))


def export_texts(texts: DataFrame, path: str) -> None:
    """Write one text per name, as one file below ``<path>/filename=<name>/``.

    ``texts`` has one row per name (see ``last_write_wins``); a file is one record, whatever its length.
    """
    texts.select("filename", "value").write.partitionBy("filename").text(path)


def to_records(df: DataFrame) -> DataFrame:
    """One JSON object per row, NULLs included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def fetch_batches(df: DataFrame, size: int = 1000) -> Iterator[list[Row]]:
    """Rows in lists of at most ``size``; the driver holds two partitions at a time, not the result."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while batch := list(islice(rows, size)):
        yield batch
