"""Changing parts of a sliced table: only the slices that a change touches are written again.

A slice is a folder ``<slice column>=<year>``. Spark writes the new files of all touched slices beside the
table and puts them in place at the end (dynamic partition overwrite), so the rows may come from the
table itself, and files of other slices stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.operators.staging import staged
from cartlake.sinks.export import time_slices

SLICE = "slice_year"
#: How a folder names a missing value (fixed by the storage format).
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def read_slices(spark: SparkSession, path: str, schema: T.StructType, slices: Iterable[int | None] | None = None,
                slice_column: str = SLICE) -> DataFrame:
    """Rows with their slice, of all or of the given slices; no footer is read, and no other folder opened."""
    rows = spark.read.schema(T.StructType([*schema, T.StructField(slice_column, T.IntegerType())])).parquet(path)
    return rows if slices is None else rows.where(in_slices(F.col(slice_column), slices))


def in_slices(column: Column, slices: Iterable[int | None]) -> Column:
    """Whether a slice is among these; None stands for rows without a date."""
    known = [s for s in slices if s is not None]
    found = column.isin(known) if known else F.lit(False)
    return found | column.isNull() if None in slices else found


def slices_of(df: DataFrame, slice_column: str) -> list[int | None]:
    """The distinct slices of some rows: years, so a short list at any number of rows."""
    return [r[0] for r in df.select(slice_column).distinct().collect()]


def replace_slices(df: DataFrame, path: str, date_column: str, slice_column: str = SLICE) -> None:
    """Put the rows of ``df`` in place of all rows of the slices that occur in it; other slices are not touched."""
    (time_slices(df, date_column, slice_column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(slice_column).parquet(path))


def remove_slices(spark: SparkSession, path: str, slices: Iterable[int | None], slice_column: str = SLICE) -> None:
    """Delete whole slices without reading them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for s in slices:
        folder = hadoop(f"{path}/{slice_column}={NO_VALUE if s is None else s}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def rewrite_period(df: DataFrame, path: str, date_column: str, since: date, until: date, schema: T.StructType,
                   slice_column: str = SLICE) -> None:
    """Put the rows of ``df`` in place of those with ``since`` <= date < ``until``.

    Slices that lie partly in the period keep their other rows. Rows of ``df`` outside of it are refused.
    """
    spark = df.sparkSession
    inside = (F.col(date_column) >= F.lit(since)) & (F.col(date_column) < F.lit(until))
    new = staged(df, "period")
    if new.where(~F.coalesce(inside, F.lit(False))).limit(1).count():
        raise ValueError(f"rows outside of {since} to {until}")
    years = range(since.year, until.year + (until.month > 1 or until.day > 1))
    stored = read_slices(spark, path, schema, years, slice_column)
    _replace(spark, path, stored.where(~inside).drop(slice_column).unionByName(new), years, date_column, slice_column)


def upsert(changes: DataFrame, path: str, key: str, date_column: str, schema: T.StructType,
           deleted: DataFrame | None = None, slice_column: str = SLICE) -> list[int | None]:
    """Put rows in place of those with the same key, wherever these are, add new ones, and remove ``deleted`` keys.

    A row whose date moved to another year leaves its old slice. To find the slices that hold a key, one
    column of the table is read; rows are read and written of touched slices only. Of several changes of
    one key all are stored; stored rows with a NULL key are never matched. Returns the touched slices.
    """
    spark = changes.sparkSession
    new = staged(changes.select(*schema.names), "changes")
    keys = new.select(key)
    if deleted is not None:
        keys = keys.unionByName(deleted.select(key))
    keys = staged(keys.where(F.col(key).isNotNull()).distinct(), "changed-keys")
    holding = read_slices(spark, path, schema, slice_column=slice_column).select(key, slice_column).join(
        keys, key, "left_semi")
    touched = sorted({*slices_of(holding, slice_column), *slices_of(new.select(F.year(date_column).alias(slice_column)), slice_column)},
                     key=lambda s: (s is None, s))
    kept = read_slices(spark, path, schema, touched, slice_column).drop(slice_column).join(keys, key, "left_anti")
    _replace(spark, path, kept.select(*schema.names).unionByName(new), touched, date_column, slice_column)
    return touched


def _replace(spark: SparkSession, path: str, rows: DataFrame, touched: Iterable[int | None], date_column: str,
             slice_column: str) -> None:
    """Write touched slices again; those that lost all rows are removed, which writing alone would not do."""
    rows = staged(rows, "slices")
    left = set(slices_of(rows.select(F.year(date_column).alias(slice_column)), slice_column))
    replace_slices(rows, path, date_column, slice_column)
    remove_slices(spark, path, [s for s in touched if s not in left], slice_column)
