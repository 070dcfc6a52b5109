"""Table statistics, integrity, sizes, compaction, schema evolution, plans and stored results."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from contextlib import redirect_stdout
from datetime import datetime, timedelta
from functools import reduce
from io import StringIO
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.functions.expressions import STAMP_FORMAT
from cartlake.maintenance.clustering import clustered
from cartlake.schemas import FOREIGN_KEYS, PRIMARY_KEYS, Tables
from cartlake.session import ADVISORY_PARTITION_BYTES, session_with
from cartlake.sources.files import file_inventory


def table_stats(tables: Tables) -> DataFrame:
    """Rows and columns per table. Over Parquet files the count reads footers only."""
    return reduce(DataFrame.unionAll, [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        for name, df in tables.items()
    ])


def refresh_statistics(spark: SparkSession, table: str) -> None:
    """Collect row, size and column statistics for the cost-based optimizer."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


def recorded_statistics(spark: SparkSession, table: str) -> DataFrame:
    """Rows and bytes as the catalog has them after ``refresh_statistics``."""
    line = F.col("data_type")
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Statistics'").select(
        F.regexp_extract(line, r"(\d+) rows", 1).cast("bigint").alias("row_count"),
        F.regexp_extract(line, r"(\d+) bytes", 1).cast("bigint").alias("total_bytes"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Foreign-key values without a parent, with their number of child rows.

    Child rows are counted per value before the join, so a hot value is one row.
    """
    referenced = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    return referenced.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def _key_domain_report(t: Tables, parent: str) -> DataFrame:
    """Violations of one primary key and of all keys that refer to it, from one grouping of all their rows."""
    key = PRIMARY_KEYS[parent]
    children = [(table, column) for table, column, owner in FOREIGN_KEYS if owner == parent]
    sources = [(parent, key), *children]
    rows = reduce(DataFrame.unionAll, [
        getattr(t, table).select(F.col(column).alias("key"), F.lit(role).alias("role"))
        for role, (table, column) in enumerate(sources)])
    per_key = rows.groupBy("key").agg(*[
        F.count_if(F.col("role") == role).alias(f"n{role}") for role in range(len(sources))])
    known = F.col("key").isNotNull()
    checks = [
        (f"{parent}.{key} unique", F.count_if(known & (F.col("n0") > 1))),
        (f"{parent}.{key} not null", F.sum(F.when(~known, F.col("n0")))),
    ] + [
        (f"{table}.{column} in {parent}", F.sum(F.when(known & (F.col("n0") == 0), F.col(f"n{role}"))))
        for role, (table, column) in enumerate(children, 1)]
    counted = per_key.agg(*[F.coalesce(n, F.lit(0)).alias(f"c{i}") for i, (_, n) in enumerate(checks)])
    cells = [cell for i, (name, _) in enumerate(checks) for cell in (F.lit(name), F.col(f"c{i}"))]
    return counted.select(F.stack(F.lit(len(checks)), *cells).alias("check_name", "violations"))


def integrity_report(t: Tables) -> DataFrame:
    """Violations of every declared key: duplicated values, NULL keys, orphan rows.

    Each key is grouped once, together with the columns that refer to it. Rows are counted per
    value inside every task first, so a hot value is a few rows when it travels.
    """
    return reduce(DataFrame.unionAll, [_key_domain_report(t, table) for table in PRIMARY_KEYS])


def database_size(spark: SparkSession, warehouse_path: str) -> DataFrame:
    """Files and bytes per table folder below the warehouse path."""
    root = urlparse(warehouse_path).path.rstrip("/") + "/"
    table = F.split_part(F.split_part("path", F.lit(root), F.lit(2)), F.lit("/"), F.lit(1))
    return file_inventory(spark, warehouse_path, recursive=True).groupBy(table.alias("table_name")).agg(
        F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))


def _folders(inventory: DataFrame, root: str) -> DataFrame:
    """Folders with files, as named below the root (which may be written with or without a scheme)."""
    below = F.regexp_replace("path", "^.*?" + re.escape(urlparse(root).path.rstrip("/")) + "/", "")
    return inventory.select(F.regexp_replace(below, "/?[^/]*$", "").alias("folder")).distinct()


def _partition_columns(folders: DataFrame) -> list[str]:
    """Names of the ``column=value`` folders, outermost first; all files must lie at the same depth of the same ones."""
    names = F.transform(F.filter(F.split("folder", "/"), lambda p: p.contains("=")), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    found = folders.select(names.alias("names")).distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"folders of different columns: {found[0]['names']} and {found[1]['names']}")
    return found[0]["names"] if found else []


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = ADVISORY_PARTITION_BYTES,
            schema: T.StructType | None = None, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Rewrite a Parquet folder with files of about ``file_bytes`` into a fresh folder.

    Columns of all files count, absent ones are NULL; a partitioned folder stays partitioned, by the values
    exactly as its folders are named (007 stays 007), which is also how the result shows them. Flat
    folders are merged in place, not shuffled; partitioned ones are rebalanced, which gathers small
    partitions and splits large ones. With ``cluster_by`` rows are sorted along a space-filling curve of these
    columns, so that predicates on each of them skip row groups. Rows, columns and folders are compared
    with the source at the end.
    """
    session = session_with(spark, {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"})
    inventory = file_inventory(session, source, recursive=True)
    total = inventory.agg(F.sum("size")).first()[0] or 0
    folders = _folders(inventory, source)
    partitions = _partition_columns(folders)
    files = max(1, math.ceil(total / file_bytes))
    if schema:
        kept = T.StructType([T.StructField(f.name, T.StringType()) if f.name in partitions else f for f in schema])
        rows = session.read.schema(kept).parquet(source)
    else:
        rows = session.read.option("mergeSchema", True).parquet(source)
    if cluster_by:
        rows = clustered(rows, list(cluster_by), files, tuple(partitions))
    elif partitions:
        rows = rows.hint("rebalance", *[F.col(c) for c in partitions])
    else:
        rows = rows.coalesce(files)
    rows.write.partitionBy(*partitions).parquet(target)
    written = session.read.schema(rows.schema).parquet(target)
    stored = _folders(file_inventory(session, target, recursive=True), target)
    other = folders.exceptAll(stored).unionAll(stored.exceptAll(folders))
    if written.count() != rows.count() or set(session.read.parquet(target).columns) != set(rows.columns) or not other.isEmpty():
        raise RuntimeError(f"{target} does not hold what {source} holds")
    return written.select(rows.columns)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a folder whose files have different columns; absent ones are NULL."""
    return spark.read.option("mergeSchema", True).parquet(path)


def union_evolved(*versions: DataFrame) -> DataFrame:
    """The same over frames with known schemas, without reading any footer."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), versions)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    out = StringIO()
    with redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def stored_result(spark: SparkSession, root: str, build: Callable[[], DataFrame],
                  max_age: timedelta, now: datetime) -> DataFrame:
    """The result kept below ``root``, computed again once it is older than ``max_age``.

    The newest one is found by the names of its files; no stored row is read for it.
    """
    try:
        stamps = file_inventory(spark, root, recursive=True).select(
            F.regexp_extract("path", "stored_at=([^/]*)/", 1).alias("stored_at"))
        newest = stamps.agg(F.max("stored_at")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None or datetime.strptime(newest, STAMP_FORMAT) < now - max_age:
        newest = now.strftime(STAMP_FORMAT)
        build().write.parquet(f"{root}/stored_at={newest}")
    return spark.read.parquet(f"{root}/stored_at={newest}")
