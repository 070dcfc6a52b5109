"""Database attachment and idempotent loading of the configured tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartlake.config import LakeConfig, TableLayout
from cartlake.maintenance.evolution import schema_groups_of, widest
from cartlake.operators.skew import dealt_to_buckets
from cartlake.schemas import TABLE_SCHEMAS, Tables
from cartlake.sources.files import file_inventory, scan_parquet

#: Files whose footers are compared with a declared schema.
SAMPLED_FOOTERS = 64


def attach(spark: SparkSession, config: LakeConfig, use: bool = False) -> None:
    """Create the database over its warehouse folder if needed; optionally make it current."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{config.database}` LOCATION '{config.warehouse_path}'")
    if use:
        spark.catalog.setCurrentDatabase(config.database)


def missing_tables(spark: SparkSession, config: LakeConfig) -> list[str]:
    """Logical names of configured tables that this database does not hold yet."""
    return [t for t in config.tables if not spark.catalog.tableExists(config.qualified(t))]


class UndeclaredTypes(ValueError):
    """Source files hold columns or types that the declared schema would drop or change."""


def check_declared(spark: SparkSession, path: str, schema: StructType, most_files: int = SAMPLED_FOOTERS) -> None:
    """Compare the declared schema with the footers of at most ``most_files`` files, chosen by a hash of their paths.

    Columns that files lack are fine, as they are NULL; others and types that need a loss are an error. A file that the
    sample misses and whose types do not fit fails when it is read, but columns that only such files have are not noticed.
    """
    listed = file_inventory(spark, path, recursive=True, pattern="*.parquet")
    sample = [r["path"] for r in listed.orderBy(F.xxhash64("path"), "path").limit(most_files).collect()]
    if not sample:
        return
    declared = {f.name.lower(): f.dataType for f in schema}
    for group in schema_groups_of(spark, path, sample):
        for column in group.schema:
            name, own = column.name, column.dataType
            if name.lower() not in declared:
                raise UndeclaredTypes(f"column {name} of files like {group.paths[0]} is not declared")
            if widest(declared[name.lower()], own, name) != declared[name.lower()]:
                raise UndeclaredTypes(f"column {name}: {own.simpleString()} in files like {group.paths[0]}, "
                                      f"declared {declared[name.lower()].simpleString()}")


def open_source(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The Parquet files below ``path``, or None where there are none; with a schema, in its columns and types."""
    try:
        if schema:
            check_declared(spark, path, schema)
        return scan_parquet(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def create_table(df: DataFrame, name: str, layout: TableLayout = TableLayout(), path: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS ... AS SELECT, with the given storage layout.

    With a fresh ``path`` the table lies there, and what a broken load left elsewhere does not matter.
    """
    if layout.bucket_by:
        df = dealt_to_buckets(df, layout.bucket_by, layout.buckets)
    elif layout.partition_by:
        # Rebalancing splits a partition value that is too big for one task.
        df = df.hint("rebalance", *[F.col(c) for c in layout.partition_by])
    if layout.sort_by and not layout.bucket_by:
        df = df.sortWithinPartitions(*layout.partition_by, *layout.sort_by)
    writer = df.write.format("parquet").mode("ignore")
    if path:
        writer = writer.option("path", path)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    if layout.bucket_by:
        writer = writer.bucketBy(layout.buckets, layout.bucket_by)
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
    writer.saveAsTable(name)


def load_tables(spark: SparkSession, config: LakeConfig) -> DataFrame:
    """Create every configured table that does not exist yet from its source file.

    Each is written to a fresh folder below its own and registered when it is complete, so a load that
    broke off can be repeated.

    Returns one row per table: ``created``, ``exists`` or ``missing`` (no source
    file; the others still load), with the row count of the table.
    """
    attach(spark, config)
    absent = set(missing_tables(spark, config))
    report = []
    for logical in config.files:
        status = "exists"
        if logical in absent:
            source = open_source(spark, config.file_path(logical), config.schemas.get(logical))
            status = "missing" if source is None else "created"
            if source is not None:
                create_table(source, config.qualified(logical), config.layouts.get(logical, TableLayout()),
                             f"{config.table_path(logical)}/{uuid.uuid4().hex}")
        rows = (
            spark.range(1).select(F.lit(None).cast("bigint").alias("row_count"))
            if status == "missing"
            else spark.table(config.qualified(logical)).agg(F.count("*").alias("row_count"))
        )
        report.append(rows.select(
            F.lit(config.tables[logical]).alias("table_name"), F.lit(status).alias("status"), "row_count",
        ))
    return reduce(DataFrame.unionAll, report)


def lake_tables(spark: SparkSession, config: LakeConfig) -> Tables:
    """The loaded tables, ready for the business queries."""
    return Tables(**{t: spark.table(config.qualified(t)) for t in TABLE_SCHEMAS})
