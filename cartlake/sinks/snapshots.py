"""Snapshots of tables that copy changed slices only, reading past states, and their differences.

A table is cut into slices (a year, a hash of the key). The digest of a slice is a sum over its rows' hashes,
so it does not depend on their order and is merged from every task's part. Slices whose digest and columns
are those of the newest snapshot are not copied: the new manifest points to the files that have them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.functions.expressions import STAMP_FORMAT

#: Snapshots may follow each other within a second.
STAMP = STAMP_FORMAT + "_%f"
SLICE = "_slice"
#: The slice of rows for which the slicing expression is NULL.
NO_SLICE = "__none__"
#: One row per slice; an empty table has one with slice NULL.
MANIFEST = ("table_name string, slice string, row_count bigint, digest string, columns string, folder string, "
            "snapshot_ts string")


def row_hash(columns: list[str], seed: int = 0) -> Column:
    """A hash of a row's values and NULLs; texts that only border differently hash differently."""
    values = [F.struct(F.lit(seed), F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in columns]
    return F.xxhash64(*values)


def digest(columns: list[str]) -> Column:
    """An aggregate: the same for the same rows in any order, repeated rows included."""
    parts = [F.sum(row_hash(columns, seed).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    return F.concat_ws("/", *parts, F.count("*").cast("string"))


def _sliced(df: DataFrame, slice_by: Column | None) -> DataFrame:
    name = F.lit("all") if slice_by is None else F.coalesce(slice_by.cast("string"), F.lit(NO_SLICE))
    return df.withColumn(SLICE, name)


def write_snapshot(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], at: datetime,
                   slice_by: Mapping[str, Column] | None = None) -> DataFrame:
    """Store every table as of ``at`` below ``root``; of slices that did not change only the reference.

    ``slice_by`` names an expression per table with few distinct values (up to some ten thousand); a table
    without is one slice. The manifest is written last, in one file, so a snapshot that broke off half-way is
    never read. Returns the manifest rows of this snapshot.
    """
    stamp = at.strftime(STAMP)
    entries, before = [], _newest(spark, root, stamp, *tables)
    for name, df in tables.items():
        columns = df.schema.json()
        sliced = _sliced(df, (slice_by or {}).get(name))
        known = {(r["slice"], r["digest"]): r["folder"] for r in before if r["table_name"] == name and r["columns"] == columns}
        # The list of slices, not of rows, comes to the driver.
        now = sliced.groupBy(SLICE).agg(digest(df.columns).alias("digest"), F.count("*").alias("row_count")).collect()
        changed = [r[SLICE] for r in now if (r[SLICE], r["digest"]) not in known]
        if changed:
            path = f"{root}/data/snapshot_ts={stamp}/{name}"
            rows = sliced.where(F.col(SLICE).isin(changed))
            # One slice keeps the partitions that it has; several are gathered, and large ones split.
            rows = rows.hint("rebalance", F.col(SLICE)) if len(now) > 1 else rows
            rows.write.partitionBy(SLICE).parquet(path)
            stored = {r[SLICE]: r["n"] for r in _read(spark, path, df.schema, changed).groupBy(SLICE).agg(
                F.count("*").alias("n")).collect()}
            wrong = [s for s in now if s[SLICE] in changed and stored.get(s[SLICE]) != s["row_count"]]
            if wrong:
                raise RuntimeError(f"{name} changed while it was stored: {wrong[0][SLICE]}")
        entries += [(name, r[SLICE], r["row_count"], r["digest"], columns, known.get((r[SLICE], r["digest"]), stamp)) for r in now]
        if not now:
            entries.append((name, None, 0, None, columns, stamp))
    manifest = spark.createDataFrame(entries, MANIFEST.rsplit(",", 1)[0])
    manifest.coalesce(1).write.parquet(f"{root}/manifest/snapshot_ts={stamp}")
    return read_manifest(spark, root).where(F.col("snapshot_ts") == stamp)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def snapshot_counts(manifest: DataFrame) -> DataFrame:
    """Rows per snapshot and table."""
    return manifest.groupBy("snapshot_ts", "table_name").agg(F.sum("row_count").alias("row_count"))


def _newest(spark: SparkSession, root: str, stamp: str, *tables: str) -> list:
    """Manifest rows of the newest complete snapshot of each table that is not later; none where there is none."""
    try:
        known = read_manifest(spark, root).where(F.col("table_name").isin(*tables) & (F.col("snapshot_ts") <= stamp))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    latest = known.groupBy("table_name").agg(F.max("snapshot_ts").alias("snapshot_ts"))
    return known.join(latest, ["table_name", "snapshot_ts"]).collect()


def _read(spark: SparkSession, path: str, schema: T.StructType, slices: list[str]) -> DataFrame:
    """Rows and slice, of the given slices; other folders are not opened."""
    return spark.read.schema(T.StructType([*schema, T.StructField(SLICE, T.StringType())])).parquet(path).where(
        F.col(SLICE).isin(slices))


def _state(spark: SparkSession, root: str, table: str, entries: list, rows: list) -> DataFrame:
    """The rows of some slices of one snapshot, wherever their files lie; ``entries`` are all of the snapshot."""
    schema = T.StructType.fromJson(json.loads(entries[0]["columns"]))
    folders: dict[str, list[str]] = {}
    for r in rows:
        if r["slice"] is not None:
            folders.setdefault(r["folder"], []).append(r["slice"])
    parts = [_read(spark, f"{root}/data/snapshot_ts={folder}/{table}", schema, slices).drop(SLICE)
             for folder, slices in sorted(folders.items())]
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def _entries(spark: SparkSession, root: str, table: str, as_of: datetime) -> list:
    found = _newest(spark, root, as_of.strftime(STAMP), table)
    if not found:
        raise LookupError(f"no snapshot of {table} at or before {as_of}")
    return found


def read_as_of(spark: SparkSession, root: str, table: str, as_of: datetime) -> DataFrame:
    """The table as stored by the newest complete snapshot not later than ``as_of``."""
    entries = _entries(spark, root, table, as_of)
    return _state(spark, root, table, entries, entries)


def changes_between(spark: SparkSession, root: str, table: str, key: str, before: datetime, after: datetime) -> DataFrame:
    """Keys whose rows differ between two times: key, change (inserted, updated or deleted), rows_before, rows_after.

    Slices that are equal in both states are not read. The others' rows meet by key as counts and sums of
    hashes, merged inside tasks, so repeated keys of any number are exact and a hot one is a few rows. A
    column that only one state has counts as NULL in the other; rows without a key are compared together.
    """
    old, new = (_entries(spark, root, table, at) for at in (before, after))
    same = {(r["slice"], r["digest"], r["columns"]) for r in old} & {(r["slice"], r["digest"], r["columns"]) for r in new}
    sides = []
    for rows in (old, new):
        differing = [r for r in rows if (r["slice"], r["digest"], r["columns"]) not in same]
        sides.append(_state(spark, root, table, rows, differing))
    columns = sorted({*sides[0].columns, *sides[1].columns})
    both = sides[0].withColumn("_new", F.lit(False)).unionByName(
        sides[1].withColumn("_new", F.lit(True)), allowMissingColumns=True)
    hashes = [row_hash(columns, seed).cast("decimal(38,0)").alias(f"_h{seed}") for seed in (1, 2)]
    per_key = both.select(F.col(f"`{key}`").alias(key), "_new", *hashes).groupBy(key).agg(
        F.count_if(~F.col("_new")).alias("rows_before"), F.count_if("_new").alias("rows_after"),
        *[F.sum(F.when(F.col("_new"), F.col(h)).otherwise(-F.col(h))).alias(h) for h in ("_h1", "_h2")])
    change = F.when(F.col("rows_before") == 0, "inserted").when(F.col("rows_after") == 0, "deleted").otherwise("updated")
    differs = (F.col("rows_before") != F.col("rows_after")) | (F.col("_h1") != 0) | (F.col("_h2") != 0)
    return per_key.where(differs).select(key, change.alias("change"), "rows_before", "rows_after")
