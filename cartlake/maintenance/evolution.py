"""Folders whose files disagree about column types: one schema that holds all values exactly.

Files are grouped by what their footers can be merged into. Spark reads the footers of a group in one
job; a group that does not merge is halved, in the order in which the files were written, as types change
seldom and for good. Each group is read with its own schema and cast to the common one. Types that have no
common type without loss are an error that names the column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.session import session_with
from cartlake.sources.files import file_inventory

INTEGERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
#: Digits that every value of an integer type fits into.
DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}
MOST_DIGITS = 38
AS_STORED = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


class LossyChange(ValueError):
    """Two types of a column have no common type that keeps all values of both."""


@dataclass(frozen=True)
class SchemaGroup:
    schema: T.StructType
    paths: tuple[str, ...]


def _merged(spark: SparkSession, root: str, paths: list[str]) -> T.StructType | None:
    """The schema of all these files, added columns included; None where types differ."""
    try:
        return spark.read.option("mergeSchema", True).option("basePath", root).parquet(*paths).schema
    except (PySparkException, Py4JJavaError) as error:  # depends on where the schemas met
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
        return None


def schema_groups(spark: SparkSession, root: str) -> list[SchemaGroup]:
    """The files below ``root`` by schema; values of partition folders stay texts as they are written."""
    listed = file_inventory(spark, root, recursive=True, pattern="*.parquet").orderBy("modified", "path")
    return schema_groups_of(spark, root, [r["path"] for r in listed.select("path").toLocalIterator()])


def schema_groups_of(spark: SparkSession, root: str, files: list[str]) -> list[SchemaGroup]:
    """These files below ``root`` by schema."""
    spark = session_with(spark, AS_STORED)
    open_, found = [files], {}
    while open_:
        paths = open_.pop()
        schema = _merged(spark, root, paths) if paths else None
        if schema is not None:
            found.setdefault(schema.json(), (schema, []))[1].extend(paths)
        elif paths:
            open_ += [paths[len(paths) // 2:], paths[:len(paths) // 2]]
    return [SchemaGroup(schema, tuple(paths)) for schema, paths in found.values()]


def widest(a: T.DataType, b: T.DataType, column: str = "") -> T.DataType:
    """The smallest type that holds every value of both exactly."""
    if a == b:
        return a
    kinds = {type(a), type(b)}
    if T.NullType in kinds:
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return widest_schema(a, b, f"{column}.")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widest(a.elementType, b.elementType, f"{column}.element"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(widest(a.keyType, b.keyType, f"{column}.key"), widest(a.valueType, b.valueType, f"{column}.value"))
    if a in INTEGERS and b in INTEGERS:
        return max(a, b, key=INTEGERS.index)
    if kinds == {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if kinds & {T.FloatType, T.DoubleType}:
        number = next((t for t in (a, b) if t in INTEGERS[:3]), None)
        if number is not None:  # whole numbers of 16 bits fit a float, of 32 bits a double
            return T.FloatType() if T.FloatType in kinds and number in INTEGERS[:2] else T.DoubleType()
    if T.DecimalType in kinds:
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (DIGITS[t], 0) for t in (a, b)
                 if isinstance(t, T.DecimalType) or t in INTEGERS]
        if len(parts) == 2:
            whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
            if whole + scale <= MOST_DIGITS:
                return T.DecimalType(whole + scale, scale)
    if kinds in ({T.DateType, T.TimestampType}, {T.DateType, T.TimestampNTZType}):
        return a if isinstance(b, T.DateType) else b
    raise LossyChange(f"column {column}: {a.simpleString()} and {b.simpleString()} have no common type without loss")


def widest_schema(a: T.StructType, b: T.StructType, prefix: str = "") -> T.StructType:
    """All columns of both, each in its widest type."""
    mine, other = ({f.name: f.dataType for f in s} for s in (a, b))
    return T.StructType([
        T.StructField(n, widest(mine[n], other[n], prefix + n) if n in mine and n in other else mine.get(n) or other[n])
        for n in {**mine, **other}])


def _cast_target(own: T.DataType, common: T.DataType) -> T.DataType:
    """The common type, without the nested fields that a group does not have."""
    if isinstance(own, T.StructType):
        return T.StructType([T.StructField(f.name, _cast_target(f.dataType, common[f.name].dataType)) for f in own])
    if isinstance(own, T.ArrayType):
        return T.ArrayType(_cast_target(own.elementType, common.elementType))
    if isinstance(own, T.MapType):
        return T.MapType(_cast_target(own.keyType, common.keyType), _cast_target(own.valueType, common.valueType))
    return common


def common_schema(groups: list[SchemaGroup]) -> T.StructType:
    """The schema for all groups; an error names the column and a file of each side."""
    schema, seen = T.StructType(), []
    for group in groups:
        try:
            schema = widest_schema(schema, group.schema)
        except LossyChange as error:
            raise LossyChange(f"{error} (files like {group.paths[0]} against {', '.join(seen)})") from None
        seen.append(group.paths[0])
    return schema


def read_reconciled(spark: SparkSession, root: str) -> DataFrame:
    """All rows below ``root`` in the common schema; absent columns are NULL.

    Dates become midnights where other files have timestamps. One scan per group, each of its own files.
    """
    groups = schema_groups(spark, root)
    if not groups:
        raise FileNotFoundError(f"no Parquet file below {root}")
    schema = common_schema(groups)
    session = session_with(spark, AS_STORED)
    parts = []
    for group in groups:
        rows = session.read.schema(group.schema).option("basePath", root).parquet(*group.paths)
        parts.append(rows.select([F.col(f"`{f.name}`").cast(_cast_target(f.dataType, schema[f.name].dataType)).alias(f.name)
                                  for f in group.schema]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select([f"`{n}`" for n in schema.names])
