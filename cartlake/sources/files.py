"""Reading files: typed scans, CSV import, file inventory and whole-text reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cartlake.functions.expressions import CSV_NULL, unescape_lines


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet scan. With a schema no footer is read to plan the query; without, columns of all files count."""
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    return reader.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             sep: str = ",", multiline: bool = False, escaped: bool = True) -> DataFrame:
    """CSV with a header line and doubled-quote escaping.

    Without a schema the types are inferred from every row, which reads the files
    twice; pass a schema for large inputs. Texts are unescaped as ``export_csv``
    writes them; for files of other origin set ``escaped`` to False, and ``multiline``
    where quoted values hold line breaks, at the price of files that cannot be split.
    """
    reader = (
        spark.read.option("header", True).option("sep", sep)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
    )
    if escaped:
        reader = reader.option("nullValue", CSV_NULL)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    rows = reader.csv(path)
    if not escaped:
        return rows
    return rows.select([unescape_lines(F.col(f.name)).alias(f.name) if f.dataType == StringType() else F.col(f.name)
                        for f in rows.schema])


def query_sql(spark: SparkSession, text: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL over given frames (``{name}``), literals (``:name``) and files.

    Files are queried in place with ``FROM parquet.`<path>```; table names can be
    parameters through ``IDENTIFIER(:name)``.
    """
    return spark.sql(text, args=args, **frames)


def file_inventory(spark: SparkSession, path: str, recursive: bool = False,
                   pattern: str | None = None) -> DataFrame:
    """One row per data file: path, filename, size, modified. File contents are not read.

    Names starting with ``_`` or ``.`` count as hidden, as everywhere in Spark.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def folder_summary(inventory: DataFrame) -> DataFrame:
    """File count, bytes and newest change per folder."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return inventory.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("file_count"),
        F.sum("size").alias("total_bytes"),
        F.max("modified").alias("last_modified"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file with its whole content, size and modification time.

    The line break that ends a written record is not part of the content.
    """
    return spark.read.text(path, wholetext=True).withColumn("content", F.when(
        F.endswith("value", F.lit("\n")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))).select(
        "*",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    ).drop("value")
