"""Loading only the files that are new or changed since the last load.

The loaded table is a folder: ``rows/load=<n>`` holds the rows of load n with the file that each came from,
``manifest/load=<n>`` the files of that load (name, size, time of change). The manifest of a load is one file,
written last, so a load that broke off leaves nothing that a reader sees, and is done again under its number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.operators.staging import staged

FILE, LOAD = "source_file", "load"
IDENTITY = [FILE, "size", "modified"]
MANIFEST = f"{FILE} string, path string, size long, modified timestamp, {LOAD} long"


def source_files(spark: SparkSession, source: str, pattern: str = "*.parquet") -> DataFrame:
    """Name (as rows of the file carry it), path, size and time of change of every file; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(source)
    return listed.select(F.col("_metadata.file_path").alias(FILE), "path", F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified"))


def read_manifest(spark: SparkSession, target: str) -> DataFrame:
    """One row per file and load, of loads that were completed."""
    try:
        return spark.read.schema(MANIFEST).option("basePath", f"{target}/manifest").parquet(f"{target}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def pending_files(spark: SparkSession, source: str, target: str, pattern: str = "*.parquet") -> DataFrame:
    """Files that no load has seen as they are now, with ``status``: new, or changed since they were loaded."""
    manifest = read_manifest(spark, target)
    unseen = source_files(spark, source, pattern).join(manifest, IDENTITY, "left_anti")
    known = manifest.select(FILE).distinct().withColumn("known", F.lit(True))
    return unseen.join(known, FILE, "left").withColumn(
        "status", F.when(F.col("known"), "changed").otherwise("new")).drop("known")


def load_new_files(spark: SparkSession, source: str, target: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """Read the pending files, and only these, into the table at ``target``.

    The schema is given, so no footer is read to plan; columns that a file lacks are NULL. The driver holds
    the names of the pending files, as any scan of them would. Returns load, status and file_count, no rows if
    nothing is pending.
    """
    pending = staged(pending_files(spark, source, target, pattern), "pending-files")
    paths = [r["path"] for r in pending.select("path").toLocalIterator()]
    number = last_load(spark, target) + 1
    if paths:
        # Bytes decide how many tasks read them; the time of each file was taken before it is read.
        rows = spark.read.schema(schema).parquet(*paths).withColumn(FILE, F.col("_metadata.file_path"))
        rows.write.mode("overwrite").parquet(f"{target}/rows/{LOAD}={number}")
        pending.drop("status").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{LOAD}={number}")
    return pending.groupBy(F.lit(number).alias(LOAD), "status").agg(F.count("*").alias("file_count"))


def last_load(spark: SparkSession, target: str) -> int:
    return read_manifest(spark, target).agg(F.max(LOAD)).first()[0] or 0


def read_loaded(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """The rows of all completed loads; of a file that was loaded again only the newest version.

    Files that vanished from the source keep their rows.
    """
    manifest = read_manifest(spark, target)
    last = last_load(spark, target)
    if not last:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema, T.StructField(FILE, T.StringType()), T.StructField(LOAD, T.LongType())])
    rows = spark.read.schema(stored).option("basePath", f"{target}/rows").parquet(f"{target}/rows").where(F.col(LOAD) <= last)
    newest = manifest.groupBy(FILE).agg(F.max(LOAD).alias("newest"))
    replaced = manifest.join(newest, FILE).where(F.col(LOAD) < F.col("newest")).select(FILE, LOAD)
    if not replaced.isEmpty():
        rows = rows.join(staged(replaced, "replaced-files"), [FILE, LOAD], "left_anti")
    return rows.select(*schema.names)
