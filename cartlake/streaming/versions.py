"""State that a stream keeps as tables: one folder per batch, and now and then a folder that stands for all before.

A batch that runs again replaces its own folder and reads only those before it, so a failure changes nothing.
Folders that a full one replaced can be deleted; no reader opens them any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"
#: Every so many batches the state is written as a whole.
FULL_EVERY = 16


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batch folders below ``path``; only their names are read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    names = [status.getPath().getName() for status in files.listStatus(hadoop)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BATCH}="))


def folders_before(spark: SparkSession, path: str, batch: int | None = None) -> list[str]:
    """The folders that make up the state before ``batch`` (or now): the newest full one and all changes since."""
    def earlier(kind: str) -> list[int]:
        return [n for n in _numbers(spark, f"{path}/{kind}") if batch is None or n < batch]

    full = earlier("full")[-1:]
    changes = [n for n in earlier("changes") if not full or n > full[0]]
    return [f"{path}/full/{BATCH}={n}" for n in full] + [f"{path}/changes/{BATCH}={n}" for n in changes]


def full_number(spark: SparkSession, path: str) -> int | None:
    """The batch of the newest full folder."""
    return max(_numbers(spark, f"{path}/full"), default=None)


def changes_after(spark: SparkSession, path: str, batch: int) -> list[str]:
    return [f"{path}/changes/{BATCH}={n}" for n in _numbers(spark, f"{path}/changes") if n > batch]


def read_versions(spark: SparkSession, path: str, schema: T.StructType, batch: int | None = None) -> DataFrame:
    """The rows of these folders with the number of their batch."""
    folders = folders_before(spark, path, batch)
    with_batch = T.StructType([*schema, T.StructField(BATCH, T.LongType())])
    if not folders:
        return spark.createDataFrame([], with_batch)
    # Numbers follow from the folder names, in one scan.
    number = F.regexp_extract(F.col("_metadata.file_path"), f"/{BATCH}=([0-9]+)/", 1).cast("long")
    return spark.read.schema(schema).parquet(*folders).withColumn(BATCH, number)


def write_changes(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={batch}")


def write_full(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/full/{BATCH}={batch}")


def remove_replaced(spark: SparkSession, path: str) -> int:
    """Delete the folders that the newest full one stands for; returns how many."""
    kept = set(folders_before(spark, path))
    removed = 0
    for kind in ("full", "changes"):
        for n in _numbers(spark, f"{path}/{kind}"):
            folder = f"{path}/{kind}/{BATCH}={n}"
            if folder not in kept:
                hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                removed += hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return removed
