"""Driving a streaming query over what has arrived so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.session import run_dir, session_with

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for stateful streams: build the stream and everything on it from this one.

    State is kept in RocksDB, off the Java heap, so it may outgrow executor memory.
    ``state_partitions`` fixes the number of state partitions, which a stateful
    query keeps for life; adaptive execution does not apply to them.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    return session_with(spark, settings)


def append_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process all available input into Parquet files and return them as a table.

    For rows that never change, such as the lines of a log. The checkpoint lies next to
    the output in the shared folder: a restarted query with the same ``path`` continues
    where it stopped and writes nothing twice.
    """
    spark = stream.sparkSession
    path = path or run_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def update_available(stream: DataFrame, label: str, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Process all available input and return the latest version of every row.

    For windows, which change while events arrive: each batch writes the windows that it
    changed, open ones included, so nothing waits for the watermark to pass. A batch that
    runs again after a failure replaces its own folder. ``keys`` identify a row.
    """
    spark = stream.sparkSession
    path = path or run_dir(spark, label)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return latest_versions(spark, f"{path}/rows", stream, keys)


def latest_versions(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the last batch that has them, from folders ``batch=<number>``."""
    columns = like.columns
    try:
        rows = spark.read.schema(like.schema.add("batch", "long")).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)  # no input yet
    values = [c for c in columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("row"))
    return newest.select([F.col(c) if c in keys else F.col("row")[c].alias(c) for c in columns])
