"""Retention of logs stored by day: whole days change tier or go, and nearly no row is read.

Days are folders ``tier=<tier>/day=<day>``. A day that is old as a whole has its files moved to the archive,
one that expired as a whole is deleted. The day that the expiry limit cuts is written again without its
expired rows; the day that the archive limit cuts stays where it is, and its rows are told apart when read.
Every step can be repeated, so a run that broke off is simply run again.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.streaming.rules import retention_tier

KEEP, ARCHIVE = "keep", "archive"


def write_days(logs: DataFrame, path: str, time: str = "ts") -> None:
    """Append logs to the days of the first tier; a day with most rows is written by several tasks."""
    logs.withColumn("day", F.to_date(time)).hint("rebalance", F.col("day")).write.mode("append").partitionBy("day").parquet(
        f"{path}/tier={KEEP}")


def _hadoop(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_days(spark: SparkSession, path: str, tier: str) -> list[date]:
    """Days of a tier by the names of their folders; rows without a time have none."""
    folder, files = _hadoop(spark, f"{path}/tier={tier}")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day=") and not n.startswith("day=__"))


def _move(spark: SparkSession, source: str, target: str) -> None:
    """All files of a folder into another, which may have files of late rows already."""
    folder, files = _hadoop(spark, source)
    to = _hadoop(spark, target)[0]
    files.mkdirs(to)
    for status in files.listStatus(folder):
        if not files.rename(status.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, status.getPath().getName())):
            raise RuntimeError(f"{status.getPath()} could not be moved to {target}")
    files.delete(folder, True)


def _delete(spark: SparkSession, path: str) -> None:
    folder, files = _hadoop(spark, path)
    files.delete(folder, True)


def retire(spark: SparkSession, path: str, schema: T.StructType, as_of: datetime, archive_days: int = 30, drop_days: int = 90,
           time: str = "ts") -> list[tuple[str, date]]:
    """Bring the tiers to ``as_of``. Returns what was done to which day: dropped, rewritten or archived."""
    # The last instants that are old; ages count in whole days.
    old, expired = (as_of - timedelta(days=days + 1) for days in (archive_days, drop_days))
    done = []
    for tier in (KEEP, ARCHIVE):
        for day in stored_days(spark, path, tier):
            first = datetime(day.year, day.month, day.day)
            last, folder = first + timedelta(days=1) - timedelta(microseconds=1), f"{path}/tier={tier}/day={day}"
            if last <= expired:
                _delete(spark, folder)
                done.append(("dropped", day))
                continue
            if first <= expired:
                rows = spark.read.schema(schema).parquet(folder).where(F.col(time) > F.lit(expired).cast("timestamp_ntz"))
                if rows.count() < spark.read.schema(schema).parquet(folder).count():
                    # Written beside the folder and put in its place at the end.
                    rows.withColumn("day", F.lit(day)).write.mode("overwrite").option(
                        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/tier={tier}")
                    done.append(("rewritten", day))
            if tier == KEEP and last <= old:
                _move(spark, folder, f"{path}/tier={ARCHIVE}/day={day}")
                done.append(("archived", day))
    return done


def read_tiers(spark: SparkSession, path: str, schema: T.StructType, as_of: datetime, archive_days: int = 30,
               drop_days: int = 90, time: str = "ts") -> DataFrame:
    """All rows that are not expired, with their tier as of this moment, wherever their day is stored."""
    stored = T.StructType([*schema, T.StructField("tier", T.StringType()), T.StructField("day", T.DateType())])
    tier: Column = retention_tier(F.col(time), as_of, archive_days, drop_days)
    first = (as_of - timedelta(days=drop_days + 1)).date()
    rows = spark.read.schema(stored).parquet(path).where((F.col("day") >= F.lit(first)) | F.col("day").isNull())
    return rows.drop("day").withColumn("tier", tier).where(F.col("tier") != "drop")
