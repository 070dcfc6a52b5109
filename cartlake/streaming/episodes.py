"""One row per attack: overlapping alert windows of a rule and key merged into episodes.

An episode is an interval with a peak. Merging intervals is associative: windows may come in any order and
again with a higher count, and two episodes become one when late events fill the gap between them. So a
stream keeps the episodes found so far and merges what each batch changed, and gets what one pass over all
windows gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.session import run_dir
from cartlake.streaming import versions
from cartlake.streaming.rules import AlertRule, alerts

OWNER = ["rule", "key"]
EPISODE = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("begin", T.TimestampNTZType()), T.StructField("end", T.TimestampNTZType()), T.StructField("peak", T.LongType())])


def as_intervals(windows: DataFrame) -> DataFrame:
    """Alerts as episodes of one window each."""
    return windows.select("rule", "severity", "key", F.col("window_start").alias("begin"), F.col("window_end").alias("end"),
                          F.col("event_count").alias("peak"))


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals of one rule and key that overlap or touch as one row: first begin, last end, highest peak.

    A task sees the intervals of a key, not its events: at most one per step of the rule's windows.
    """
    in_order = Window.partitionBy(*OWNER).orderBy("begin", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int")
    numbered = intervals.withColumn("_opens", opens).withColumn(
        "_episode", F.sum("_opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*OWNER, "_episode").agg(
        F.max("severity").alias("severity"), F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.max("peak").alias("peak")).select(*EPISODE.names)


def alert_episodes(events: DataFrame, matching: Column, rule: AlertRule) -> DataFrame:
    """All episodes of a batch of events."""
    return merged(as_intervals(alerts(events, matching, rule)))


def current_episodes(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The episodes known before ``batch`` (or now): of every key those of the last batch that changed it."""
    rows = versions.read_versions(spark, path, EPISODE, batch)
    newest = rows.groupBy(*OWNER).agg(F.max(versions.BATCH).alias("newest"))
    # Few rows per key, and NULL keys are keys.
    last = rows.alias("r").join(newest.alias("n"), (F.col("r.rule") == F.col("n.rule")) & F.col("r.key").eqNullSafe(F.col("n.key"))
                                & (F.col(f"r.{versions.BATCH}") == F.col("n.newest")), "left_semi")
    return last.select(*EPISODE.names)


def episodes_available(changing: DataFrame, label: str, path: str | None = None, full_every: int = versions.FULL_EVERY) -> DataFrame:
    """Process all available input of a stream of alerts and return the episodes, open ones included.

    Each batch reads the episodes of the keys it changes, merges its windows into them and writes these keys anew.
    """
    spark = changing.sparkSession
    path = path or run_dir(spark, label)

    def write(windows: DataFrame, batch: int) -> None:
        found = as_intervals(windows)
        known = current_episodes(windows.sparkSession, path, batch)
        touched = found.select(*OWNER).distinct().withColumnsRenamed({"rule": "_rule", "key": "_key"})
        own = known.join(touched, (F.col("rule") == F.col("_rule")) & F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        versions.write_changes(merged(own.unionByName(found)), path, batch)
        if batch % full_every == full_every - 1:
            versions.write_full(current_episodes(windows.sparkSession, path, batch + 1), path, batch)

    query = (changing.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return current_episodes(spark, path)
