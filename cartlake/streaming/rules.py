"""Alert rules, metric roll-ups and log queries.

Every function takes a batch or a streaming DataFrame alike. Streams get their
watermark from ``watched`` first; counts are merged inside each task before the
shuffle, so one noisy account does not flood a single task.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import mean


@dataclass(frozen=True)
class AlertRule:
    """Raise an alert for each ``key`` with more than ``threshold`` matching events in a window."""

    name: str
    severity: str
    key: str
    threshold: int
    window: str
    every: str
    time: str = "ts"


# The two published alert rules.
FAILED_AUTHENTICATION = AlertRule(
    name="Failed Authentication Attempts", severity="High",
    key="Account", threshold=10, window="15 minutes", every="5 minutes")
FAILED_AUTHENTICATION_EVENT = 4625
STORAGE_ERRORS = AlertRule(
    name="Unusual Storage Access", severity="Medium",
    key="CallerIpAddress", threshold=50, window="30 minutes", every="10 minutes")
STORAGE_ERROR_STATUS = 400

#: What identifies a row of each result; later versions of a row replace earlier ones.
ALERT_KEYS = ("rule", "window_start", "window_end", "key")


def watched(stream: DataFrame, delay: str, time: str = "ts") -> DataFrame:
    """Accept events up to ``delay`` behind the newest one; later ones are dropped."""
    return stream.withWatermark(time, delay)


def _bounds(window: Column) -> list[Column]:
    return [
        window.getField("start").cast("timestamp_ntz").alias("window_start"),
        window.getField("end").cast("timestamp_ntz").alias("window_end"),
    ]


def alerts(events: DataFrame, matching: Column, rule: AlertRule) -> DataFrame:
    """One row per window and key over the threshold: rule, severity, bounds, key (as text) and event_count.

    All rules give the same columns, so their alerts can share one output. On a stream
    the condition is tied to the event time: as a plain filter it would move below the
    watermark, which then saw matching events only and stood still when an attack ends.
    """
    if events.isStreaming:
        matching = F.when(F.col(rule.time).isNotNull(), matching)
    counted = (
        events.where(matching)
        .groupBy(F.window(rule.time, rule.window, rule.every), F.col(rule.key).cast("string").alias("key"))
        .agg(F.count("*").alias("event_count"))
    )
    return counted.where(F.col("event_count") > rule.threshold).select(
        F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"),
        *_bounds(F.col("window")), "key", "event_count")


def failed_authentication_alerts(security_events: DataFrame) -> DataFrame:
    return alerts(security_events, F.col("EventID") == FAILED_AUTHENTICATION_EVENT, FAILED_AUTHENTICATION)


def storage_error_alerts(storage_logs: DataFrame) -> DataFrame:
    return alerts(storage_logs, F.col("StatusCode") >= STORAGE_ERROR_STATUS, STORAGE_ERRORS)


def metric_rollup(samples: DataFrame, metric: str, value: str, grain: str = "1 minute",
                  time: str = "ts") -> DataFrame:
    """Average and maximum of each metric per interval."""
    return (
        samples.groupBy(F.window(time, grain), F.col(metric))
        .agg(mean(value).alias("average"), F.max(value).alias("maximum"))
        .select(*_bounds(F.col("window")), metric, "average", "maximum")
    )


def request_counts(requests: DataFrame, grain: str = "5 minutes", time: str = "ts") -> DataFrame:
    return (
        requests.groupBy(F.window(time, grain)).agg(F.count("*").alias("total"))
        .select(*_bounds(F.col("window")), "total")
    )


def container_log(logs: DataFrame, container_column: str, container: str) -> DataFrame:
    """Lines of one container; streams follow it as they arrive."""
    return logs.where(F.col(container_column) == container)


def newest_first(logs: DataFrame, *tie_break: str, time: str = "ts") -> DataFrame:
    """Sorted by time. Tie-break columns also let the sort spread many rows of one instant over tasks."""
    return logs.orderBy(F.desc(time), *tie_break)


def _older_than(time: Column, days: int, as_of: datetime) -> Column:
    # Ages count in whole days: "older than 30 days" starts at 31 full days. As a
    # comparison of the bare column the condition reaches the Parquet scan.
    return time <= F.lit(as_of - timedelta(days=days + 1)).cast("timestamp_ntz")


def retention_tier(time: Column, as_of: datetime, archive_days: int = 30, drop_days: int = 90) -> Column:
    return (
        F.when(_older_than(time, drop_days, as_of), "drop")
        .when(_older_than(time, archive_days, as_of), "archive")
        .otherwise("keep")
    )


def expired_temp(time: Column, as_of: datetime, days: int = 7) -> Column:
    return _older_than(time, days, as_of)


def retained_temp(files: DataFrame, as_of: datetime, time: str = "ts", days: int = 7) -> DataFrame:
    """Temporary entries without the expired ones; those without a time stay."""
    expired = expired_temp(F.col(time), as_of, days)
    return files.where(~expired | expired.isNull())


def apply_retention(logs: DataFrame, path: str, as_of: datetime, time: str = "ts",
                    archive_days: int = 30, drop_days: int = 90) -> None:
    """Write the rows to keep and, compressed, the rows to archive; leave out the expired ones.

    Rows without a time are kept.
    """
    old = _older_than(F.col(time), archive_days, as_of)
    expired = _older_than(F.col(time), drop_days, as_of)
    logs.where(~old | old.isNull()).write.parquet(f"{path}/tier=keep")
    logs.where(old & ~expired).write.option("compression", "gzip").parquet(f"{path}/tier=archive")
