"""Retention by whole days, and statistics from sketches of slices."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartlake.maintenance import slice_stats
from cartlake.maintenance.tables import plan_text
from cartlake.session import run_dir
from cartlake.streaming import retention, rules

START = datetime(2024, 1, 1)
AS_OF = datetime(2024, 3, 1, 6, 30)


def logs(spark):
    return spark.range(60 * 24).select("id", F.expr(
        "CASE WHEN id % 100 <> 99 THEN CAST(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT), 15) AS TIMESTAMP_NTZ) END AS ts"))


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                found.setdefault(folder.split("/tier=")[1], set()).add((n, os.stat(f"{folder}/{n}").st_mtime_ns))
    return found


def test_days_are_moved_and_deleted_and_one_is_rewritten(spark):
    path, rows = run_dir(spark, "logs"), logs(spark)
    retention.write_days(rows, path)
    before = files(path)
    done = retention.retire(spark, path, rows.schema, AS_OF, 10, 30)
    # The limits are 19 February 6:30 and 30 January 6:30.
    assert [d for a, d in done if a == "dropped"] == [date(2024, 1, 1) + timedelta(days=i) for i in range(29)]
    assert [d for a, d in done if a == "rewritten"] == [date(2024, 1, 30)]
    assert [d for a, d in done if a == "archived"] == [date(2024, 1, 30) + timedelta(days=i) for i in range(20)]
    after = files(path)
    assert all(after[f"archive/day={d}"] == before[f"keep/day={d}"] for a, d in done if a == "archived" and d > date(2024, 1, 30))
    assert all(after[f] == before[f] for f in before if f in after)
    assert retention.retire(spark, path, rows.schema, AS_OF, 10, 30) == []
    got = retention.read_tiers(spark, path, rows.schema, AS_OF, 10, 30)
    written = run_dir(spark, "by-row")
    rules.apply_retention(rows, written, AS_OF, archive_days=10, drop_days=30)
    want = spark.read.parquet(written)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.where("ts IS NULL").count() == rows.where("ts IS NULL").count()


def test_late_rows_of_an_archived_day_join_it(spark):
    path, rows = run_dir(spark, "logs"), logs(spark)
    retention.write_days(rows.where("id >= 1000"), path)
    retention.retire(spark, path, rows.schema, AS_OF, 10, 30)
    late = rows.where("id BETWEEN 960 AND 970")
    retention.write_days(late, path)
    assert retention.retire(spark, path, rows.schema, AS_OF, 10, 30) == [("archived", date(2024, 2, 10))]
    assert retention.read_tiers(spark, path, rows.schema, AS_OF, 10, 30).where("id BETWEEN 960 AND 970 AND tier = 'archive'").count() == 11
    assert retention.stored_days(spark, run_dir(spark, "none"), "keep") == []


def table(spark):
    return spark.range(50_000).select(
        "id", (F.col("id") % 977).alias("few"), F.expr("CASE WHEN id % 4 > 0 THEN CAST(id % 10007 AS STRING) END AS text"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 365).cast("int")).alias("day"), (F.col("id") % 7).alias("year"))


def test_united_sketches_stay_within_their_bounds(spark):
    df, path = table(spark), run_dir(spark, "stats")
    for year in range(7):  # slice by slice, as they arrive
        slice_stats.slice_statistics(df.where(F.col("year") == year), F.col("year")).write.mode("append").parquet(path)
    found = {r["column"]: r for r in slice_stats.united(
        spark.read.schema(slice_stats.STATS).parquet(path), df.schema).collect()}
    exact = df.select([F.count_distinct(c).alias(c) for c in df.columns]).first()
    for c in df.columns:
        assert abs(found[c].distinct_values - exact[c]) <= 0.04 * exact[c] + 1
        assert found[c].rows == 50_000 and found[c].nulls == (12_500 if c == "text" else 0)
    for q, value in zip(slice_stats.QUANTILES, found["id"].quantiles):
        assert abs(value / 50_000 - q) < 0.01
    assert found["text"].quantiles is None and (found["id"].least, found["id"].greatest) == ("0", "49999")
    assert (found["day"].least, found["day"].greatest) == ("2020-01-01", "2020-12-30")


def test_a_new_slice_scans_only_itself(spark):
    df = table(spark)
    path, stats = run_dir(spark, "rows"), run_dir(spark, "stats")
    df.write.partitionBy("year").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    one = slice_stats.slice_statistics(stored.where("year = 3"), F.col("year"))
    assert "PartitionFilters: [isnotnull(year" in plan_text(one, "simple")
    one.write.parquet(stats)
    united = slice_stats.united(spark.read.schema(slice_stats.STATS).parquet(stats), df.schema)
    assert path not in " ".join(united.inputFiles()) and united.count() == 5
    assert slice_stats.united(spark.read.schema(slice_stats.STATS).parquet(stats).limit(0), df.schema).count() == 0


@pytest.mark.parametrize("rows", [[], [(None,)]])
def test_slices_without_values(spark, rows):
    df = spark.createDataFrame(rows, "v double")
    stats = slice_stats.slice_statistics(df, F.lit("s"))
    assert [(r.rows, r.nulls, r.distinct_values, r.quantiles) for r in slice_stats.united(stats, df.schema).collect()] == [
        (1, 1, 0, None)] * len(rows)
