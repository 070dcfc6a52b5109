"""Rules give the same rows on a stream as in batch, up to the watermark."""

import os
from datetime import datetime, timedelta

import pytest
from frames import values
from pyspark.sql import functions as F

from cartlake.maintenance.tables import plan_text
from cartlake.session import run_dir
from cartlake.streaming import rules
from cartlake.streaming.run import append_available, streaming_session, update_available

SCHEMA = "ts timestamp, key string, code int"
START = datetime(2024, 1, 1, 12)


def at(minutes, key="a", code=4625):
    return START + timedelta(minutes=minutes), key, code


def arrivals(spark, *batches):
    """A file stream that delivers one batch of rows after the other."""
    path, session = run_dir(spark, "arrivals"), streaming_session(spark, state_partitions=2)
    for number, batch in enumerate(batches):
        spark.createDataFrame(list(batch), SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/n={number}")
        for folder, _, names in os.walk(f"{path}/n={number}"):
            for name in names:
                os.utime(os.path.join(folder, name), (1_700_000_000 + number, 1_700_000_000 + number))
    return (session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(path))


RULE = rules.AlertRule("Test", "Low", key="key", threshold=1, window="15 minutes", every="5 minutes")
WINDOWS = ("window_start", "window_end")


def test_late_events_within_the_delay_count_and_others_are_dropped(spark):
    stream = arrivals(spark, [at(1)], [at(20)], [at(12)], [at(2)], [at(120)])
    counts = rules.request_counts(rules.watched(stream, "10 minutes"))
    result = update_available(counts, "late", WINDOWS)
    found = {(r.window_start.hour, r.window_start.minute, r.total) for r in result.collect()}
    # Minute 12 is in time, the second event of window 0 is not; the last window is there though it is open.
    assert found == {(12, 0, 1), (12, 10, 1), (12, 20, 1), (14, 0, 1)}


def test_alerts_fire_for_sliding_windows_over_the_threshold(spark):
    events = [at(0), at(4), at(30, "b"), at(31, "b", 1), at(200)]
    stream = rules.watched(arrivals(spark, events), "1 minute")
    matching = F.col("code") == 4625
    live = update_available(rules.alerts(stream, matching, RULE), "alerts", rules.ALERT_KEYS)
    batch = rules.alerts(spark.createDataFrame(events, SCHEMA), matching, RULE)
    assert sorted(values(live)) == sorted(values(batch))
    assert [r.window_start.strftime("%H:%M") for r in live.orderBy("window_start").collect()] == [
        "11:50", "11:55", "12:00"]


ATTACK = [at(m / 10, "eve") for m in range(11)]
TRAFFIC = [at(m, "bob", 4624) for m in range(2, 24 * 60, 7)]


@pytest.mark.parametrize("batches", [
    [ATTACK + TRAFFIC], [ATTACK, TRAFFIC], [ATTACK[:4], ATTACK[4:] + TRAFFIC[:3], TRAFFIC[3:90], TRAFFIC[90:]]])
def test_an_attack_before_normal_traffic_raises_all_its_alerts(spark, batches):
    rule = rules.AlertRule("Attack", "High", key="key", threshold=10, window="15 minutes", every="5 minutes")
    matching = F.col("code") == 4625
    stream = rules.watched(arrivals(spark, *batches), "10 minutes")
    live = update_available(rules.alerts(stream, matching, rule), "attack", rules.ALERT_KEYS)
    batch = rules.alerts(spark.createDataFrame([e for b in batches for e in b], SCHEMA), matching, rule)
    assert sorted(values(live)) == sorted(values(batch)) and batch.count() == 3
    assert {(r.rule, r.severity, r.key, r.event_count) for r in live.collect()} == {("Attack", "High", "eve", 11)}


def test_alerts_without_input(spark):
    stream = rules.watched(arrivals(spark, []), "10 minutes")
    assert update_available(rules.alerts(stream, F.col("code") == 1, RULE), "none", rules.ALERT_KEYS).count() == 0


def test_the_batch_condition_reaches_the_scan(spark):
    path = run_dir(spark, "plan")
    spark.createDataFrame([at(0)], SCHEMA).write.parquet(path)
    matching = F.col("code") == 4625
    batch = rules.alerts(spark.read.parquet(path), matching, RULE)
    assert "EqualTo(code,4625)" in plan_text(batch)


def test_complete_mode_equals_batch(spark):
    events = [at(m, key) for m in (0, 3, 7, 8, 33) for key in "ab"]
    rolled = rules.metric_rollup(arrivals(spark, events[:4], events[4:]), "key", "code")
    query = (rolled.writeStream.format("memory").queryName("rolled").outputMode("complete")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    batch = rules.metric_rollup(spark.createDataFrame(events, SCHEMA), "key", "code")
    assert sorted(values(rolled.sparkSession.table("rolled"))) == sorted(values(batch))


def test_restart_continues_without_duplicates(spark):
    path = run_dir(spark, "restart")
    source = run_dir(spark, "log")
    spark.createDataFrame([at(0, "x"), at(1, "y")], SCHEMA).write.parquet(source)

    def follow():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        return append_available(rules.container_log(stream, "key", "x"), "follow", path=path)

    assert follow().count() == 1
    assert follow().count() == 1
    spark.createDataFrame([at(2, "x")], SCHEMA).write.mode("append").parquet(source)
    assert follow().count() == 2


def test_named_rules(spark):
    logins = spark.createDataFrame([(START, 4625, "eve")] * 11 + [(START, 4624, "bob")] * 20 + [(START, 4625, "ann")] * 10,
                                   "ts timestamp, EventID int, Account string")
    fired = rules.failed_authentication_alerts(logins)
    assert {(r.key, r.event_count, r.severity) for r in fired.collect()} == {("eve", 11, "High")} and fired.count() == 3
    access = spark.createDataFrame([(START, 400, "1.1.1.1")] * 51 + [(START, 399, "2.2.2.2")] * 60,
                                   "ts timestamp, StatusCode int, CallerIpAddress string")
    found = rules.storage_error_alerts(access)
    assert {(r.rule, r.key) for r in found.collect()} == {("Unusual Storage Access", "1.1.1.1")}
    assert fired.unionAll(found).columns == found.columns


def test_log_newest_first(spark):
    logs = spark.createDataFrame([at(0, "x"), at(2, "x"), at(1, "y")], SCHEMA)
    found = rules.newest_first(rules.container_log(logs, "key", "x")).collect()
    assert [r.ts for r in found] == [START + timedelta(minutes=2), START]


@pytest.mark.parametrize("age_days, tier", [(30, "keep"), (30.9, "keep"), (31, "archive"), (90.9, "archive"), (91, "drop")])
def test_retention_ages_count_in_whole_days(spark, age_days, tier):
    as_of = datetime(2024, 6, 1)
    df = spark.createDataFrame([(as_of - timedelta(days=age_days),)], "ts timestamp_ntz")
    assert df.select(rules.retention_tier(F.col("ts"), as_of)).first()[0] == tier


def test_retention_writes_tiers_and_leaves_out_expired_rows(spark):
    as_of, path = datetime(2024, 6, 1), run_dir(spark, "tiers")
    ages = [1, 31, 50, 91, 200]
    df = spark.createDataFrame([(n, as_of - timedelta(days=n)) for n in ages] + [(0, None)],
                               "age int, ts timestamp_ntz")
    rules.apply_retention(df, path, as_of)
    kept = {(r.age, r.tier) for r in spark.read.parquet(path).collect()}
    assert kept == {(0, "keep"), (1, "keep"), (31, "archive"), (50, "archive")}
    assert any(name.endswith(".gz.parquet") for name in os.listdir(f"{path}/tier=archive"))
    expired = df.where(rules.expired_temp(F.col("ts"), as_of)).collect()
    assert {r.age for r in expired} == {31, 50, 91, 200}
    assert {r.age for r in rules.retained_temp(df, as_of).collect()} == {0, 1}
