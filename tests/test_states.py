"""Episodes and roll-ups that streams keep as mergeable states equal one pass over all events."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_streaming import RULE, SCHEMA, START, arrivals, at

from cartlake.session import run_dir
from cartlake.streaming import episodes, rollups, rules, versions


def listed(df):
    return sorted(map(str, df.collect()))


def batch(spark, batches, schema=SCHEMA):
    return spark.createDataFrame([e for b in batches for e in b], schema)


#: Two attacks that a late event joins, another account, one without a name, and quiet traffic.
BATCHES = [
    [at(0), at(1), at(2, "b"), at(3, None), at(3.5, None)],
    [at(24), at(25), at(26), at(30, "b", 1), at(26, "b")],
    [at(14), at(15.5), at(27, "b")],
    [at(200), at(201), at(201), at(204, None)],
    [at(205, None), at(202)],
]


@pytest.mark.parametrize("full_every", [2, 100])
def test_episodes_of_a_stream_equal_those_of_a_batch(spark, full_every):
    matching = F.col("code") == 4625
    want = episodes.alert_episodes(batch(spark, BATCHES), matching, RULE)
    stream = rules.alerts(rules.watched(arrivals(spark, *BATCHES), "30 minutes"), matching, RULE)
    path = run_dir(spark, "episodes")
    got = episodes.episodes_available(stream, "episodes", path, full_every)
    assert listed(got) == listed(want)
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r.key, []).append((r.begin, r.end, r.peak))
    first, second = sorted(by_key["a"])
    assert first == (datetime(2024, 1, 1, 11, 50), datetime(2024, 1, 1, 12, 40), 4) and second[2] == 4
    if full_every == 2:
        kept = versions.folders_before(spark, path)
        assert len(kept) <= 2 and versions.remove_replaced(spark, path) >= 5  # older changes and full states
        assert versions.folders_before(spark, path) == kept
        assert listed(episodes.current_episodes(spark, path)) == listed(want)


def test_merging_is_associative_and_keeps_gaps(spark):
    def interval(key, begin, end, peak):
        return ("r", "Low", key, datetime(2024, 1, 1, begin), datetime(2024, 1, 1, end), peak)

    rows = [interval("x", 1, 3, 5), interval("x", 2, 4, 9), interval("x", 4, 5, 1), interval("x", 6, 7, 2), interval("x", 1, 2, 3),
            interval(None, 1, 2, 1)]
    table = spark.createDataFrame(rows, episodes.EPISODE)
    want = sorted(map(str, [("x", 1, 5, 9), ("x", 6, 7, 2), (None, 1, 2, 1)]))

    def short(df):
        return sorted(str((r.key, r.begin.hour, r.end.hour, r.peak)) for r in df.collect())

    assert short(episodes.merged(table)) == want
    halves = [episodes.merged(spark.createDataFrame(rows[i::2], episodes.EPISODE)) for i in (0, 1)]
    assert short(episodes.merged(halves[0].unionAll(halves[1]).unionAll(table))) == want
    assert episodes.merged(table.limit(0)).count() == 0


SAMPLES = "ts timestamp, key string, code int"


@pytest.mark.parametrize("full_every", [2, 3, 100])
def test_hours_from_states_equal_hours_from_events(spark, full_every):
    drops = [[at(m, "cpu", m % 50) for m in range(0, 300, 3)], [at(m, "mem", None if m % 2 else m) for m in range(100, 400, 7)],
             [at(1, "cpu", 1000), at(500, None, 5)], [(None, "cpu", 3), at(2, "cpu", -1)], [at(299, "mem", 77)]]
    path = rollups.store_states(arrivals(spark, *drops), "key", "code", full_every=full_every)
    events = batch(spark, drops)
    for grain in rollups.GRAINS:
        want = rollups.figures(rollups.minute_states(events, "key", "code", grain=grain), grain)
        assert listed(rollups.read_grain(spark, path, grain)) == listed(want)
    hours = {(r.window_start, r.metric): r for r in rollups.read_grain(spark, path, "1 hour").collect()}
    first = hours[START, "cpu"]
    values = [m % 50 for m in range(0, 60, 3)] + [1000, -1]
    assert (first.samples, first.maximum, first.average) == (len(values), 1000.0, pytest.approx(sum(values) / len(values)))


def test_rolled_up_batches_are_not_read_again(spark):
    drops = [[at(m, "cpu", m)] for m in range(5)]
    path = rollups.store_states(arrivals(spark, *drops), "key", "code", full_every=2)
    before = {g: listed(rollups.read_grain(spark, path, g)) for g in rollups.GRAINS}
    removed = sum(versions.remove_replaced(spark, f"{path}/{g.replace(' ', '-')}") for g in rollups.GRAINS)
    assert removed == 4 + 4  # minutes of four batches, and the older full state of each grain
    assert os.listdir(f"{path}/1-minute/changes") == ["batch=4"]
    assert {g: listed(rollups.read_grain(spark, path, g)) for g in rollups.GRAINS} == before


def test_a_batch_that_runs_again_changes_nothing(spark):
    path = run_dir(spark, "states")
    states = rollups.minute_states(batch(spark, [[at(1, "cpu", 4), at(2, "cpu", 6)]]), "key", "code")
    for _ in range(2):
        versions.write_changes(states, f"{path}/1-minute", 0)
    assert [(r.samples, r.average) for r in rollups.read_grain(spark, path, "1 day").collect()] == [(2, 5.0)]
    assert rollups.read_grain(spark, run_dir(spark, "nothing"), "1 hour").count() == 0
