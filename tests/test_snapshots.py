"""Snapshots copy what changed, past states stay readable, and differences are exact."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cartlake.session import run_dir
from cartlake.sinks import snapshots

AT = datetime(2024, 5, 5, 12, 0, 0, 100)
SCHEMA = "k long, year int, v string"
FIRST = [(1, 2020, "a"), (2, 2020, "b"), (2, 2020, "b"), (3, 2021, None), (4, None, ""), (None, 2021, "n")]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def store(spark, root, rows, step, schema=SCHEMA):
    return snapshots.write_snapshot(spark, root, {"t": table(spark, rows, schema)}, AT + timedelta(microseconds=step),
                                    {"t": F.col("year")})


def folders(root):
    return {s.split("=")[1]: sorted(f for f in os.listdir(f"{root}/data/{s}/t") if "=" in f) for s in os.listdir(f"{root}/data")}


def rows_at(spark, root, step):
    return sorted(map(str, snapshots.read_as_of(spark, root, "t", AT + timedelta(microseconds=step)).collect()))


def changes(spark, root, a, b):
    found = snapshots.changes_between(spark, root, "t", "k", AT + timedelta(microseconds=a), AT + timedelta(microseconds=b))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_only_changed_slices_are_copied(spark):
    root = run_dir(spark, "states")
    store(spark, root, FIRST, 0)
    second = [(1, 2020, "a"), (2, 2020, "b"), (2, 2020, "b"), (3, 2021, "now"), (4, None, ""), (5, 2022, "new"), (None, 2021, "n")]
    store(spark, root, second[::-1], 1)  # another order of the rows is no change
    copied = folders(root)
    stamps = sorted(copied)
    assert copied[stamps[0]] == ["_slice=2020", "_slice=2021", "_slice=__none__"]
    assert copied[stamps[1]] == ["_slice=2021", "_slice=2022"]
    assert rows_at(spark, root, 0) == sorted(map(str, table(spark, FIRST).collect()))
    assert rows_at(spark, root, 1) == sorted(map(str, table(spark, second).collect()))
    assert changes(spark, root, 0, 1) == [(3, "updated", 1, 1), (5, "inserted", 0, 1)]
    assert changes(spark, root, 1, 0) == [(3, "updated", 1, 1), (5, "deleted", 1, 0)]
    store(spark, root, second, 2)
    assert len(folders(root)) == 2 and changes(spark, root, 1, 2) == []
    assert rows_at(spark, root, 2) == rows_at(spark, root, 1)


def test_repeated_moved_and_missing_keys(spark):
    root = run_dir(spark, "states")
    store(spark, root, FIRST, 0)
    store(spark, root, [(1, 2021, "a"), (2, 2020, "b"), (3, 2021, None), (4, None, None), (None, 2021, "m")], 1)
    assert changes(spark, root, 0, 1) == sorted([
        (1, "updated", 1, 1), (2, "updated", 2, 1), (4, "updated", 1, 1), (None, "updated", 1, 1)], key=str)


def test_other_columns_and_empty_tables(spark):
    root = run_dir(spark, "states")
    store(spark, root, FIRST, 0)
    wider = [(*r, None) for r in FIRST[:-1]] + [(None, 2021, "n", 7)]
    store(spark, root, wider, 1, SCHEMA + ", w int")
    assert changes(spark, root, 0, 1) == [(None, "updated", 1, 1)]
    assert snapshots.read_as_of(spark, root, "t", AT + timedelta(microseconds=1)).columns == ["k", "year", "v", "w"]
    store(spark, root, [], 2)
    assert rows_at(spark, root, 2) == [] and {r[1] for r in changes(spark, root, 1, 2)} == {"deleted"}
    with pytest.raises(LookupError):
        rows_at(spark, root, -1)


def test_equal_slices_are_not_read_for_a_difference(spark):
    root = run_dir(spark, "states")
    store(spark, root, FIRST, 0)
    store(spark, root, FIRST + [(9, 2020, "z")], 1)
    found = snapshots.changes_between(spark, root, "t", "k", AT, AT + timedelta(microseconds=1))
    read = found.sparkSession.createDataFrame([(f,) for f in found.inputFiles()], "f string")
    assert read.count() > 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "2020" in plan and "2021" not in plan and "__none__" not in plan
    assert [tuple(r) for r in found.collect()] == [(9, "inserted", 0, 1)]
