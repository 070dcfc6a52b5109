"""Loads of new files only, and folders whose files disagree about types."""

import datetime
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from cartlake.maintenance import evolution
from cartlake.sources import incremental

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/source", f"{tmp_path}/table"


def drop(spark, source, name, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{source}/{name}")


def load(spark, source, target):
    return sorted(tuple(r) for r in incremental.load_new_files(spark, source, target, SCHEMA).collect())


def loaded(spark, target):
    return sorted(map(tuple, incremental.read_loaded(spark, target, SCHEMA).collect()))


def test_only_new_files_are_read(spark, places):
    source, target = places
    drop(spark, source, "a b+%", (1, "x"), (2, "y"))
    assert load(spark, source, target) == [(1, "new", 1)]
    drop(spark, source, "later/deep", (3, "z"))
    assert load(spark, source, target) == [(2, "new", 1)]
    assert load(spark, source, target) == []
    assert loaded(spark, target) == [(1, "x"), (2, "y"), (3, "z")]
    second = spark.read.parquet(f"{target}/rows/load=2")
    assert second.count() == 1  # what was loaded before is not read again


def test_a_changed_file_replaces_its_rows(spark, places):
    source, target = places
    drop(spark, source, "a", (1, "x"), (1, "x"))
    drop(spark, source, "b", (2, "y"))
    load(spark, source, target)
    name = next(p for p in __import__("pathlib").Path(source, "a").glob("part-*.parquet"))
    drop(spark, source, "other", (1, "changed"), (9, "more"))
    new = next(p for p in __import__("pathlib").Path(source, "other").glob("part-*.parquet"))
    shutil.copyfile(new, name)
    for crc in name.parent.glob(".*.crc"):
        crc.unlink()
    shutil.rmtree(f"{source}/other")
    assert load(spark, source, target) == [(2, "changed", 1)]
    assert loaded(spark, target) == [(1, "changed"), (2, "y"), (9, "more")]
    shutil.rmtree(f"{source}/b")  # a file that vanishes keeps its rows
    assert load(spark, source, target) == [] and loaded(spark, target) == [(1, "changed"), (2, "y"), (9, "more")]


def test_a_broken_load_is_done_again(spark, places):
    source, target = places
    drop(spark, source, "a", (1, "x"))
    load(spark, source, target)
    drop(spark, source, "b", (2, "y"))
    load(spark, source, target)
    shutil.rmtree(f"{target}/manifest/load=2")  # as if it had ended before its last step
    assert loaded(spark, target) == [(1, "x")]
    assert load(spark, source, target) == [(2, "new", 1)] and loaded(spark, target) == [(1, "x"), (2, "y")]


def test_nothing_loaded_yet(spark, places):
    assert loaded(spark, places[1]) == [] and incremental.last_load(spark, places[1]) == 0


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_types_widen_without_loss(spark, tmp_path):
    path = f"{tmp_path}/wide"
    day, time = datetime.date(2024, 2, 29), datetime.datetime(2024, 3, 1, 12, 30)
    write(spark, path, [(1, 0.1, day, Decimal("1.25"), 5, [1])], "a int, b float, c date, d decimal(5,2), e short, f array<int>")
    write(spark, path, [(2 ** 40, 0.1, time, 7, 2.5, [2 ** 40], "new")], "a long, b double, c timestamp_ntz, d int, e double, f array<long>, g string")
    write(spark, path, [(3, 0.5, day, Decimal("2.5"), 6, [3])], "a int, b float, c date, d decimal(5,2), e short, f array<int>")
    groups = evolution.schema_groups(spark, path)
    assert sorted(len(g.paths) for g in groups) == [1, 2]
    got = evolution.read_reconciled(spark, path)
    assert dict(got.dtypes) == {"a": "bigint", "b": "double", "c": "timestamp_ntz", "d": "decimal(12,2)", "e": "double",
                                "f": "array<bigint>", "g": "string"}
    rows = {r.a: r for r in got.collect()}
    assert rows[1].c == datetime.datetime(2024, 2, 29) and rows[2 ** 40].c == time
    assert rows[1].b == pytest.approx(0.1, abs=1e-8) and rows[2 ** 40].b == 0.1
    assert rows[2 ** 40].d == Decimal(7) and rows[3].f == [3] and rows[1].g is None and rows[2 ** 40].g == "new"


def test_folders_keep_their_partition_texts(spark, tmp_path):
    path = f"{tmp_path}/parts"
    spark.createDataFrame([(1, "007"), (2, "1e2")], "a int, code string").write.partitionBy("code").parquet(path)
    spark.createDataFrame([(3, "07")], "a long, code string").write.mode("append").partitionBy("code").parquet(path)
    assert sorted((r.a, r.code) for r in evolution.read_reconciled(spark, path).collect()) == [(1, "007"), (2, "1e2"), (3, "07")]


@pytest.mark.parametrize("one, other", [("long", "double"), ("int", "string"), ("decimal(38,0)", "decimal(38,10)"),
                                        ("timestamp", "timestamp_ntz"), ("boolean", "int"), ("decimal(5,2)", "double")])
def test_lossy_changes_are_refused(spark, tmp_path, one, other):
    path = f"{tmp_path}/lossy"
    for kind in (one, other):
        spark.createDataFrame([(None,)], f"amount {kind}").write.mode("append").parquet(path)
    with pytest.raises(evolution.LossyChange, match="column amount"):
        evolution.read_reconciled(spark, path)


def test_widest_types():
    assert evolution.widest(T.ShortType(), T.FloatType()) == T.FloatType()
    assert evolution.widest(T.IntegerType(), T.FloatType()) == T.DoubleType()
    assert evolution.widest(T.LongType(), T.DecimalType(10, 4)) == T.DecimalType(23, 4)
    wide = T.StructType().add("x", T.LongType()).add("y", T.StringType())
    assert evolution.widest(T.StructType().add("x", T.IntegerType()), wide) == wide


def test_nested_fields_widen_and_are_added(spark, tmp_path):
    path = f"{tmp_path}/nested"
    write(spark, path, [((1,),)], "s struct<x:int>")
    write(spark, path, [((2 ** 40, "y"),)], "s struct<x:long,y:string>")
    assert sorted((r.s.x, r.s.y) for r in evolution.read_reconciled(spark, path).collect()) == [(1, None), (2 ** 40, "y")]
