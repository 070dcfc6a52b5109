"""Clustered compaction: the same rows, and predicates on either column that read fewer row groups."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cartlake.maintenance import clustering
from cartlake.maintenance import tables as upkeep
from cartlake.session import run_dir


def row_groups(path, column, value):
    """(row groups whose bounds include the value, all row groups)."""
    hit = total = 0
    for name in glob.glob(f"{path}/**/part-*.parquet", recursive=True):
        file = pq.ParquetFile(name)
        at = file.schema_arrow.get_field_index(column)
        for i in range(file.metadata.num_row_groups):
            bounds = file.metadata.row_group(i).column(at).statistics
            hit, total = hit + (bounds.min <= value <= bounds.max), total + 1
    return hit, total


@pytest.fixture(scope="module")
def points(spark):
    path = run_dir(spark, "points")
    spark.range(40_000).select("id", (F.xxhash64("id") % 1000).alias("x"), (F.xxhash64("id", F.lit(1)) % 5000).alias("y"),
                               F.lit("p").alias("s")).repartition(8).write.parquet(path)
    return path


def test_either_predicate_skips_row_groups(spark, points):
    size = sum(os.path.getsize(f) for f in glob.glob(f"{points}/*.parquet"))
    target = run_dir(spark, "clustered")
    result = upkeep.compact(spark, points, target, file_bytes=size // 64, cluster_by=("x", "y"))
    assert sorted(map(str, result.collect())) == sorted(map(str, spark.read.parquet(points).collect()))
    for column, value in (("x", 17), ("y", -1234)):
        assert row_groups(points, column, value)[0] == 8
        hit, total = row_groups(target, column, value)
        assert total >= 60 and hit <= total / 4
    by_one = run_dir(spark, "sorted")
    spark.read.parquet(points).repartitionByRange(64, "x").write.parquet(by_one)
    assert row_groups(by_one, "y", -1234)[0] >= 60  # a plain sort helps one column only


def test_hot_values_nulls_and_kinds(spark):
    source, target = run_dir(spark, "kinds"), run_dir(spark, "kinds-clustered")
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, 5).alias("hot"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), "id")).alias("text"),
        F.date_add(F.lit("2020-01-01"), (F.col("id") % 700).cast("int")).alias("day"),
        (F.col("id") * 1.5).cast("decimal(10,2)").alias("money"), F.lit(None).cast("double").alias("none"))
    rows.write.parquet(source)
    size = sum(os.path.getsize(f) for f in glob.glob(f"{source}/*.parquet"))
    result = upkeep.compact(spark, source, target, file_bytes=size // 8, cluster_by=("hot", "text", "day", "none"))
    assert sorted(map(str, result.collect())) == sorted(map(str, rows.collect()))
    counts = [r["n"] for r in result.groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert max(counts) < 3 * 3000 / 8


def test_partitions_stay_and_are_clustered_inside(spark, points):
    source, target = run_dir(spark, "parts"), run_dir(spark, "parts-clustered")
    spark.read.parquet(points).withColumn("code", F.concat(F.lit("0"), F.col("id") % 3)).write.partitionBy("code").parquet(source)
    result = upkeep.compact(spark, source, target, file_bytes=20_000, cluster_by=("x", "y"))
    assert result.count() == 40_000 and sorted(os.listdir(target))[-3:] == ["code=00", "code=01", "code=02"]


def test_interleaving():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    row = spark.sql("SELECT 5L AS a, 3L AS b").select(clustering.interleaved([F.col("a"), F.col("b")], 3).alias("z")).first()
    assert row.z == 0b10_01_11


def test_folders_of_other_columns_are_refused(spark):
    source = run_dir(spark, "mixed")
    spark.range(3).write.parquet(f"{source}/a=1")
    spark.range(3).write.parquet(f"{source}/b=1")
    with pytest.raises(ValueError, match="folders of different columns"):
        upkeep.compact(spark, source, run_dir(spark, "mixed-compacted"))


def test_codes_keep_their_form(spark):
    source, target = run_dir(spark, "codes"), run_dir(spark, "codes-compacted")
    codes = ["007", "07", "7", "1e2", "100", "a b/c", None]
    spark.createDataFrame(list(enumerate(codes)), "id long, code string").write.partitionBy("code").parquet(source)
    result = upkeep.compact(spark, source, target)
    assert sorted((r.id, r.code) for r in result.collect()) == list(enumerate(codes))
    typed = upkeep.compact(spark, source, run_dir(spark, "codes-typed"), schema=spark.read.parquet(source).schema)
    assert typed.count() == 7
