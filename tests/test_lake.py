"""Loading, layouts, exports, snapshots and upkeep."""

import os
from datetime import date, datetime, timedelta

import pytest
from frames import days, lake, money, rows, values
from pyspark.sql import functions as F

from cartlake.config import LakeConfig, TableLayout
from cartlake.maintenance import tables as upkeep
from cartlake.plans import customers as people
from cartlake.schemas import CUSTOMERS, ORDERS
from cartlake.session import run_dir
from cartlake.sinks import export, snapshots
from cartlake.sources import catalog, files
from cartlake.sources.catalog import lake_tables, load_tables, missing_tables


def config_for(tmp_path, database, **settings):
    return LakeConfig(f"{tmp_path}/archive", f"{tmp_path}/warehouse", database, **settings)


def archive(spark, config, **frames):
    for name, df in frames.items():
        df.write.parquet(config.file_path(name))


def some_orders(spark):
    return rows(spark, "orders", order_id=[1, 2, 3], customer_id=[1, 1, 2], total_amount=money("1.10", None, "3"),
                order_date=days("2023-12-31", "2024-01-01", "2025-06-01"), status=["a,b", 'say "x"', None])


def report(df):
    return {r.table_name: (r.status, r.row_count) for r in df.collect()}


def test_load_is_tolerant_and_idempotent(spark, tmp_path):
    config = config_for(tmp_path, "load_test")
    customers = rows(spark, "customers", customer_id=[1, 2], country=["A", "B"])
    archive(spark, config, customers=customers, orders=some_orders(spark))
    first = report(load_tables(spark, config))
    assert first["customers"] == ("created", 2) and first["orders"] == ("created", 3)
    assert first["products"] == ("missing", None)
    assert set(missing_tables(spark, config)) == {"products", "order_items", "product_reviews"}

    # A later call completes a partial load and leaves existing tables alone.
    archive(spark, config, products=rows(spark, "products", product_id=[1]))
    customers.unionAll(customers).write.mode("overwrite").parquet(config.file_path("customers"))
    second = report(load_tables(spark, config))
    assert second["products"] == ("created", 1) and second["customers"] == ("exists", 2)
    assert os.path.isdir(config.table_path("customers"))


def test_loaded_lake_answers_queries_under_configured_names(spark, tmp_path):
    names = {t: f"shop_{t}" for t in LakeConfig("", "").tables}
    config = config_for(tmp_path, "renamed_lake", tables=names)
    data = lake(spark, customers=rows(spark, "customers", customer_id=[1, 2], country=["A", "A"]),
                orders=some_orders(spark))
    archive(spark, config, **dict(data.items()))
    load_tables(spark, config)
    assert values(people.top_countries(lake_tables(spark, config).customers)) == [("A", 2)]
    catalog.attach(spark, config, use=True)
    try:
        found = files.query_sql(spark, "SELECT count(*) FROM IDENTIFIER(:t) WHERE order_date >= CAST(:d AS DATE)",
                                {"t": "shop_orders", "d": "2024-01-01"})
        assert values(found) == [(2,)]
    finally:
        spark.catalog.setCurrentDatabase("default")


def test_config_from_settings_sections():
    config = LakeConfig.from_mapping({
        "database": {"data_path": "/lake/"},
        "parquet_files": {"base_path": "/in/", "files": {"orders": "o.parquet"}},
        "tables": {"orders": "sales_orders"},
        "analytics": {"top_countries_limit": 3},
    })
    assert config.file_path("orders") == "/in/o.parquet"
    assert config.table_path("orders") == "/lake/sales_orders"
    assert config.top_countries_limit == 3


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    # Keys that are unique on both sides, so no bucket can be hot.
    layout = TableLayout(bucket_by="product_id", buckets=4, sort_by=("product_id",))
    config = config_for(tmp_path, "bucketed", tables={"products": "products", "orders": "product_totals"},
                        files={"products": "products.parquet", "orders": "orders.parquet"},
                        layouts={"products": layout, "orders": layout})
    totals = spark.createDataFrame([(1, 5), (2, 7)], "product_id long, pieces long")
    archive(spark, config, products=rows(spark, "products", product_id=[1, 2, 3]), orders=totals)
    load_tables(spark, config)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = [spark.table(config.qualified(n)) for n in ("products", "orders")]
        joined = t[0].join(t[1], "product_id")
        assert "Exchange" not in upkeep.plan_text(joined, "simple")
        assert joined.count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitioned_layout_prunes(spark, tmp_path):
    config = config_for(tmp_path, "partitioned", layouts={
        "customers": TableLayout(partition_by=("country",), sort_by=("customer_id",))})
    archive(spark, config, customers=rows(spark, "customers", customer_id=[3, 1, 2], country=["A", "A", "B"]))
    load_tables(spark, config)
    found = people.customers_of_country(spark.table(config.qualified("customers")), "A")
    assert "PartitionFilters: [isnotnull(country" in upkeep.plan_text(found, "simple")
    assert found.count() == 2


def test_csv_round_trip(spark):
    orders = some_orders(spark).drop("shipping_country")
    path = run_dir(spark, "csv")
    export.export_csv(orders, path, sep=";")
    back = files.scan_csv(spark, path, sep=";")
    assert dict(back.dtypes) == {"order_id": "int", "customer_id": "int", "order_date": "date",
                                 "total_amount": "double", "status": "string"}
    assert sorted(values(back.select("order_id", "order_date", "status"))) == sorted(
        values(orders.select("order_id", "order_date", "status")))
    typed = files.scan_csv(spark, path, schema=orders.schema, sep=";")
    assert sorted(values(typed)) == sorted(values(orders))


AWKWARD = ["a\nb", "a\r\nb", "back\\slash", "\\n", "\\\n", "\\\\n\\", 'say "x", y', '"', ",", " padded ", "", None, "\\", "\n"]


def test_csv_export_and_import_are_inverse_by_default(spark):
    path = run_dir(spark, "csv-lines")
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "n int, note string")
    export.export_csv(df, path)
    back = files.scan_csv(spark, path, schema=df.schema)
    assert sorted(values(back)) == list(enumerate(AWKWARD))
    lines = [line for r in spark.read.text(path).collect() for line in r.value.splitlines()]
    headers = sum(line == "n,note" for line in lines)
    assert len(lines) - headers == len(AWKWARD)


def test_csv_of_other_origin_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('note,n\n"a\nb\\n",1\n')
    found = files.scan_csv(spark, str(tmp_path), multiline=True, escaped=False)
    assert values(found) == [("a\nb\\n", 1)]


def test_time_slices_prune_folders(spark):
    path = run_dir(spark, "slices")
    export.write_time_slices(some_orders(spark), path, "order_date")
    late = export.read_time_slices(spark, path, "order_date", date(2024, 1, 1))
    assert sorted(r.order_id for r in late.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(slice_year" in upkeep.plan_text(late, "simple")
    assert sorted(p for p in os.listdir(path) if "=" in p) == [f"slice_year={y}" for y in (2023, 2024, 2025)]


def test_texts_get_names_and_round_trip(spark):
    now = datetime(2024, 3, 4, 5, 6, 7)
    requests = spark.createDataFrame(
        [(1, "a", "first"), (2, "a.txt", "second\nline"), (3, None, "none"), (4, "", "empty")],
        "seq int, name string, content string")
    named = export.named_texts(requests, F.col("name"), F.col("content"), now)
    assert [r.filename for r in named.collect()] == [
        "a.txt", "a.txt", "hello_world_20240304_050607.txt", "hello_world_20240304_050607.txt"]
    ordered = export.named_texts(requests, F.col("name"), F.col("content"), now, "seq")
    path = run_dir(spark, "texts")
    export.export_texts(export.last_write_wins(ordered, "seq"), path)
    back = sorted((r.filename, r.content, r.size) for r in files.read_texts(spark, path).collect())
    assert back == [("a.txt", "second\nline", 12), ("hello_world_20240304_050607.txt", "empty", 6)]


@pytest.mark.parametrize("lines", [0, 2_500, 25_000])
def test_a_text_of_any_length_is_read_back_as_one(spark, lines):
    path = run_dir(spark, "long-text")
    text = "".join(f"line {i}\n" for i in range(lines))
    export.export_texts(spark.createDataFrame([("long.txt", text)], "filename string, value string"), path)
    assert [r.content for r in files.read_texts(spark, path).collect()] == [text]


def test_inventory_lists_files_not_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("abc")
    (tmp_path / "sub" / "b.log").write_text("defgh")
    top = files.file_inventory(spark, str(tmp_path))
    assert [(r.filename, r.size) for r in top.collect()] == [("a.txt", 3)]
    everything = files.file_inventory(spark, str(tmp_path), recursive=True)
    assert {r.filename for r in everything.collect()} == {"a.txt", "b.log"}
    assert files.file_inventory(spark, str(tmp_path), recursive=True, pattern="*.log").count() == 1
    sizes = {r.folder.rsplit("/", 1)[1]: (r.file_count, r.total_bytes) for r in
             files.folder_summary(everything).collect()}
    assert sizes == {tmp_path.name: (1, 3), "sub": (1, 5)}


def test_records_and_batches(spark):
    df = spark.range(25).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'x' END AS tag")
    assert export.to_records(df.where("id < 2").orderBy("id")).collect() == [
        ('{"id":0,"tag":"x"}',), ('{"id":1,"tag":null}',)]
    batches = list(export.fetch_batches(df, 10))
    assert [len(b) for b in batches] == [10, 10, 5]
    assert sorted(r.id for b in batches for r in b) == list(range(25))


def test_time_travel(spark):
    root, orders = run_dir(spark, "history"), some_orders(spark)
    moment = datetime(2024, 1, 1)
    snapshots.write_snapshot(spark, root, {"orders": orders.where("order_id = 1")}, moment)
    manifest = snapshots.write_snapshot(spark, root, {"orders": orders}, moment + timedelta(days=5))
    assert values(manifest.select("table_name", "row_count")) == [("orders", 3)]
    assert snapshots.read_as_of(spark, root, "orders", moment + timedelta(days=4)).count() == 1
    assert snapshots.read_as_of(spark, root, "orders", moment + timedelta(days=5)).count() == 3
    with pytest.raises(LookupError):
        snapshots.read_as_of(spark, root, "orders", moment - timedelta(days=1))
    # An unfinished snapshot has data but no manifest entry, so it is not seen.
    orders.limit(0).write.parquet(f"{root}/data/snapshot_ts=20240110_000000/orders")
    assert snapshots.read_as_of(spark, root, "orders", datetime(2024, 2, 1)).count() == 3


def test_schema_evolution(spark):
    path = run_dir(spark, "evolved")
    old, new = some_orders(spark).drop("shipping_country"), some_orders(spark)
    old.write.mode("append").parquet(path)
    new.write.mode("append").parquet(path)
    assert upkeep.read_evolved(spark, path).count() == 6
    assert set(upkeep.read_evolved(spark, path).columns) == set(new.columns)
    assert upkeep.union_evolved(old, new).where("shipping_country IS NULL").count() == 6


def test_compaction_keeps_rows_in_fewer_files(spark):
    source, target = run_dir(spark, "many"), run_dir(spark, "few")
    spark.range(1000).repartition(20).write.parquet(source)
    result = upkeep.compact(spark, source, target)
    assert sorted(r.id for r in result.collect()) == list(range(1000))
    assert files.file_inventory(spark, target).count() == 1
    size = files.file_inventory(spark, source).agg({"size": "sum"}).first()[0]
    upkeep.compact(spark, source, target + "-sized", file_bytes=size // 4)
    assert files.file_inventory(spark, target + "-sized").count() in (4, 5)


def test_compaction_keeps_added_columns_and_partitions(spark):
    source, target = run_dir(spark, "evolved-slices"), run_dir(spark, "evolved-compacted")
    old, new = some_orders(spark).drop("shipping_country"), some_orders(spark).withColumn("order_id", F.col("order_id") + 10)
    for df in (old, new, old.withColumn("order_id", F.col("order_id") + 20)):
        export.time_slices(df, "order_date").write.mode("append").partitionBy("slice_year").parquet(source)
    result = upkeep.compact(spark, source, target)
    assert set(result.columns) == {*new.columns, "slice_year"} and result.count() == 9
    assert sorted(p for p in os.listdir(target) if "=" in p) == [f"slice_year={y}" for y in (2023, 2024, 2025)]
    late = export.read_time_slices(spark, target, "order_date", date(2024, 1, 1))
    assert late.count() == 6 and set(late.columns) == set(new.columns)
    assert "PartitionFilters: [isnotnull(slice_year" in upkeep.plan_text(late, "simple")


def test_evolved_sources_keep_all_columns(spark, tmp_path):
    config = config_for(tmp_path, "evolved_load")
    some_orders(spark).drop("shipping_country").write.parquet(config.file_path("orders"))
    some_orders(spark).write.mode("append").parquet(config.file_path("orders"))
    load_tables(spark, config)
    assert spark.table(config.qualified("orders")).columns == some_orders(spark).columns
    slices = run_dir(spark, "evolved-years")
    for df in (some_orders(spark).drop("status"), some_orders(spark)):
        export.time_slices(df, "order_date").write.mode("append").partitionBy("slice_year").parquet(slices)
    assert "status" in export.read_time_slices(spark, slices, "order_date", date(2024, 1, 1)).columns


def test_a_broken_load_can_be_repeated(spark, tmp_path):
    config = config_for(tmp_path, "broken_load")
    archive(spark, config, orders=some_orders(spark))
    os.makedirs(config.table_path("orders"))
    with open(f"{config.table_path('orders')}/part-left-over.parquet", "w") as file:
        file.write("half a file")
    assert report(load_tables(spark, config))["orders"] == ("created", 3)
    assert report(load_tables(spark, config))["orders"] == ("exists", 3)


def test_integrity(spark):
    data = lake(
        spark,
        customers=rows(spark, "customers", customer_id=[1, 1, 1, None, 2]),
        products=rows(spark, "products", product_id=[1, 2]),
        orders=rows(spark, "orders", order_id=[1, 2, 3, 4], customer_id=[1, 9, 9, None]),
    )
    found = {r.check_name: r.violations for r in upkeep.integrity_report(data).collect()}
    assert found["customers.customer_id unique"] == 1 and found["customers.customer_id not null"] == 1
    assert found["orders.customer_id in customers"] == 2 and found["products.product_id unique"] == 0
    assert len(found) == 15
    assert values(upkeep.duplicate_keys(data.customers, "customer_id")) == [(1, 3)]
    assert values(upkeep.orphan_keys(data.orders, "customer_id", data.customers, "customer_id")) == [(9, 2)]


def test_statistics_and_size(spark, tmp_path):
    config = config_for(tmp_path, "stats_test")
    archive(spark, config, orders=some_orders(spark))
    load_tables(spark, config)
    upkeep.refresh_statistics(spark, config.qualified("orders"))
    recorded = upkeep.recorded_statistics(spark, config.qualified("orders")).first()
    stored = upkeep.database_size(spark, config.warehouse_path).first()
    assert upkeep.database_size(spark, f"file://{config.warehouse_path}/").first() == stored
    assert recorded.row_count == 3 and recorded.total_bytes > 0
    assert stored.table_name == "orders" and stored.total_bytes > 0


def test_stored_result_expires(spark):
    root, now, calls = run_dir(spark, "cache"), datetime(2024, 1, 1), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    def lookup(at):
        return upkeep.stored_result(spark, root, build, timedelta(minutes=5), at).count()

    assert [lookup(now), lookup(now + timedelta(minutes=5)), lookup(now + timedelta(minutes=6))] == [1, 1, 2]


def test_plans_can_be_inspected(spark):
    df = spark.range(10).groupBy("id").count()
    assert "HashAggregate" in upkeep.plan_text(df)


def test_declared_tables_are_read_in_their_types_without_merging_footers(spark, tmp_path):
    config = config_for(tmp_path, "declared_load", schemas={"orders": ORDERS, "customers": CUSTOMERS})
    path = config.file_path("orders")
    some_orders(spark).withColumn("order_id", F.col("order_id").cast("int")).write.parquet(path)
    some_orders(spark).drop("status").write.mode("append").parquet(path)
    assert report(load_tables(spark, config))["orders"] == ("created", 6)
    assert report(load_tables(spark, config))["customers"] == ("missing", None)
    loaded = lake_tables_of(spark, config, "orders")
    assert loaded.schema == ORDERS and loaded.where("status IS NULL").count() == 4
    assert sorted(r.order_id for r in loaded.collect()) == sorted(2 * [r.order_id for r in some_orders(spark).collect()])


@pytest.mark.parametrize("change, says", [
    (lambda d: d.withColumn("extra", F.lit(1)), "extra"),
    (lambda d: d.withColumn("order_id", F.col("order_id").cast("string")), "order_id"),
    (lambda d: d.withColumn("total_amount", F.col("total_amount").cast("decimal(14,4)")), "total_amount"),
])
def test_files_that_a_declared_schema_would_cut_are_an_error(spark, tmp_path, change, says):
    path = str(tmp_path / "orders.parquet")
    some_orders(spark).write.parquet(path)
    change(some_orders(spark)).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match=says):
        catalog.open_source(spark, path, ORDERS)
    catalog.check_declared(spark, path, ORDERS, most_files=0)


def test_only_a_sample_of_footers_is_opened(spark, tmp_path, monkeypatch):
    path, opened = str(tmp_path / "orders.parquet"), []
    some_orders(spark).repartition(9).write.option("maxRecordsPerFile", 1).parquet(path)
    groups = catalog.schema_groups_of
    monkeypatch.setattr(catalog, "schema_groups_of", lambda s, root, files: opened.extend(files) or groups(s, root, files))
    catalog.check_declared(spark, path, ORDERS, most_files=2)
    assert len(opened) == len(set(opened)) == 2


def lake_tables_of(spark, config, logical):
    return spark.table(config.qualified(logical))
