"""Registered queries: every operator bound to the benchmark tables in a folder.

Each entry takes (spark, folder) and reads whole tables. Exact decimals become
doubles at this edge only, so that results compare across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlake.config import LakeConfig, TableLayout
from cartlake.functions.expressions import iso_time, line_revenue, month_of
from cartlake.maintenance import evolution, new_keys, slice_stats
from cartlake.maintenance import tables as upkeep
from cartlake.operators.counting import distinct_counts
from cartlake.operators.ranking import best_per_group, with_previous
from cartlake.operators.skew import bucketed_join, salted_join
from cartlake.plans import customers as people
from cartlake.plans import sales
from cartlake.schemas import CUSTOMERS, ORDERS
from cartlake.session import run_dir, session_with
from cartlake.sinks import export, slices, snapshots
from cartlake.sources import catalog, files, fixtures, incremental
from cartlake.streaming import episodes, retention, rollups, rules
from cartlake.streaming.run import append_available, streaming_session, update_available

Query = Callable[[SparkSession, str], DataFrame]

SALES_SINCE = date(1998, 1, 1)
SLICE_SINCE = date(1999, 1, 1)
COUNTRY = "NATION_1"
NAMED_AT = datetime(2024, 3, 4, 5, 6, 7)
LOG_AS_OF = datetime(2024, 1, 31)
WATERMARK_DELAY = "10 minutes"
BATCH_BYTES = 1 << 30  # of a stream's backlog at a time
ACCOUNT_RULE = rules.AlertRule(name="Repeated Errors", severity="High",
                               key="user_id", threshold=1, window="15 minutes", every="5 minutes")
ERROR_RULE = rules.AlertRule(name="Costly Events", severity="Medium",
                             key="event_type", threshold=2, window="30 minutes", every="10 minutes")

QUERIES: dict[str, Query] = {}


def _registered(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        own = session_with(spark, {"spark.sql.session.timeZone": "UTC"})  # event times are naive UTC
        return _comparable(query(own, folder))

    QUERIES[query.__name__] = run
    return query


def _comparable(df: DataFrame) -> DataFrame:
    return df.select([
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema
    ])


# --- business queries -------------------------------------------------------------------------

@_registered
def q01_top_seller_per_country(spark, folder):
    shipped = fixtures.orders(spark, folder, shipping=True)
    return sales.top_seller_per_country(fixtures.tables(spark, folder), shipped=shipped)


@_registered
def q02_customer_demographics(spark, folder):
    return people.customer_demographics(fixtures.tables(spark, folder, "customers", "orders"))


@_registered
def q03_sales_by_category(spark, folder):
    return sales.sales_by_category(fixtures.tables(spark, folder, "products", "order_items"))


@_registered
def q04_customer_segments(spark, folder):
    return people.customer_segments(fixtures.tables(spark, folder, "customers", "orders"))


@_registered
def q05_customers_since(spark, folder):
    return people.customers_since(fixtures.customers(spark, folder))


@_registered
def q06_top_products(spark, folder):
    return sales.top_products(fixtures.tables(spark, folder, "products", "order_items"))


@_registered
def q07_monthly_sales(spark, folder):
    return sales.monthly_sales(fixtures.orders(spark, folder), SALES_SINCE)


@_registered
def q08_monthly_retention(spark, folder):
    return people.monthly_retention(fixtures.orders(spark, folder))


@_registered
def q09_revenue_by_category(spark, folder):
    return sales.revenue_by_category(fixtures.tables(spark, folder, "products", "order_items"))


@_registered
def q10_top_countries(spark, folder):
    return people.top_countries(fixtures.customers(spark, folder))


@_registered
def q11_customers_of_country(spark, folder):
    return people.customers_of_country(fixtures.customers(spark, folder), COUNTRY)


# --- scans, projections, joins, aggregates ----------------------------------------------------

@_registered
def order_line_revenue(spark, folder):
    return fixtures.order_items(spark, folder).select("order_item_id", "product_id", line_revenue().alias("revenue"))


@_registered
def orders_with_buyer(spark, folder):
    o, c = fixtures.orders(spark, folder).alias("o"), fixtures.customers(spark, folder).alias("c")
    return o.join(c, F.col("o.customer_id") == F.col("c.customer_id"), "left").select("o.*", "c.gender", "c.country")


HOT_ORDER = 1


def _lines_with_a_hot_order(spark, folder):
    """Order lines of which one order holds a third."""
    order = F.when(F.col("order_item_id") % 3 == 0, HOT_ORDER).otherwise(F.col("order_id"))
    return fixtures.order_items(spark, folder).withColumn("order_id", order)


@_registered
def lines_of_a_hot_order(spark, folder):
    """A left join of all lines with their orders, the hot order split over several tasks."""
    orders = fixtures.orders(spark, folder).select("order_id", "customer_id", "order_date", "status")
    return salted_join(_lines_with_a_hot_order(spark, folder), orders, "order_id")


@_registered
def bucketed_lines_of_a_hot_order(spark, folder):
    """The same of two bucketed tables."""
    config = _lake(spark, folder)
    catalog.attach(spark, config)
    names, layout = [], TableLayout(bucket_by="order_id", buckets=16)
    orders = fixtures.orders(spark, folder).select("order_id", "customer_id", "order_date", "status")
    for df in (_lines_with_a_hot_order(spark, folder), orders):
        names.append(f"`{config.database}`.bucketed_{uuid.uuid4().hex}")
        catalog.create_table(df, names[-1], layout)
    return bucketed_join(spark.table(names[0]), spark.table(names[1]), "order_id")


@_registered
def order_totals_by_status(spark, folder):
    return (
        fixtures.orders(spark, folder).where(F.col("status").isin("F", "O"))
        .groupBy("status", month_of("order_date").alias("month"))
        .agg(F.count("*").alias("order_count"), F.sum("total_amount").alias("total_amount"))
        .where("order_count > 1")
    )


@_registered
def buyers_of_large_orders(spark, folder):
    return distinct_counts(
        fixtures.orders(spark, folder), "status", "customer_id",
        buyers=F.lit(True), large_order_buyers=F.col("total_amount") >= 250000)


@_registered
def customer_active_months(spark, folder):
    """Every month in which a customer ordered, with the one before."""
    months = fixtures.orders(spark, folder).select("customer_id", month_of("order_date").alias("order_month")).distinct()
    return with_previous(months, "customer_id", "order_month", "previous_active_month")


@_registered
def dearest_products_per_category(spark, folder):
    return best_per_group(fixtures.products(spark, folder), "category", "price")


@_registered
def sql_with_parameters(spark, folder):
    return files.query_sql(
        spark,
        "SELECT gender, count(*) AS customers FROM {people} "
        "WHERE registration_date >= CAST(:since AS DATE) GROUP BY gender",
        args={"since": "2023-01-01"}, people=fixtures.customers(spark, folder),
    )


@_registered
def sql_on_files(spark, folder):
    return files.query_sql(
        spark, f"SELECT p_type AS category, count(*) AS products FROM parquet.`{folder}/part.parquet` GROUP BY p_type")


# --- sources and sinks ------------------------------------------------------------------------

def _archived(spark, folder) -> LakeConfig:
    """The five tables as Parquet source files, and a lake that is still empty."""
    base = run_dir(spark, "lake")
    config = LakeConfig(archive_path=f"{base}/archive", warehouse_path=f"{base}/warehouse",
                        database=f"lake_{uuid.uuid4().hex}")
    for name, df in fixtures.tables(spark, folder, shipping=True).items():
        export.export_parquet(df, config.file_path(name))
    return config


_lakes: dict[tuple[str, str], LakeConfig] = {}


def _lake(spark, folder) -> LakeConfig:
    """A loaded lake, built once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _lakes:
        config = _archived(spark, folder)
        catalog.load_tables(spark, config)
        _lakes[key] = config
    return _lakes[key]


@_registered
def load_configured_tables(spark, folder):
    config = _archived(spark, folder)
    first = catalog.load_tables(spark, config).select("table_name", F.col("status").alias("first_load"))
    second = catalog.load_tables(spark, config)
    return second.join(first, "table_name").select(
        "table_name", "first_load", F.col("status").alias("second_load"), "row_count")


@_registered
def import_parquet_table(spark, folder):
    config = _lake(spark, folder)
    catalog.attach(spark, config)
    name = f"`{config.database}`.new_customers"
    catalog.create_table(files.scan_parquet(spark, config.file_path("customers"), CUSTOMERS), name)
    return spark.table(name)


@_registered
def export_parquet(spark, folder):
    path = run_dir(spark, "customers-export")
    export.export_parquet(fixtures.customers(spark, folder), path)
    return files.scan_parquet(spark, path, CUSTOMERS)


@_registered
def export_and_import_csv(spark, folder):
    path = run_dir(spark, "orders-csv")
    export.export_csv(fixtures.orders(spark, folder).where(F.col("order_date") >= F.lit(SLICE_SINCE)), path)
    return files.scan_csv(spark, path)


@_registered
def csv_of_awkward_texts(spark, folder):
    """Line breaks, quotes, delimiters, empty and NULL texts through CSV with default options."""
    path = run_dir(spark, "texts-csv")
    tag = F.concat(F.lit(' "'), F.col("source"), F.lit('", \\n\\\r'))
    texts = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", F.when(F.col("lang") == "de", "").when(F.col("lang") != "fr", F.concat("text", tag)).alias("text"))
    export.export_csv(texts, path)
    return files.scan_csv(spark, path, schema=texts.schema)


@_registered
def customers_as_records(spark, folder):
    return export.to_records(people.top_countries(fixtures.customers(spark, folder)))


@_registered
def time_sliced_orders(spark, folder):
    path = run_dir(spark, "orders-by-year")
    export.write_time_slices(fixtures.orders(spark, folder), path, "order_date")
    return export.read_time_slices(spark, path, "order_date", SLICE_SINCE)


PLAIN_ORDERS = T.StructType([f for f in ORDERS if f.name != "shipping_country"])


def _sliced_orders(spark, folder) -> str:
    path = run_dir(spark, "orders-by-year")
    export.write_time_slices(fixtures.orders(spark, folder), path, "order_date")
    return path


@_registered
def rewritten_slice_of_orders(spark, folder):
    """One year written again with other amounts, from its own rows; the other years keep their files."""
    path = _sliced_orders(spark, folder)
    year = slices.read_slices(spark, path, PLAIN_ORDERS, [1998]).drop(slices.SLICE)
    slices.replace_slices(year.withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(12,2)")), path, "order_date")
    return slices.read_slices(spark, path, PLAIN_ORDERS)


@_registered
def rewritten_period_of_orders(spark, folder):
    """A period across two years replaced by half of its orders."""
    path, orders = _sliced_orders(spark, folder), fixtures.orders(spark, folder)
    since, until = date(1997, 7, 1), date(1998, 4, 1)
    half = orders.where((F.col("order_date") >= F.lit(since)) & (F.col("order_date") < F.lit(until)) & (F.col("order_id") % 2 == 0))
    slices.rewrite_period(half, path, "order_date", since, until, PLAIN_ORDERS)
    return slices.read_slices(spark, path, PLAIN_ORDERS)


@_registered
def upserted_orders(spark, folder):
    """Orders that change their status and date, new ones and deleted ones, merged into the slices."""
    path, orders = _sliced_orders(spark, folder), fixtures.orders(spark, folder)
    moved = orders.where("order_id % 50 = 0").withColumn("order_date", F.add_months("order_date", 12)).withColumn("status", F.lit("M"))
    new = orders.where("order_id % 75 = 1").withColumn("order_id", -F.col("order_id"))
    slices.upsert(moved.unionByName(new), path, "order_id", "order_date", PLAIN_ORDERS, deleted=orders.where("order_id % 60 = 7"))
    return slices.read_slices(spark, path, PLAIN_ORDERS)


@_registered
def incrementally_loaded_orders(spark, folder):
    """Three drops of files, loaded one after another; the last load is called again and finds nothing."""
    base, orders = run_dir(spark, "drops"), fixtures.orders(spark, folder)
    source, target = f"{base}/source", f"{base}/table"
    for drop in range(3):
        orders.where(F.col("order_id") % 3 == drop).write.parquet(f"{source}/drop-{drop}")
        incremental.load_new_files(spark, source, target, PLAIN_ORDERS)
    incremental.load_new_files(spark, source, target, PLAIN_ORDERS)
    return incremental.read_loaded(spark, target, PLAIN_ORDERS)


@_registered
def widened_orders(spark, folder):
    """Files in which ids were int, amounts float and dates without time, and files with wider types."""
    path, orders = run_dir(spark, "widened"), fixtures.orders(spark, folder)
    old = F.col("order_date") < F.lit(SLICE_SINCE)
    orders.where(old).select(F.col("order_id").cast("int"), F.col("customer_id").cast("int"), "order_date",
                             F.col("total_amount").cast("float"), "status").write.mode("append").parquet(path)
    orders.where(~old).select("order_id", "customer_id", F.col("order_date").cast("timestamp_ntz"),
                              F.col("total_amount").cast("double"), "status").write.mode("append").parquet(path)
    return evolution.read_reconciled(spark, path)


@_registered
def orders_loaded_as_declared(spark, folder):
    """Files of narrower types and without a column, loaded in the declared types; no footers are merged to plan."""
    base, orders = run_dir(spark, "declared"), fixtures.orders(spark, folder)
    config = LakeConfig(f"{base}/archive", f"{base}/warehouse", f"lake_{uuid.uuid4().hex}",
                        files={"orders": "orders"}, schemas={"orders": PLAIN_ORDERS})
    old, path = F.col("order_date") < F.lit(SLICE_SINCE), config.file_path("orders")
    orders.where(old).withColumn("order_id", F.col("order_id").cast("int")).drop("status").write.mode("append").parquet(path)
    orders.where(~old).write.mode("append").parquet(path)
    catalog.load_tables(spark, config).count()
    return spark.table(config.qualified("orders"))


def _written_texts(spark, folder) -> str:
    """All documents written under names of which the last one wins; some names are missing."""
    path = run_dir(spark, "texts")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    name = F.when(F.col("lang") != "es", F.concat("source", F.lit("-"), "lang"))
    named = documents.withColumn("content", F.coalesce("text", F.lit("")))
    requests = named.select("doc_id", name.alias("name"), "content")
    written = export.named_texts(requests, F.col("name"), F.col("content"), NAMED_AT, "doc_id")
    export.export_texts(export.last_write_wins(written, "doc_id"), path)
    return path


@_registered
def export_and_read_texts(spark, folder):
    return files.read_texts(spark, _written_texts(spark, folder)).select(
        "filename", F.length("content").alias("characters"), F.md5(F.col("content").cast("binary")).alias("digest"))


@_registered
def file_inventory(spark, folder):
    """Name folder and size of the written text files."""
    listed = files.file_inventory(spark, _written_texts(spark, folder), recursive=True)
    return listed.select(F.regexp_extract("path", "/filename=([^/]*)/", 1).alias("filename"), "size")


@_registered
def folder_summary(spark, folder):
    """Files and bytes per folder of the written texts."""
    listed = files.file_inventory(spark, _written_texts(spark, folder), recursive=True)
    return files.folder_summary(listed).select(
        F.regexp_extract("folder", "filename=([^/]*)$", 1).alias("filename"), "file_count", "total_bytes")


@_registered
def database_size(spark, folder):
    """Files and bytes per table folder, for a store of text files."""
    sizes = upkeep.database_size(spark, _written_texts(spark, folder))
    return sizes.select(F.substring_index("table_name", "=", -1).alias("table_name"), "file_count", "total_bytes")


@_registered
def event_iso_times(spark, folder):
    return fixtures.events(spark, folder).select("event_id", iso_time(F.col("ts")).alias("modified"))


@_registered
def evolved_slices_compacted(spark, folder):
    """A table that gained a column, written in slices, compacted and read back since a date."""
    slices, compacted = run_dir(spark, "evolved-slices"), run_dir(spark, "evolved-compacted")
    recent = F.col("order_date") >= F.lit(date(2000, 1, 1))
    old, new = fixtures.orders(spark, folder), fixtures.orders(spark, folder, shipping=True)
    for part in (old.where(~recent), new.where(recent)):
        export.time_slices(part, "order_date").write.mode("append").partitionBy("slice_year").parquet(slices)
    upkeep.compact(spark, slices, compacted)
    return export.read_time_slices(spark, compacted, "order_date", SLICE_SINCE)


# --- table maintenance ------------------------------------------------------------------------

@_registered
def table_stats(spark, folder):
    return upkeep.table_stats(fixtures.tables(spark, folder, shipping=True))


@_registered
def analyzed_row_counts(spark, folder):
    config = _lake(spark, folder)
    rows = []
    for name in config.tables:
        upkeep.refresh_statistics(spark, config.qualified(name))
        recorded = upkeep.recorded_statistics(spark, config.qualified(name))
        rows.append(recorded.select(F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionAll, rows)


@_registered
def order_statistics_from_slices(spark, folder):
    """Exact figures of all orders from the statistics of their years; distinct counts and quantiles are tested apart."""
    orders = fixtures.orders(spark, folder)
    path = run_dir(spark, "slice-stats")
    for part in (F.year("order_date") < 1997, F.year("order_date") >= 1997):
        slice_stats.slice_statistics(orders.where(part), F.year("order_date")).write.mode("append").parquet(path)
    found = slice_stats.united(spark.read.schema(slice_stats.STATS).parquet(path), orders.schema)
    return found.select("column", "rows", "nulls", "least", "greatest")


@_registered
def integrity_report(spark, folder):
    return upkeep.integrity_report(fixtures.tables(spark, folder))


@_registered
def duplicated_item_ids(spark, folder):
    return upkeep.duplicate_keys(fixtures.order_items(spark, folder), "order_item_id")


@_registered
def orphaned_order_ids(spark, folder):
    t = fixtures.tables(spark, folder, "orders", "order_items")
    return upkeep.orphan_keys(t.order_items, "order_id", t.orders, "order_id")


@_registered
def orphans_among_new_items(spark, folder):
    """Order ids of new lines without an order, against a stored filter of the known orders' keys."""
    t = fixtures.tables(spark, folder, "orders", "order_items")
    known = t.orders.where("order_id % 100 <> 3")
    bits, path = new_keys.filter_bits(known.count()), run_dir(spark, "key-filter")
    old, late = known.where("order_id % 2 = 0"), known.where("order_id % 2 = 1")
    new_keys.united(*(new_keys.key_filter(part, "order_id", bits) for part in (old, late))).write.parquet(path)
    new = t.order_items.where("order_item_id % 4 = 1")
    return new_keys.new_orphans(new, "order_id", known, "order_id", spark.read.parquet(path), bits)


@_registered
def compacted_order_items(spark, folder):
    source, target = run_dir(spark, "items"), run_dir(spark, "items-compacted")
    fixtures.order_items(spark, folder).write.parquet(source)
    return upkeep.compact(spark, source, target)


@_registered
def compacted_folders_keep_their_names(spark, folder):
    """Partition folders named 007, 1e2 and the like through a compaction."""
    source, target = run_dir(spark, "coded"), run_dir(spark, "coded-compacted")
    code = F.element_at(F.array(*(F.lit(c) for c in ("007", "07", "7", "1e2", "100", "0x1F", "2024-01-01"))),
                        (F.col("order_id") % 7 + 1).cast("int"))
    fixtures.orders(spark, folder).withColumn("code", code).write.partitionBy("code").parquet(source)
    return upkeep.compact(spark, source, target)


@_registered
def clustered_orders(spark, folder):
    """Orders compacted along a curve of customer and date."""
    source, target = run_dir(spark, "orders"), run_dir(spark, "orders-clustered")
    fixtures.orders(spark, folder).write.parquet(source)
    return upkeep.compact(spark, source, target, file_bytes=1 << 16, cluster_by=("customer_id", "order_date"))


@_registered
def snapshot_manifest(spark, folder):
    tables = dict(fixtures.tables(spark, folder, shipping=True).items())
    written = snapshots.write_snapshot(spark, run_dir(spark, "backup"), tables, datetime(2024, 1, 1))
    return snapshots.snapshot_counts(written).drop("snapshot_ts")


@_registered
def orders_as_of(spark, folder):
    root, orders = run_dir(spark, "history"), fixtures.orders(spark, folder)
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    snapshots.write_snapshot(spark, root, {"orders": orders.where(F.col("order_date") < F.lit(SLICE_SINCE))}, early)
    snapshots.write_snapshot(spark, root, {"orders": orders}, late)
    return snapshots.read_as_of(spark, root, "orders", late - timedelta(days=1))


def _two_states(spark, folder) -> str:
    """Snapshots of the orders by year: of January, and of February when some had changed, gone or come."""
    root, orders = run_dir(spark, "states"), fixtures.orders(spark, folder)
    late = F.year("order_date") >= 1998
    changed = orders.where(~late | (F.col("order_id") % 40 != 3)).withColumn(
        "status", F.when(late & (F.col("order_id") % 30 == 0), "X").otherwise(F.col("status")))
    added = orders.where("order_id % 90 = 5").withColumn("order_id", -F.col("order_id"))
    for at, state in ((datetime(2024, 1, 1), orders), (datetime(2024, 2, 1), changed.unionByName(added))):
        snapshots.write_snapshot(spark, root, {"orders": state}, at, {"orders": F.year("order_date")})
    return root


@_registered
def changed_orders(spark, folder):
    """Orders that differ between two snapshots; years without a change are neither stored twice nor compared."""
    return snapshots.changes_between(spark, _two_states(spark, folder), "orders", "order_id",
                                     datetime(2024, 1, 15), datetime(2024, 2, 15))


@_registered
def orders_after_changes(spark, folder):
    """The later state, put together from files of both snapshots."""
    return snapshots.read_as_of(spark, _two_states(spark, folder), "orders", datetime(2024, 2, 15))


@_registered
def evolved_orders(spark, folder):
    path = run_dir(spark, "orders-evolved")
    recent = F.col("order_date") >= F.lit(SLICE_SINCE)
    fixtures.orders(spark, folder).where(~recent).write.mode("append").parquet(path)
    fixtures.orders(spark, folder, shipping=True).where(recent).write.mode("append").parquet(path)
    return upkeep.read_evolved(spark, path)


@_registered
def union_of_evolved_orders(spark, folder):
    """Frames with different columns as one table; no file footer is read to find the columns."""
    recent = F.col("order_date") >= F.lit(SLICE_SINCE)
    return upkeep.union_evolved(fixtures.orders(spark, folder).where(~recent),
                                fixtures.orders(spark, folder, shipping=True).where(recent))


@_registered
def stored_revenue_by_category(spark, folder):
    root, now = run_dir(spark, "stored-revenue"), datetime.now()
    tables = fixtures.tables(spark, folder, "products", "order_items")

    def lookup(at):
        return upkeep.stored_result(spark, root, lambda: sales.revenue_by_category(tables), timedelta(minutes=5), at)

    lookup(now)
    return lookup(now + timedelta(minutes=1))


# --- event rules, in batch and as streams -----------------------------------------------------

def _is_error():
    return F.col("event_type") == "error"


def _is_costly():
    return F.col("value") >= 100


def _watched(spark, folder):
    session = streaming_session(spark, state_partitions=spark.sparkContext.defaultParallelism)
    return rules.watched(fixtures.event_stream(session, folder, BATCH_BYTES), WATERMARK_DELAY)


@_registered
def account_alerts(spark, folder):
    return rules.alerts(fixtures.events(spark, folder), _is_error(), ACCOUNT_RULE)


@_registered
def account_alerts_stream(spark, folder):
    return update_available(
        rules.alerts(_watched(spark, folder), _is_error(), ACCOUNT_RULE), "account-alerts", rules.ALERT_KEYS)


@_registered
def error_alerts(spark, folder):
    return rules.alerts(fixtures.events(spark, folder), _is_costly(), ERROR_RULE)


@_registered
def error_alerts_stream(spark, folder):
    return update_available(
        rules.alerts(_watched(spark, folder), _is_costly(), ERROR_RULE), "error-alerts", rules.ALERT_KEYS)


def _event_drops(spark, folder) -> str:
    """The events in four files, by time; events up to six minutes before a border come in the later file."""
    path = run_dir(spark, "event-drops")
    events = spark.read.parquet(f"{folder}/events.parquet")
    late = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 7 * 60_000_000
    drop = F.least(F.greatest(F.floor((late / 1_000_000 - 1704067200) / (8 * 86400)), F.lit(0)), F.lit(3)).cast("int")
    for number in range(4):
        events.where(drop == number).coalesce(1).write.mode("append").parquet(path)
    return path


def _dropped_events(spark, folder):
    session = streaming_session(spark, state_partitions=spark.sparkContext.defaultParallelism)
    return fixtures.event_stream_of(session, folder, _event_drops(spark, folder))


@_registered
def alert_episodes(spark, folder):
    """One row per attack."""
    return episodes.alert_episodes(fixtures.events(spark, folder), _is_costly(), ERROR_RULE)


@_registered
def alert_episodes_stream(spark, folder):
    """The same from a stream of four batches, with late events."""
    stream = rules.watched(_dropped_events(spark, folder), WATERMARK_DELAY)
    return episodes.episodes_available(rules.alerts(stream, _is_costly(), ERROR_RULE), "alert-episodes")


@_registered
def hourly_metrics_from_states(spark, folder):
    """Hours merged from stored minute states, of which two batches are rolled up and two are not."""
    path = rollups.store_states(_dropped_events(spark, folder), "event_type", "value", full_every=2)
    return rollups.read_grain(spark, path, "1 hour")


@_registered
def metric_rollup(spark, folder):
    return rules.metric_rollup(fixtures.events(spark, folder), "event_type", "value")


@_registered
def metric_rollup_stream(spark, folder):
    return update_available(rules.metric_rollup(_watched(spark, folder), "event_type", "value"), "metric-rollup",
                            ["window_start", "window_end", "event_type"])


@_registered
def request_counts(spark, folder):
    return rules.request_counts(fixtures.events(spark, folder))


@_registered
def request_counts_stream(spark, folder):
    return update_available(rules.request_counts(_watched(spark, folder)), "request-counts",
                            ["window_start", "window_end"])


@_registered
def container_log(spark, folder):
    return rules.newest_first(rules.container_log(fixtures.events(spark, folder), "event_type", "click"), "event_id")


@_registered
def container_log_stream(spark, folder):
    log = rules.container_log(fixtures.event_stream(spark, folder, BATCH_BYTES), "event_type", "click")
    followed = log.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return append_available(followed, "container-log")


@_registered
def log_retention_tiers(spark, folder):
    tier = rules.retention_tier(F.col("ts"), LOG_AS_OF, archive_days=10, drop_days=20)
    return fixtures.events(spark, folder).groupBy(tier.alias("tier")).agg(F.count("*").alias("events"))


@_registered
def retained_logs(spark, folder):
    path = run_dir(spark, "retained-logs")
    rules.apply_retention(fixtures.events(spark, folder), path, LOG_AS_OF, archive_days=10, drop_days=20)
    return spark.read.parquet(path)


@_registered
def retained_daily_logs(spark, folder):
    """The same from logs stored by day, retired twice: days are moved or deleted, not read."""
    path, events = run_dir(spark, "daily-logs"), fixtures.events(spark, folder)
    retention.write_days(events, path)
    for as_of in (LOG_AS_OF - timedelta(hours=77), LOG_AS_OF):
        retention.retire(spark, path, events.schema, as_of, archive_days=10, drop_days=20)
    return retention.read_tiers(spark, path, events.schema, LOG_AS_OF, archive_days=10, drop_days=20)


@_registered
def unexpired_temp_events(spark, folder):
    return rules.retained_temp(fixtures.events(spark, folder), LOG_AS_OF)
