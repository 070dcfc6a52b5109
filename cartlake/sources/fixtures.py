"""Maps order/line-item style benchmark tables onto the five lake tables.

Dimension joins are left joins on unique keys, so every fact row survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartlake.schemas import Tables

_schemas: dict[str, StructType] = {}


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one table; its schema is read from the footers once and then remembered."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _cents(count: str) -> str:
    """SQL for a whole number of cents as exact money (casting a double would parse its printed form)."""
    return f"CAST(CAST({count} AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2))"


def _money(amount: str) -> str:
    return _cents(f"floor({amount} * 100 + 0.5)")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    nations = _read(spark, folder, "nation").select("n_nationkey", "n_name")
    return _read(spark, folder, "customer").join(nations, F.expr("c_nationkey = n_nationkey"), "left").selectExpr(
        "c_custkey AS customer_id",
        "c_name AS first_name",
        "c_mktsegment AS last_name",
        "concat(c_name, '@example.org') AS email",
        "CASE c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender",
        "n_name AS country",
        "date_add(DATE'2022-01-01', CAST(c_custkey * 37 % 730 AS INT)) AS registration_date",
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        "p_type AS category",
        f"{_money('p_retailprice')} AS price",
        "concat_ws(' ', p_brand, p_name) AS description",
    )


def orders(spark: SparkSession, folder: str, shipping: bool = False) -> DataFrame:
    """Orders; ``shipping`` adds the customer's country, at the price of a join.

    Both sides of that join are plain scans with the orders on the left, the shape
    in which adaptive execution can split a customer with very many orders.
    """
    orders = _read(spark, folder, "orders")
    columns = [
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        f"{_money('o_totalprice')} AS total_amount",
        "o_orderstatus AS status",
    ]
    if not shipping:
        return orders.selectExpr(*columns)
    nations = _read(spark, folder, "nation").select("n_nationkey", "n_name")
    homes = _read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(homes, F.expr("o_custkey = c_custkey"), "left")
        .join(nations, F.expr("c_nationkey = n_nationkey"), "left")
        .selectExpr(*columns, "n_name AS shipping_country")
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS order_item_id",
        "l_orderkey AS order_id",
        "l_partkey AS product_id",
        "CAST(l_quantity AS INT) AS quantity",
        # Rounded down to whole cents: half cents differ between engines.
        f"{_cents('floor(l_extendedprice * 100 / l_quantity)')} AS unit_price",
    )


def product_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "events").selectExpr(
        "event_id AS review_id",
        "event_id div 6 AS product_id",
        "user_id AS customer_id",
        "CAST(floor(value) AS INT) % 5 + 1 AS rating",
        "event_type AS review_text",
        "CAST(ts AS DATE) AS review_date",
    )


def tables(spark: SparkSession, folder: str, *names: str, shipping: bool = False) -> Tables:
    """The named tables, or all of them."""
    build = {
        "customers": lambda: customers(spark, folder),
        "products": lambda: products(spark, folder),
        "orders": lambda: orders(spark, folder, shipping),
        "order_items": lambda: order_items(spark, folder),
        "product_reviews": lambda: product_reviews(spark, folder),
    }
    return Tables(**{name: build[name]() for name in names or build})


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Log events; the measured value is exact to the cent."""
    return _log_columns(_read(spark, folder, "events"))


def event_stream(spark: SparkSession, folder: str, batch_bytes: int | None = None) -> DataFrame:
    """The same events as a file stream; event time becomes a zoned timestamp for the watermark.

    ``batch_bytes`` bounds what one batch reads of a backlog (whole files, one at least).
    """
    schema = _read(spark, folder, "events").schema
    reader = spark.readStream.schema(schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    # A file stream wants a folder or a glob; the brackets turn the one name into a glob.
    stream = reader.parquet(f"{folder}/event[s].parquet")
    return _log_columns(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream_of(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The files of events in ``path`` as a stream, one file per batch in the order in which they were written."""
    stream = spark.readStream.schema(_read(spark, folder, "events").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _log_columns(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def _log_columns(df: DataFrame) -> DataFrame:
    return df.selectExpr("event_id", "ts", "user_id", "event_type", f"{_money('value')} AS value")
