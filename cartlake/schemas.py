"""Schemas and declared keys of the five lake tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("registration_date", T.DateType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("description", T.StringType()),
])
ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("total_amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("shipping_country", T.StringType()),
])
ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", MONEY),
])
PRODUCT_REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("review_date", T.DateType()),
])

TABLE_SCHEMAS = {
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "product_reviews": PRODUCT_REVIEWS,
}

PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
    "product_reviews": "review_id",
}

# (child table, child column, parent table); the parent column is its primary key.
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("product_reviews", "product_id", "products"),
    ("product_reviews", "customer_id", "customers"),
)


@dataclass(frozen=True)
class Tables:
    """The five relations every business query is written against; a query may need only some."""

    customers: DataFrame | None = None
    products: DataFrame | None = None
    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    product_reviews: DataFrame | None = None

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, getattr(self, name)) for name in TABLE_SCHEMAS]
