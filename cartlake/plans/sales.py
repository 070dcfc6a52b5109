"""Product and revenue queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import line_revenue, mean, month_of, percent, ratio
from cartlake.operators.joins import attach_to_totals, null_safe_left_join, only_keys_of
from cartlake.operators.ranking import best_per_group, top_k
from cartlake.operators.staging import staged
from cartlake.schemas import Tables


def product_sales(t: Tables, shipped: DataFrame | None = None) -> DataFrame:
    """Sales per shipping country and product; ``shipped`` as in ``top_seller_per_country``.

    ``total_sales`` sums the order total once per order line, so an order with
    several lines counts several times. That is the published definition; revenue
    by line is ``quantity * unit_price`` (see ``top_products``).
    """
    shipped = t.orders if shipped is None else shipped
    lines = shipped.select("order_id", F.col("shipping_country").alias("country"), "total_amount").join(
        t.order_items.select("order_id", "product_id", "quantity"), "order_id")
    totals = lines.groupBy("country", "product_id").agg(
        F.sum("total_amount").alias("total_sales"), F.sum("quantity").alias("total_quantity"))
    names = t.products.select("product_id", "product_name")
    return attach_to_totals(totals, names, "product_id", ["total_sales", "total_quantity"])


def buyer_profile(lines: DataFrame, t: Tables) -> DataFrame:
    """Distinct buyers per product and the share of order lines by gender.

    The percentages divide lines by distinct buyers, so repeat purchases can take
    them beyond 100.
    """
    # Lines are counted per (product, customer) before customers are joined, so a
    # customer with very many lines is one row per product by then.
    bought = (
        lines.join(t.orders.select("order_id", "customer_id"), "order_id")
        .groupBy("product_id", "customer_id").agg(F.count("*").alias("lines"))
        .join(t.customers.select("customer_id", "gender"), "customer_id")
    )

    def lines_of(gender: str):
        return F.sum(F.when(F.col("gender") == gender, F.col("lines")).otherwise(0))

    return bought.groupBy("product_id").agg(
        F.count_distinct("customer_id").alias("customer_count"),
        lines_of("Male").alias("male_lines"),
        lines_of("Female").alias("female_lines"),
    ).select(
        "product_id",
        "customer_count",
        percent(F.col("male_lines"), F.col("customer_count")).alias("male_percent"),
        percent(F.col("female_lines"), F.col("customer_count")).alias("female_percent"),
    )


def top_seller_per_country(t: Tables, top_countries: int = 10, shipped: DataFrame | None = None) -> DataFrame:
    """The best-selling product(s) of the countries with the strongest single product.

    Only sales need all rows. Ratings and buyers are looked up for the winners
    alone, which are staged, so the optimizer sees how small they are and picks
    their rows while it scans reviews and order lines.

    ``shipped`` is the orders with their shipping country, for lakes where looking
    the country up costs a join that the buyers should not pay for again.
    """
    best = staged(best_per_group(product_sales(t, shipped), "country", "total_sales"), "best-sellers")
    countries = top_k(
        best.groupBy("country").agg(F.max("total_sales").alias("max_sales")), "max_sales", top_countries, "country")
    winners = best.join(countries, "country", "left_semi")

    lines = only_keys_of(t.order_items.select("order_id", "product_id"), winners, "product_id")
    ratings = (
        only_keys_of(t.product_reviews.select("product_id", "rating"), winners, "product_id")
        .groupBy("product_id").agg(mean("rating").alias("avg_rating"))
    )
    return (
        winners.join(ratings, "product_id", "left")
        .join(buyer_profile(lines, t), "product_id", "left")
        .select("country", "product_name", "total_sales", "total_quantity", "avg_rating",
                "customer_count", "male_percent", "female_percent")
        .orderBy(F.desc("total_sales"), "country", "product_name")
    )


def sales_by_category(t: Tables) -> DataFrame:
    """Orders, quantity, revenue and mean price per product category.

    Sums are reduced to one row per product before categories are joined. Counting
    distinct orders needs every line, but shuffles only two narrow columns that way
    instead of carrying all running sums along.
    """
    categories = t.products.select("product_id", "category")
    per_product = t.order_items.groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum(line_revenue()).alias("revenue"),
        F.sum("unit_price").alias("prices"),
        F.count("unit_price").alias("priced_lines"),
    )
    sums = per_product.join(categories, "product_id").groupBy("category").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.round(F.sum("revenue"), 2).alias("total_revenue"),
        F.round(ratio(F.sum("prices"), F.sum("priced_lines")), 2).alias("avg_price"),
    )
    order_counts = (
        t.order_items.select("product_id", "order_id").join(categories, "product_id")
        .groupBy("category").agg(F.count_distinct("order_id").alias("total_orders"))
    )
    return (
        null_safe_left_join(sums, order_counts, "category")
        .select("category", "total_orders", "total_quantity_sold", "total_revenue", "avg_price")
        .orderBy(F.desc("total_revenue"), "category")
    )


def _revenue_per_product(t: Tables) -> DataFrame:
    return t.order_items.groupBy("product_id").agg(F.sum(line_revenue()).alias("total_revenue"))


def top_products(t: Tables, k: int = 20) -> DataFrame:
    """Products by line revenue, with their number of distinct orders.

    The ranking needs revenue only; distinct orders are counted for the k winners
    instead of shuffling every (product, order) pair.
    """
    labels = t.products.select("product_id", "product_name", "category")
    revenue = attach_to_totals(_revenue_per_product(t), labels, "product_id", ["total_revenue"])
    best = staged(top_k(revenue, "total_revenue", k, "product_id", "product_name", "category"), "top-products")
    counts = (
        only_keys_of(t.order_items.select("product_id", "order_id"), best, "product_id")
        .groupBy("product_id").agg(F.count_distinct("order_id").alias("order_count"))
    )
    return (
        best.join(counts, "product_id")
        .orderBy(F.desc("total_revenue"), "product_id", "product_name", "category")
        .select("product_name", "category", "total_revenue", "order_count")
    )


def revenue_by_category(t: Tables) -> DataFrame:
    labels = t.products.select("product_id", "category")
    return (
        _revenue_per_product(t).join(labels, "product_id")
        .groupBy("category").agg(F.sum("total_revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
    )


def monthly_sales(orders: DataFrame, since: datetime.date = datetime.date(2023, 1, 1)) -> DataFrame:
    """Orders, revenue and mean order value per month from ``since`` on."""
    return (
        orders.where(F.col("order_date") >= F.lit(since))
        .groupBy(month_of("order_date").alias("month"))
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("total_amount").alias("total_revenue"),
            mean("total_amount").alias("avg_order_value"),
        )
        .orderBy("month")
    )
