"""Customer queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlake.functions.expressions import (
    mean, month_of, order_frequency_segment, percent, previous_month, ratio,
)
from cartlake.operators.joins import left_join_totals, null_safe_left_join
from cartlake.operators.ranking import top_k
from cartlake.schemas import Tables


def customer_demographics(t: Tables, k: int = 10) -> DataFrame:
    """Customers, joined rows by gender, orders and mean order value of the largest countries.

    Gender counts are rows of customers left-joined with orders: a customer counts
    once per order, and once without any. They come from per-customer totals;
    only the distinct orders per country need the order rows themselves.
    """
    people = t.customers.select("customer_id", "country", "gender")
    matched = left_join_totals(
        people, t.orders.select("customer_id", "total_amount"), "customer_id",
        F.count("*").alias("order_rows"),
        F.sum("total_amount").alias("amount"),
        F.count("total_amount").alias("amounts"),
    ).withColumn("joined_rows", F.coalesce("order_rows", F.lit(1)))

    def rows_of(gender: str):
        return F.sum(F.when(F.col("gender") == gender, F.col("joined_rows")).otherwise(0))

    by_country = matched.groupBy("country").agg(
        F.count_distinct("customer_id").alias("total_customers"),
        rows_of("Male").alias("male_customers"),
        rows_of("Female").alias("female_customers"),
        F.round(ratio(F.sum("amount"), F.sum("amounts")), 2).alias("avg_order_value"),
    )
    order_counts = (
        t.orders.select("customer_id", "order_id").join(people.select("customer_id", "country"), "customer_id")
        .groupBy("country").agg(F.count_distinct("order_id").alias("total_orders"))
    )
    return top_k(
        null_safe_left_join(by_country, order_counts, "country").select(
            "country", "total_customers", "male_customers", "female_customers",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"), "avg_order_value"),
        "total_customers", k, "country",
    )


def customer_segments(t: Tables) -> DataFrame:
    """Customers and mean lifetime value by order frequency."""
    joined = left_join_totals(
        t.customers.select("customer_id"), t.orders.select("customer_id", "order_id", "total_amount"), "customer_id",
        F.count("order_id").alias("orders"), F.sum("total_amount").alias("spent"),
    )
    # A repeated customer row contributes its orders again, as the plain join would.
    stats = joined.groupBy("customer_id").agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("order_count"),
        F.coalesce(F.sum("spent"), F.lit(0)).alias("total_spent"),
    )
    return (
        stats.groupBy(order_frequency_segment(F.col("order_count")).alias("customer_segment"))
        .agg(F.count("*").alias("customer_count"), F.round(mean("total_spent"), 2).alias("avg_lifetime_value"))
        .orderBy(F.desc("avg_lifetime_value"), "customer_segment")
    )


def customers_since(customers: DataFrame, since: datetime.date = datetime.date(2023, 1, 1)) -> DataFrame:
    return (
        customers.where(F.col("registration_date") >= F.lit(since))
        .groupBy("country").agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "country")
    )


def top_countries(customers: DataFrame, k: int = 10) -> DataFrame:
    return top_k(customers.groupBy("country").agg(F.count("*").alias("customers")), "customers", k, "country")


def customers_of_country(customers: DataFrame, country: str) -> DataFrame:
    return customers.where(F.col("country") == country)


def monthly_retention(orders: DataFrame) -> DataFrame:
    """Customers active per month and how many of them were active the month before.

    A customer's orders are reduced to the set of their months, which is all that travels:
    each month then looks for its predecessor in the set. Months of orders without a
    customer are listed, but count nobody.
    """
    month = month_of("order_date")
    active = orders.groupBy("customer_id").agg(F.collect_set(F.struct(month.alias("month"))).alias("months"))
    seen = active.select("customer_id", "months", F.explode("months").alias("own")).select(
        "customer_id", F.col("own.month").alias("order_month"),
        (F.col("own.month").isNotNull() & F.array_contains(
            "months", F.struct(previous_month(F.col("own.month")).alias("month")))).alias("returned"))
    return (
        seen.groupBy("order_month")
        .agg(
            F.count("customer_id").alias("active_customers"),
            F.count_if(F.col("returned") & F.col("customer_id").isNotNull()).alias("retained_customers"),
        )
        .withColumn("retention_rate", F.round(percent(F.col("retained_customers"), F.col("active_customers")), 2))
        .orderBy(F.asc_nulls_last("order_month"))
    )
