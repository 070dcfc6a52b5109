"""Cases the shared data does not contain: ties, fan-out, repeats, unmatched and NULL keys."""

from datetime import date
from decimal import Decimal

import pytest
from frames import days, lake, money, rows, values

from cartlake.plans import customers as people
from cartlake.plans import sales


@pytest.fixture
def shop(spark):
    """Two countries. In A, products 1 and 2 tie; order 1 has two lines of product 1."""
    return lake(
        spark,
        customers=rows(spark, "customers", customer_id=[1, 2, 3], gender=["Male", "Female", "Male"],
                       country=["A", "A", "B"]),
        products=rows(spark, "products", product_id=[1, 2, 3], product_name=["one", "two", "three"],
                      category=["x", "x", "y"]),
        orders=rows(spark, "orders", order_id=[1, 2, 3], customer_id=[1, 2, 1], total_amount=money("10", "20", "5"),
                    shipping_country=["A", "A", "B"], order_date=days("2024-01-05", "2024-01-06", "2024-02-01")),
        order_items=rows(spark, "order_items", order_item_id=[1, 2, 3, 4], order_id=[1, 1, 2, 3],
                         product_id=[1, 1, 2, 1], quantity=[1, 2, 3, 4],
                         unit_price=money("1.50", "1.50", "2.00", "1.00")),
        product_reviews=rows(spark, "product_reviews", review_id=[1, 2], product_id=[1, 1], rating=[4, 5]),
    )


def test_top_seller_keeps_ties_fan_out_and_percentages_over_100(shop):
    result = values(sales.top_seller_per_country(shop))
    assert result == [
        # Order 1 counts 10 twice; its one male buyer has three lines of the product.
        ("A", "one", Decimal("20.00"), 3, 4.5, 1, 300.0, 0.0),
        ("A", "two", Decimal("20.00"), 3, None, 1, 0.0, 100.0),
        ("B", "one", Decimal("5.00"), 4, 4.5, 1, 300.0, 0.0),
    ]


def test_top_seller_keeps_only_the_strongest_countries(shop):
    assert {row[0] for row in values(sales.top_seller_per_country(shop, top_countries=1))} == {"A"}


def test_repeated_product_rows_multiply_like_the_plain_join(spark, shop):
    twice = shop.products.unionAll(shop.products.where("product_id = 2"))
    changed = lake(spark, **{**dict(shop.items()), "products": twice})
    top = values(sales.top_seller_per_country(changed, top_countries=1))
    assert [(row[1], row[2], row[3]) for row in top] == [("two", Decimal("40.00"), 6)]
    assert values(sales.top_products(changed, 1)) == [("two", "x", Decimal("12.00"), 1)]


def test_demographics_count_joined_rows_and_customers_without_orders(shop):
    assert values(people.customer_demographics(shop)) == [
        ("A", 2, 2, 1, 3, round(35 / 3, 2)),
        ("B", 1, 1, 0, 0, None),
    ]


def test_demographics_with_null_country_and_shared_order_ids(spark):
    data = lake(
        spark,
        customers=rows(spark, "customers", customer_id=[1, 2, 3], gender=["Male", "Male", "Female"],
                       country=[None, "A", "A"]),
        orders=rows(spark, "orders", order_id=[7, 7, 7], customer_id=[1, 2, 3], total_amount=money("1", None, "4")),
    )
    assert values(people.customer_demographics(data)) == [("A", 2, 1, 1, 1, 4.0), (None, 1, 1, 0, 1, 1.0)]


def test_segments(spark):
    orders = [1] * 10 + [2] * 5 + [3]
    data = lake(
        spark,
        customers=rows(spark, "customers", customer_id=[1, 2, 3, 4]),
        orders=rows(spark, "orders", order_id=list(range(16)), customer_id=orders, total_amount=money(*["2"] * 16)),
    )
    assert values(people.customer_segments(data)) == [
        ("High Frequency", 1, 20.0), ("Medium Frequency", 1, 10.0), ("Low Frequency", 2, 1.0)]


def test_retention_needs_the_month_before(spark):
    orders = rows(spark, "orders", order_id=[1, 2, 3, 4, 5], customer_id=[1, 1, 1, 1, 2],
                  order_date=days("2024-01-31", "2024-02-01", "2024-02-20", "2024-04-01", "2024-04-02"))
    assert values(people.monthly_retention(orders)) == [
        (date(2024, 1, 1), 1, 0, 0.0), (date(2024, 2, 1), 1, 1, 100.0), (date(2024, 4, 1), 2, 0, 0.0)]


def test_category_queries(shop):
    assert values(sales.sales_by_category(shop)) == [("x", 3, 10, Decimal("14.50"), 1.5)]
    assert values(sales.revenue_by_category(shop)) == [("x", Decimal("14.50"))]


def test_top_products_ties_follow_the_key(shop):
    assert values(sales.top_products(shop, 2)) == [("one", "x", Decimal("8.50"), 2), ("two", "x", Decimal("6.00"), 1)]


def test_monthly_sales_from_a_date(shop):
    assert values(sales.monthly_sales(shop.orders, date(2024, 1, 6))) == [
        (date(2024, 1, 1), 1, Decimal("20.00"), 20.0), (date(2024, 2, 1), 1, Decimal("5.00"), 5.0)]


def test_customer_counts(spark):
    c = rows(spark, "customers", customer_id=[1, 2, 3], country=["A", "B", "B"],
             registration_date=days("2022-12-31", "2023-01-01", "2023-05-05"))
    assert values(people.customers_since(c)) == [("B", 2)]
    assert values(people.top_countries(c, 1)) == [("B", 2)]
    assert [r.customer_id for r in people.customers_of_country(c, "A").collect()] == [1]
