"""The physical plans the design counts on."""

import re
from datetime import date

import pytest

from cartlake.maintenance import tables as upkeep
from cartlake.maintenance.tables import plan_text
from cartlake.operators.ranking import best_per_group
from cartlake.plans import customers as people
from cartlake.plans import sales
from cartlake.registry import QUERIES
from cartlake.sinks import export
from cartlake.sources import files, fixtures

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hash_exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))


def test_rank_filter_drops_rows_before_the_shuffle(spark):
    plan = plan_text(best_per_group(fixtures.products(spark, FOLDER), "category", "price"), "simple")
    partial, shuffle = plan.index("Partial"), plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan and shuffle < partial  # plans print from the top down


def test_regrouping_after_the_product_join_needs_no_shuffle(spark, no_broadcast):
    plan = plan_text(sales.product_sales(fixtures.tables(spark, FOLDER, shipping=True)), "simple")
    assert not [keys for keys in hash_exchanges(plan) if "product_name" in keys]


def test_segments_shuffle_orders_once_after_partial_aggregation(spark, no_broadcast):
    plan = plan_text(people.customer_segments(fixtures.tables(spark, FOLDER)), "simple")
    by_customer = [keys for keys in hash_exchanges(plan) if keys.startswith("customer_id")]
    assert len(by_customer) == 2  # customers and their order totals
    assert "partial_sum(total_amount" in plan


def test_large_products_are_not_broadcast(spark, no_broadcast):
    plan = plan_text(sales.sales_by_category(fixtures.tables(spark, FOLDER)), "simple")
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_scan_reads_needed_columns_and_pushes_the_date(spark):
    plan = plan_text(sales.monthly_sales(fixtures.orders(spark, FOLDER), date(1998, 1, 1)))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate,1998-01-01", plan)
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_country_lookup_can_be_split_by_adaptive_execution(spark, no_broadcast):
    plan = plan_text(fixtures.orders(spark, FOLDER, shipping=True), "simple")
    join = plan[plan.index("SortMergeJoin [o_custkey"):]
    assert "LeftOuter" in join and "Aggregate" not in join


def test_each_key_is_grouped_once_with_its_references(spark, no_broadcast):
    plan = plan_text(upkeep.integrity_report(fixtures.tables(spark, FOLDER)), "simple")
    # Customer, product, order, order item, review; the other shuffles look up the customers' nations.
    assert [keys.split(",")[0] for keys in hash_exchanges(plan)].count("key") == 5
    assert plan.count("FileScan") == 11


def test_retention_shuffles_orders_once(spark, no_broadcast):
    plan = plan_text(people.monthly_retention(fixtures.orders(spark, FOLDER)), "simple")
    assert [keys.split(",")[0] for keys in hash_exchanges(plan)] == ["order_month", "customer_id"]
    assert "partial_collect_set" in plan and "Window" not in plan


def test_conditional_distinct_counts_do_not_multiply_rows(spark):
    plan = plan_text(QUERIES["buyers_of_large_orders"](spark, FOLDER), "simple")
    assert "Expand" not in plan and len(hash_exchanges(plan)) == 2


def test_top_k_is_not_a_global_sort(spark):
    assert "TakeOrderedAndProject" in plan_text(people.top_countries(fixtures.customers(spark, FOLDER)), "simple")


def test_inventory_does_not_read_contents(spark):
    assert "content" not in plan_text(files.file_inventory(spark, FOLDER)).split("ReadSchema")[1].split("\n")[0]


def test_no_query_uses_cross_joins(spark, no_broadcast):
    t = fixtures.tables(spark, FOLDER, shipping=True)
    for df in (sales.product_sales(t), sales.sales_by_category(t), sales.revenue_by_category(t),
               people.customer_demographics(t), people.customer_segments(t), people.monthly_retention(t.orders)):
        plan = plan_text(df, "simple")
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_time_slices_are_rebalanced_not_hash_partitioned(spark):
    plan = plan_text(export.time_slices(fixtures.orders(spark, FOLDER), "order_date"), "simple")
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
