"""Slices written again: rows, and which files stay."""

import re
from datetime import date

import pytest
from frames import days, rows
from pyspark.sql import functions as F

from cartlake.maintenance.tables import plan_text
from cartlake.registry import PLAIN_ORDERS
from cartlake.sinks import export, slices
from cartlake.sources.files import file_inventory


def orders(spark, data):
    ids, dates = zip(*data)
    table = rows(spark, "orders", order_id=list(ids), order_date=[d and days(d)[0] for d in dates], status=["S"] * len(ids))
    return table.select(*PLAIN_ORDERS.names)


DATA = [(1, "2020-05-01"), (2, "2021-01-01"), (3, "2021-12-31"), (4, "2022-06-06"), (5, None), (None, "2021-03-03"), (6, "2023-02-02")]


@pytest.fixture
def path(spark, tmp_path):
    export.write_time_slices(orders(spark, DATA), f"{tmp_path}/orders", "order_date")
    return f"{tmp_path}/orders"


def stored(spark, path):
    return sorted(((r.order_id, str(r.order_date)) for r in slices.read_slices(spark, path, PLAIN_ORDERS).collect()), key=str)


def files(spark, path):
    found = {}
    for r in file_inventory(spark, path, recursive=True).collect():
        found.setdefault(r.path.split("slice_year=")[1].split("/")[0], set()).add((r.filename, r.modified))
    return found


def expected(*data):
    return sorted(((i, str(d and days(d)[0])) for i, d in data), key=str)


def test_only_slices_that_occur_are_replaced(spark, path):
    before = files(spark, path)
    slices.replace_slices(orders(spark, [(9, "2021-07-07"), (10, "2024-01-01")]), path, "order_date")
    after = files(spark, path)
    assert {s for s in before if before[s] != after.get(s)} == {"2021"} and set(after) - set(before) == {"2024"}
    assert stored(spark, path) == expected((1, "2020-05-01"), (4, "2022-06-06"), (5, None), (6, "2023-02-02"), (9, "2021-07-07"),
                                           (10, "2024-01-01"))


def test_a_slice_can_be_written_from_its_own_rows(spark, path):
    own = slices.read_slices(spark, path, PLAIN_ORDERS, [2021]).drop("slice_year")
    slices.replace_slices(own.where("order_id = 3"), path, "order_date")
    assert [r[0] for r in stored(spark, path) if r[1].startswith("2021")] == [3]


def test_a_period_is_replaced_inside_its_slices(spark, path):
    before = files(spark, path)
    slices.rewrite_period(orders(spark, [(20, "2021-06-06")]), path, "order_date", date(2021, 3, 1), date(2023, 1, 1), PLAIN_ORDERS)
    assert stored(spark, path) == expected((1, "2020-05-01"), (2, "2021-01-01"), (20, "2021-06-06"), (5, None), (6, "2023-02-02"))
    after = files(spark, path)
    assert "2022" not in after and after["2020"] == before["2020"] and after["2023"] == before["2023"]
    with pytest.raises(ValueError):
        slices.rewrite_period(orders(spark, [(1, None)]), path, "order_date", date(2021, 1, 1), date(2022, 1, 1), PLAIN_ORDERS)


def test_upsert_finds_rows_in_any_slice(spark, path):
    before = files(spark, path)
    changes = orders(spark, [(1, "2022-01-01"), (2, None), (30, "2021-09-09"), (None, "2021-10-10")])
    gone = spark.createDataFrame([(4,), (99,), (None,)], "order_id long")
    assert slices.upsert(changes, path, "order_id", "order_date", PLAIN_ORDERS, gone) == [2020, 2021, 2022, None]
    assert stored(spark, path) == expected(
        (1, "2022-01-01"), (2, None), (3, "2021-12-31"), (5, None), (None, "2021-03-03"), (None, "2021-10-10"), (30, "2021-09-09"),
        (6, "2023-02-02"))
    after = files(spark, path)
    assert after["2023"] == before["2023"] and "2020" not in after  # its only row moved


def test_changes_of_nothing(spark, path):
    before = files(spark, path)
    assert slices.upsert(orders(spark, DATA).limit(0), path, "order_id", "order_date", PLAIN_ORDERS) == []
    assert files(spark, path) == before


def test_reading_slices_opens_no_other_folder(spark, path):
    one = slices.read_slices(spark, path, PLAIN_ORDERS, [2021])
    assert one.select(F.col("_metadata.file_path")).distinct().count() == len(files(spark, path)["2021"])
    assert re.search(r"PartitionFilters: \[.*slice_year", plan_text(one, "simple"))
