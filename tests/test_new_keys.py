"""Foreign keys of new rows against a filter of the parents' keys."""

import pytest

from cartlake.maintenance import new_keys
from cartlake.maintenance import tables as upkeep
from cartlake.maintenance.tables import plan_text


@pytest.fixture(scope="module")
def sides(spark):
    parents = spark.range(0, 40_000, 2).withColumnRenamed("id", "k")
    rows = spark.range(90_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS fk")
    return rows, parents


def test_no_parent_is_called_absent_and_few_orphans_pass(spark, sides):
    _, parents = sides
    bits = new_keys.filter_bits(20_000)
    stored = new_keys.key_filter(parents, "k", bits)
    judged = new_keys.without_parent(spark.range(80_000).withColumnRenamed("id", "k"), "k", stored, bits)
    by_kind = {}
    for r in judged.collect():
        kind = (r.k % 2 == 0 and r.k < 40_000, r.absent)
        by_kind[kind] = by_kind.get(kind, 0) + 1
    assert (True, True) not in by_kind and by_kind[True, False] == 20_000
    passed = by_kind.get((False, False), 0) / 60_000
    assert passed <= 2 * new_keys.error_rate(20_000, bits) and new_keys.error_rate(20_000, bits) < 0.01


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bits", [32768, 1 << 19])
def test_the_report_is_exact_at_any_size(sides, bits):
    rows, parents = sides
    stored = new_keys.key_filter(parents, "k", bits)
    assert rows_of(new_keys.new_orphans(rows, "fk", parents, "k", stored, bits)) == rows_of(
        upkeep.orphan_keys(rows, "fk", parents, "k"))


def test_filters_unite(sides):
    rows, parents = sides
    bits = 1 << 19
    whole = new_keys.key_filter(parents, "k", bits)
    parts = new_keys.united(new_keys.key_filter(parents.where("k < 9999"), "k", bits), new_keys.key_filter(parents.where("k >= 9999"), "k", bits))
    assert rows_of(whole) == rows_of(parts)


def test_nothing_to_check(spark, sides):
    rows, parents = sides
    stored = new_keys.key_filter(parents.limit(0), "k", 32768)
    assert rows_of(new_keys.new_orphans(rows.limit(0), "fk", parents, "k", stored, 32768)) == []
    found = new_keys.new_orphans(rows, "fk", parents.limit(0), "k", stored, 32768)
    assert found.agg({"occurrences": "sum"}).first()[0] == rows.where("fk IS NOT NULL").count()


def test_new_rows_are_counted_before_they_shuffle(sides):
    rows, parents = sides
    plan = plan_text(new_keys.new_orphans(rows, "fk", parents, "k", new_keys.key_filter(parents, "k", 32768), 32768), "simple")
    assert "partial_count" in plan and "Python" not in plan
