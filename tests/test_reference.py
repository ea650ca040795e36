"""Reference-table queries on a small seed, the tables derived from the given ones."""

from __future__ import annotations

import os

import pytest

from make import rows
from tidewagon import schemas
from tidewagon.operators import quality, reference, top
from tidewagon.sources import builders, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seed(spark):
    sites = builders.build_warehouses(builders.number_series(spark, 3))
    clients = spark.createDataFrame(
        [(f"CUST-000{i}", name, f"c{i}@example.com" if i != 5 else None, tier, state) for i, (name, tier, state) in enumerate(
            [("Test Company One", "STANDARD", "ACTIVE"), ("Test Company Two", "EXPRESS", "ACTIVE"),
             ("Test Company Three", "SAME_DAY", "ACTIVE"), ("Test Company Four", "CRITICAL", "ACTIVE"),
             ("Suspended Company", "STANDARD", "SUSPENDED")], start=1)],
        "customer_id string, company_name string, contact_email string, sla_tier string, account_status string")
    return {"warehouses": sites, "customers": clients}


def test_sites_are_ordered_by_id(seed):
    assert [r.warehouse_id for r in reference.all_rows(seed["warehouses"], "warehouses").collect()] == ["WH-BCN", "WH-FRA", "WH-RTM"]


def test_city_is_matched_partially_without_case(seed):
    assert rows(reference.warehouses_by_city(seed["warehouses"], "rotter"), "city") == [("Rotterdam",)]
    assert reference.warehouses_by_city(seed["warehouses"], "  ").count() == 3
    assert reference.by_id(seed["warehouses"], "warehouses", "WH-NONE").count() == 0


def test_page_starts_at_the_offset(seed):
    page = reference.customers_page(seed["customers"], 2, 2).collect()
    assert [r.customer_id for r in page] == ["CUST-0003", "CUST-0004"]


def test_company_and_tier(seed):
    assert reference.customers_by_company(seed["customers"], "test company").count() == 4
    assert rows(reference.customers_by_tier(seed["customers"], "express"), "customer_id") == [("CUST-0002",)]
    assert reference.with_count(reference.customers_by_tier(seed["customers"], "standard")).collect()[0]["count"] == 2


def test_wildcards_in_a_term_count_unless_literal(seed):
    assert reference.customers_by_company(seed["customers"], "t%one").count() == 1
    assert reference.customers_by_company(seed["customers"], "t%one", literal=True).count() == 0


def test_capped_list_reports_the_total(seed):
    out = top.customer_search_top(seed["customers"], limit=4).collect()
    assert [(r.total, r.note) for r in out] == [(5, "Showing first 4 of 5 results")] * 4
    assert {r.note for r in top.customer_search_top(seed["customers"]).collect()} == {None}
    assert "N/A" in {r.contact_email for r in top.customer_search_top(seed["customers"]).collect()}


def test_products_dispatch(spark):
    kinds = ("GENERAL", "APPAREL")
    items = spark.createDataFrame(
        [(f"PROD-{n:06d}", f"SKU-{n:08d}", f"Item {n}", kinds[n % 2], 1.0, None, None, None, 2.5) for n in range(1, 51)],
        "product_id string, sku string, name string, category string, weight_kg double, length_cm double, "
        "width_cm double, height_cm double, unit_price double")
    assert reference.products_query(items, category="apparel", term="zzz").count() == 25
    assert rows(reference.products_query(items, term="sku-00000042"), "product_id") == [("PROD-000042",)]
    assert [r.product_id for r in reference.products_query(items, limit=2).collect()] == ["PROD-000001", "PROD-000002"]
    assert [r.product_id for r in reference.products_by_category(items, "GENERAL", 2, 1).collect()] == ["PROD-000004", "PROD-000006"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_reference_tables_vary_with_the_given_rows(spark):
    found = {t: getattr(tables, t)(spark, FOLDER) for t in ("warehouses", "customers", "vehicles", "products", "drivers", "routes")}
    for name, df in found.items():
        assert set(schemas.REFERENCE[name][1].fieldNames()) - {"created_at"} <= set(df.columns)
    drivers = found["drivers"]
    assert {r.status for r in drivers.select("status").distinct().collect()} == set(schemas.DRIVER_STATUSES)
    assert drivers.groupBy("home_warehouse_id").count().agg({"count": "max"}).first()[0] < drivers.count() / 4
    rules = {(r.table_name, r.rule) for r in quality.reference_violations(found).collect()}
    assert {t for t, _ in rules} >= {"drivers", "routes"} and all(r.startswith(("foreign_key", "not_null")) for _, r in rules)


def test_insert_if_absent_keeps_what_is_there(spark, seed):
    more = spark.createDataFrame(
        [("CUST-0001", "Changed"), ("CUST-0009", "New"), ("CUST-0009", "New")], "customer_id string, company_name string")
    out = dict(rows(builders.insert_if_absent(seed["customers"], more, "customer_id"), "customer_id", "company_name"))
    assert out["CUST-0001"] == "Test Company One" and out["CUST-0009"] == "New" and len(out) == 6
