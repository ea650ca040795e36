"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re

import pytest

from make import MIN, T0, rows, shipments
from test_oracle import FOLDER
from pyspark.sql import functions as F
from tidewagon.functions.columns import padded
from tidewagon.operators import counts, customers, hybrid, latest, ordered, windows
from tidewagon.plans.queries import named_queries
from tidewagon.sources import streams


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # plans print their filters in full
    folder = str(tmp_path_factory.mktemp("events") / "shipments")
    shipments(spark, [{"event_type": "DELIVERED", "customer_id": f"CUST-{0 if i % 3 == 0 else i}", "shipment_id": f"SH-{i % 50}",
                       "timestamp": T0 + i * 5 * MIN} for i in range(600)]).write.parquet(folder)
    return streams.file_events(spark, "shipment_events", folder)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
@pytest.mark.parametrize("name", [n for n in sorted(named_queries()) if not n.startswith("stream_")])
def test_no_python_and_no_cartesian_product(spark, name):
    text = plan(named_queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "ObjectHashAggregate collect_set"):
        assert bad not in text


def test_only_needed_columns_are_read(stored):
    assert "ReadSchema: struct<event_type:string>" in plan(counts.status_event_counts(stored))


def test_a_key_filter_reaches_the_scan(stored):
    text = plan(hybrid.lookup(latest.late_shipments(stored), "shipment_id", "SH-7"))
    assert re.search(r"PushedFilters: .*EqualTo\(shipment_id,SH-7\)", text)
    text = plan(counts.status_count(stored, "PACKED"))
    assert re.search(r"PushedFilters: .*EqualTo\(event_type,PACKED\)", text)


def test_the_retention_filter_reaches_the_scan(stored):
    text = plan(windows.recent_hourly_performance(stored, as_of=T0 + 3000 * MIN))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(timestamp,", text)


def test_only_the_days_of_the_retention_period_are_read(spark, tmp_path):
    many = [{"event_type": "DELIVERED", "timestamp": T0 + i * 60 * MIN} for i in range(24 * 10)]
    streams.write_events(shipments(spark, many), str(tmp_path / "by_day"))
    events = streams.file_events(spark, "shipment_events", str(tmp_path / "by_day"), by_day=True)
    recent = windows.recent_hourly_performance(events)
    plain = windows.recent_hourly_performance(shipments(spark, many))
    assert rows(recent) == rows(plain) and recent.count() > 0
    scans = [line for line in plan(recent).splitlines() if "FileScan" in line]
    assert any(re.search(r"PartitionFilters: \[.*day", line) for line in scans)
    narrowed = windows.within_retention(events, T0 + 239 * 60 * MIN)
    assert len(narrowed.select("day").distinct().collect()) == 1


def test_latest_views_combine_before_the_shuffle(stored):
    text = plan(latest.late_shipments(stored))
    assert text.index("partial_max") > text.index("Exchange hashpartitioning(shipment_id")


def test_ordered_passes_share_one_shuffle_of_the_events(spark, stored):
    df = stored.selectExpr("seq", "customer_id", "timestamp", "timestamp + 60000 as sla_timestamp",
                           "element_at(array('RECEIVED','SHIPPED','CANCELLED'), cast(seq % 3 + 1 as int)) as status")
    text = final_plan(customers.customer_order_stats(df))
    assert len(re.findall(r"\bExchange hashpartitioning\(customer_id[^,]*, slice[^)]*\), REPARTITION_BY_COL", text.split("ReusedExchange")[0])) == 1
    assert "ReusedExchange" in text
    text = final_plan(ordered.adjacent_pairs(stored, "shipment_id", "event_type"))
    assert "ReusedExchange" in text


def test_a_large_customer_is_spread_over_partitions(spark, stored):
    spread = ordered.sliced(stored.select("customer_id", "timestamp", "seq"), "customer_id").where("customer_id = 'CUST-0'")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be put together again
    try:
        sizes = [c for _, c in rows(spread.selectExpr("spark_partition_id() as p").groupBy("p").count())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 200 and len(sizes) == 4 and max(sizes) < 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
@pytest.mark.parametrize("name", ["late_top_k", "at_risk_top_k", "customer_search_top", "fleet_first"])
def test_top_lists_are_a_top_k_per_task(spark, name):
    text = plan(named_queries()[name](spark, FOLDER))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
@pytest.mark.parametrize("name", ["lookup_order_state", "lookup_order_sla_tracking", "lookup_late_shipments"])
def test_key_sets_filter_before_the_view(spark, name):
    text = plan(named_queries()[name](spark, FOLDER))
    last_aggregate = [m.start() for m in re.finditer(r"(Sort|Hash|ObjectHash)Aggregate\(key", text)][0]
    assert "LeftSemi" in text and text.index("LeftSemi") > last_aggregate


def test_days_are_rebalanced_when_written(spark):
    events = shipments(spark, [{"event_type": "DELIVERED", "timestamp": T0}])
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(events.hint("rebalance", "timestamp"))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_the_dashboard_reads_each_stream_once(spark):
    text = plan(named_queries()["dashboard_summary"](spark, FOLDER))
    assert "Subquery" not in text
    assert len(re.findall(r"FileScan parquet \[[^\]]*\b(?:event_id|user_id|event_type)#", text)) == 4  # four streams


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
def test_constraints_are_checked_in_one_aggregation(spark):
    text = plan(named_queries()["reference_violations"](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet", text)) <= 4 and "constraints-" in text  # the tagged rows only
    assert "supplier.parquet" not in text and "customer.parquet" not in text


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")
@pytest.mark.parametrize("name", ["lookup_warehouse_metrics", "lookup_hourly_performance"])
def test_keys_are_looked_up_before_the_windows(spark, name):
    text = plan(named_queries()[name](spark, FOLDER))
    assert text.index("LeftSemi") > text.index("HashAggregate")  # the join is below the aggregation


def test_a_deep_page_reads_its_range_only(spark):
    from tidewagon.operators.paging import Pages

    table = spark.range(20_000).select(padded("P-", F.col("id") * 7919 % 20_000, 6).alias("k"), "id").repartition(5)
    pages = Pages.of(table, "k")
    assert [r["k"] for r in pages.page(25, 15_000).collect()] == [f"P-{i:06d}" for i in range(15_000, 15_025)]
    assert [r["k"] for r in pages.page(10, 19_995).collect()] == [f"P-{i:06d}" for i in range(19_995, 20_000)]
    assert pages.page(5, 50_000).count() == 0
    for edge in [before for _, before in pages.starts[1:]]:
        assert [r["k"] for r in pages.page(4, edge - 2).collect()] == [f"P-{i:06d}" for i in range(edge - 2, edge + 2)]
    assert [r["k"] for r in pages.after("P-000100", 3).collect()] == ["P-000101", "P-000102", "P-000103"]
    assert [r["k"] for r in pages.after(None, 2).collect()] == ["P-000000", "P-000001"]
    assert re.search(r"PushedFilters: .*_in_range", plan(pages.page(25, 15_000)))
    assert Pages.of(table.where("false"), "k").page(5, 0).count() == 0
