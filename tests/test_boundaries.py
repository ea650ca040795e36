"""Exact limits: grace periods, thresholds, floors, ties and window edges."""

from __future__ import annotations

import pytest

from make import MIN, T0, operations, orders, rows, shipments, telemetry
from tidewagon.operators import coordination, counts, customers, fleet, hybrid, latest, quality, windows

GRACE = 30 * MIN


@pytest.mark.parametrize("over, late", [(-1, False), (0, False), (1, True)])
def test_late_list_is_strict_after_grace(spark, over, late):
    df = shipments(spark, [{"event_type": "IN_TRANSIT", "timestamp": T0, "expected_delivery": T0 - GRACE - over}])
    assert (latest.late_shipments(df).count() == 1) is late


@pytest.mark.parametrize("over, on_time", [(-1, 1), (0, 1), (1, 0)])
def test_on_time_is_inclusive_of_grace(spark, over, on_time):
    df = shipments(spark, [{"event_type": "DELIVERED", "timestamp": T0, "expected_delivery": T0 - GRACE - over}])
    assert {r.on_time_count for r in windows.hourly_delivery_performance(df).collect()} == {on_time}


def test_unknown_expected_delivery_is_never_late_but_counts_for_the_customer(spark):
    df = shipments(spark, [{"event_type": "CREATED", "expected_delivery": 0}])
    assert latest.late_shipments(df).count() == 0
    assert rows(customers.customer_shipment_stats(df), "late_count") == [(1,)]


def test_late_for_customer_has_no_grace_and_is_strict(spark):
    df = shipments(spark, [{"event_type": "PICKED", "timestamp": T0, "expected_delivery": T0},
                           {"event_type": "EXCEPTION", "timestamp": T0 + 1, "expected_delivery": T0},
                           {"event_type": "DELIVERED", "timestamp": T0 + 2, "expected_delivery": T0}])
    assert rows(customers.customer_shipment_stats(df), "late_count", "exception_count") == [(1, 1)]


def test_fixed_clock(spark):
    df = shipments(spark, [{"event_type": "IN_TRANSIT", "timestamp": T0, "expected_delivery": T0 + 10 * MIN}])
    assert latest.late_shipments(df).count() == 0
    assert rows(latest.late_shipments(df, clock=T0 + 45 * MIN), "delay_minutes") == [(5,)]


def test_late_list_keeps_delivered_shipments_and_the_open_list_does_not(spark):
    late = {"timestamp": T0, "expected_delivery": T0 - 60 * MIN}
    df = shipments(spark, [{"event_type": "IN_TRANSIT", **late}, {"event_type": "DELIVERED"},
                           {"event_type": "IN_TRANSIT", "shipment_id": "SH-2", **late}])
    assert rows(latest.late_shipments(df), "shipment_id", "delay_minutes") == [("SH-1", 30), ("SH-2", 30)]
    assert rows(latest.late_shipments_open(df), "shipment_id") == [("SH-2",)]


@pytest.mark.parametrize("left_ms, minutes, at_risk, breached", [
    (60 * MIN + 59_999, 60, True, False), (61 * MIN, None, None, None), (0, 0, True, False),
    (-59_999, 0, True, False), (-60_000, -1, False, True)])
def test_sla_minutes_are_truncated_toward_zero(spark, left_ms, minutes, at_risk, breached):
    df = orders(spark, [{"status": "RECEIVED", "timestamp": T0, "sla_timestamp": T0 + left_ms}])
    expected = [] if minutes is None else [(minutes, at_risk, breached)]
    assert rows(latest.order_sla_tracking(df), "time_to_sla_minutes", "is_at_risk", "is_breached") == expected
    counted = rows(customers.customer_order_stats(df), "at_risk_orders")
    assert counted == [(1 if at_risk else 0,)]


@pytest.mark.parametrize("minutes, severity", [(30, "HIGH"), (31, "MEDIUM"), (-1, "CRITICAL")])
def test_severity(spark, minutes, severity):
    df = orders(spark, [{"status": "RECEIVED", "timestamp": T0, "sla_timestamp": T0 + minutes * MIN}])
    assert rows(latest.sla_severity(latest.order_sla_tracking(df)), "severity") == [(severity,)]


def test_sla_list_keeps_ended_orders_and_the_open_list_does_not(spark):
    df = orders(spark, [{"status": "SHIPPED", "sla_timestamp": T0}, {"status": "PARTIAL_FAILURE"}])
    assert latest.order_sla_tracking(df).count() == 1
    assert latest.order_sla_open(df).count() == 0


def test_partial_failure_is_not_terminal_for_the_state(spark):
    df = orders(spark, [{"status": "PARTIAL_FAILURE"}])
    state = latest.order_state(df)
    assert rows(state.select(latest.order_is_terminal())) == [(False,)]


def test_counters_are_floored_at_each_step(spark):
    df = shipments(spark, [{"event_type": e} for e in ("DELIVERED", "CANCELLED", "IN_TRANSIT", "EXCEPTION")])
    assert rows(customers.customer_shipment_stats(df), "in_transit_count", "delivered_count") == [(1, 1)]


def test_cancel_takes_from_shipped_only_when_nothing_is_pending(spark):
    one = [{"status": s} for s in ("RECEIVED", "SHIPPED", "RECEIVED", "CANCELLED", "PARTIAL_FAILURE", "CANCELLED")]
    two = [{"status": s, "customer_id": "CUST-0002"} for s in ("RETURNED", "RECEIVED", "SHIPPED", "DELIVERED")]
    out = rows(customers.customer_order_stats(orders(spark, one + two)), "customer_id", "pending_orders",
               "shipped_orders", "delivered_orders", "cancelled_orders", "returned_orders")
    assert out == [("CUST-0001", 0, 0, 0, 3, 0), ("CUST-0002", 0, 0, 1, 0, 1)]


def test_equal_times_are_ordered_by_seq(spark):
    df = orders(spark, [{"status": "DELIVERED", "timestamp": T0, "seq": 7}, {"status": "SHIPPED", "timestamp": T0, "seq": 3}])
    assert rows(latest.order_state(df), "status", "created_at") == [("DELIVERED", T0)]
    assert rows(customers.customer_order_stats(df), "shipped_orders", "delivered_orders") == [(0, 1)]
    tel = telemetry(spark, [{"timestamp": T0, "seq": 2, "latitude": 9.0}, {"timestamp": T0, "seq": 1, "latitude": 8.0}])
    assert rows(latest.vehicle_state(tel), "latitude", "heading", "shipment_ids") == [(9.0, 4.0, [])]


def test_window_start_is_inclusive_and_end_exclusive(spark):
    edge = T0 + 15 * MIN
    df = operations(spark, [{"timestamp": edge - 1}, {"timestamp": edge}])
    assert rows(windows.warehouse_metrics(df), "window_start", "total_operations") == [(T0, 1), (edge, 1)]


def test_delivery_is_in_two_hopping_windows(spark):
    df = shipments(spark, [{"event_type": "DELIVERED", "timestamp": T0 + 30 * MIN}])
    assert rows(windows.hourly_delivery_performance(df), "window_start", "window_end") == [
        (T0, T0 + 60 * MIN), (T0 + 30 * MIN, T0 + 90 * MIN)]


def test_an_operation_with_errors_counts_once(spark):
    df = operations(spark, [{"errors": ["A", "B"]}, {"errors": []}, {"errors": None}])
    out = windows.warehouse_metrics(df).collect()[0]
    assert (out.error_count, out.total_operations, out.operation_counts) == (1, 3, {"PICK": 3})


def test_last_windows_reads_only_the_retention_period(spark):
    hours = [0, 4, 8, 8.25, 8.5, 8.75, 9]
    df = operations(spark, [{"timestamp": T0 + int(h * 60) * MIN} for h in hours])
    out = rows(windows.recent_warehouse_metrics(df), "window_start")
    assert [(s - T0) / (60 * MIN) for s, in out] == [8.25, 8.5, 8.75, 9]
    few = rows(windows.recent_warehouse_metrics(df, as_of=T0 + 250 * MIN), "window_start")
    assert [(s - T0) / (60 * MIN) for s, in few] == [0, 4]
    assert windows.recent_warehouse_metrics(df, warehouse_id="WH-B").count() == 0


def test_nested_windows_are_oldest_first(spark):
    df = operations(spark, [{"timestamp": T0 + m * MIN} for m in (40, 0, 20)])
    nested = windows.nested_windows(windows.recent_warehouse_metrics(df), "w").collect()[0].w
    assert [w.window_start for w in nested] == [T0, T0 + 15 * MIN, T0 + 30 * MIN]


def test_status_counts(spark):
    df = shipments(spark, [{"event_type": "CREATED"}, {"event_type": "PICKED"}])
    filled = dict(rows(counts.status_counts_zero_filled(df)))
    assert len(filled) == 9 and filled["PICKED"] == 1 and filled["DELIVERED"] == 0
    assert rows(counts.current_status_counts(df)) == [("PICKED", 1)]
    missing = counts.status_count(df, " delivered ").collect()[0]
    assert (missing.event_count, missing.message) == (0, "No shipments found with status: DELIVERED")
    total = counts.status_counts_total(df).collect()[0]
    assert (total.status_counts, total.total_shipments) == ({"CREATED": 1, "PICKED": 1}, 2)


def test_no_events_at_all(spark):
    none = shipments(spark, [])
    assert rows(counts.status_counts_total(none), "total_shipments") == [(0,)]
    fleet_row = fleet.fleet_utilization(latest.vehicle_state(telemetry(spark, []))).collect()[0]
    assert (fleet_row.total_vehicles, fleet_row.utilization_rate, fleet_row.average_load_kg) == (0, 0.0, 0.0)
    assert customers.customer_order_stats(orders(spark, [])).count() == 0


def test_enriched_vehicle_takes_the_first_driver_and_survives_zero_capacity(spark):
    vehicles = spark.createDataFrame([("VEH-001", "VAN", "X", 0.0, 1.0, "WH-A", "DIESEL")],
                                     "vehicle_id string, vehicle_type string, license_plate string, capacity_kg double, "
                                     "capacity_cubic_m double, home_warehouse_id string, fuel_type string")
    sites = spark.createDataFrame([("WH-B", "B", "Bonn")], "warehouse_id string, name string, city string")
    drivers = spark.createDataFrame(
        [("DRV-002", "B", "Two", "C", None, "VEH-001", "ON_DUTY"), ("DRV-001", "A", "One", "B", ["ADR"], "VEH-001", "ON_DUTY"),
         ("DRV-003", "C", "Three", "B", None, None, "AVAILABLE")],
        "driver_id string, first_name string, last_name string, license_type string, certifications array<string>, "
        "assigned_vehicle_id string, status string")
    state = latest.vehicle_state(telemetry(spark, [{}]))
    out = hybrid.enriched_vehicle_state(state, vehicles, sites, drivers).collect()[0]
    assert (out.driver_id, out.driver_name, out.load_percentage, out.home_warehouse_name) == ("DRV-001", "A One", 0.0, None)
    assert out.summary == "VEH-001, a VAN, is IDLE with 0.0% of its load and driven by A One"
    tracked = {r.driver_id: r for r in hybrid.driver_tracking(drivers, state).collect()}
    assert tracked["DRV-003"].vehicle_state is None and tracked["DRV-003"].certifications == []
    assert tracked["DRV-002"].vehicle_location.latitude == 1.0


def test_customer_without_events_has_zeros(spark):
    who = spark.createDataFrame([("CUST-0009", "Nine", None, "EXPRESS", "ACTIVE")],
                                "customer_id string, company_name string, contact_email string, sla_tier string, account_status string")
    stats = customers.shipment_stats_state(shipments(spark, [{"event_type": "CREATED"}]))
    order_stats = customers.customer_order_stats(orders(spark, [{"status": "RECEIVED"}]))
    out = hybrid.customer_overview(who, stats, order_stats).collect()[0]
    assert (out.total_orders, out.total_shipments, out.sla_compliance_rate) == (0, 0, 100.0)
    assert out.summary == "Nine, tier EXPRESS: 0 orders and 0 shipments, 100.0% of the orders without risk"


def test_order_rollup(spark):
    state = orders(spark, [
        {"order_id": "A", "status": "RECEIVED", "shipment_ids": ["1", "2"]}, {"order_id": "B", "status": "RECEIVED", "shipment_ids": ["3", "4"]},
        {"order_id": "C", "status": "RECEIVED", "shipment_ids": ["4"]}, {"order_id": "D", "status": "RECEIVED", "shipment_ids": ["1", "5"]},
        {"order_id": "E", "status": "RECEIVED", "shipment_ids": ["9"]}, {"order_id": "F", "status": "RECEIVED", "shipment_ids": []},
        {"order_id": "G", "status": "RECEIVED", "shipment_ids": ["1", "6"]}, {"order_id": "H", "status": "RECEIVED", "shipment_ids": ["1", "9"]}])
    events = shipments(spark, [
        {"shipment_id": "1", "event_type": "DELIVERED"}, {"shipment_id": "2", "event_type": "DISPATCHED"},
        {"shipment_id": "3", "event_type": "DELIVERED"}, {"shipment_id": "4", "event_type": "CANCELLED"},
        {"shipment_id": "5", "event_type": "EXCEPTION"}, {"shipment_id": "5", "event_type": "DELIVERED"},
        {"shipment_id": "6", "event_type": "PACKED"}])
    assert dict(rows(coordination.order_rollup(state, events))) == {
        "A": "SHIPPED", "B": "DELIVERED", "C": "CANCELLED", "D": "PARTIAL_FAILURE", "E": None, "F": None, "G": None,
        "H": "DELIVERED"}
    assert rows(coordination.pickable_shipments(events)) == []
    assert rows(coordination.open_shipments_by_warehouse(events), "shipment_id") == [("2",), ("6",)]


@pytest.mark.parametrize("slice_ms", [MIN, 10 ** 15])
def test_lifecycle_violations_across_slices(spark, slice_ms):
    path = ["CREATED", "PICKED", "DISPATCHED", "IN_TRANSIT", "EXCEPTION", "EXCEPTION", "OUT_FOR_DELIVERY", "DELIVERED", "CREATED"]
    df = shipments(spark, [{"event_type": e, "timestamp": T0 + i * MIN // 2} for i, e in enumerate(path)])
    assert rows(quality.lifecycle_violations(df, slice_ms), "seq", "from_status", "to_status") == [
        (2, "PICKED", "DISPATCHED"), (8, "DELIVERED", "CREATED")]


def test_bad_json_is_set_aside(spark):
    from pyspark.sql import types as T

    raw = spark.createDataFrame([('{"k": 1, "other": 2}',), ("{broken",), ('{"k": "x"}',), ("{}",), (None,)], "body string")
    good, bad = quality.split_json(raw, "body", T.StructType([T.StructField("k", T.IntegerType())]))
    assert rows(good, "k") == [(1,), (None,)]
    assert {r.body for r in bad.collect()} == {"{broken", '{"k": "x"}', None}


def test_reference_violations_find_each_rule(spark):
    clients = spark.createDataFrame(
        [("C1", "A", "EXPRESS", "ACTIVE"), ("C1", "A", "GOLD", "ACTIVE"), ("C2", None, "EXPRESS", None)],
        "customer_id string, company_name string, sla_tier string, account_status string")
    assert rows(quality.reference_violations({"customers": clients}), "rule", "key") == [
        ("domain:sla_tier", "C1"), ("not_null:company_name", "C2"), ("unique:customer_id", "C1")]
