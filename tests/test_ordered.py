"""Clamped counters in slices against a stepwise fold, for generated event sequences."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from make import MIN, T0, orders, shipments
from tidewagon.operators import customers, ordered
from tidewagon.schemas import ORDER_STATUSES, SHIPMENT_EVENT_TYPES

OPEN = ("RECEIVED", "VALIDATED", "ALLOCATED", "SHIPPED")


def fold_orders(events, counters=None):
    c = counters or dict.fromkeys(("total", "pending", "shipped", "delivered", "cancelled", "returned", "risk", "last"), 0)
    for e in events:
        status = e["status"]
        if status == "RECEIVED":
            c["total"] += 1
            c["pending"] += 1
        elif status == "SHIPPED":
            c["shipped"] += 1
            c["pending"] = max(0, c["pending"] - 1)
        elif status == "DELIVERED":
            c["delivered"] += 1
            c["shipped"] = max(0, c["shipped"] - 1)
            c["risk"] = max(0, c["risk"] - 1)
        elif status in ("CANCELLED", "PARTIAL_FAILURE"):
            c["cancelled"] += 1
            source = "pending" if c["pending"] > 0 else "shipped"
            c[source] = max(0, c[source] - 1)
            c["risk"] = max(0, c["risk"] - 1)
        elif status == "RETURNED":
            c["returned"] += 1
            c["delivered"] = max(0, c["delivered"] - 1)
        minutes = int((e["sla_timestamp"] - e["timestamp"]) / MIN)
        if status in OPEN and 0 <= minutes <= 60:
            c["risk"] += 1
        c["last"] = e["timestamp"]
    return c


def fold_in_transit(events):
    value = 0
    for e in events:
        if e["event_type"] == "IN_TRANSIT":
            value += 1
        elif e["event_type"] in ("DELIVERED", "CANCELLED"):
            value = max(0, value - 1)
    return value


def by_customer(events):
    groups = {}
    for e in events:
        groups.setdefault(e["customer_id"], []).append(e)
    return groups


def found_orders(df):
    return {r.customer_id: (r.total_orders, r.pending_orders, r.shipped_orders, r.delivered_orders, r.cancelled_orders,
                            r.returned_orders, r.at_risk_orders, r.last_updated) for r in df.collect()}


def expected_orders(events):
    return {c: tuple(fold_orders(g).values()) for c, g in by_customer(events).items()}


# One generated case is many customers at once; customer 0 gets about a third of the events. Gaps of 0
# give equal times, where only seq decides.
_step = st.tuples(st.integers(0, 23), st.sampled_from(ORDER_STATUSES), st.integers(0, 4), st.integers(-90, 150))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(steps=st.lists(_step, min_size=150, max_size=400), slice_minutes=st.sampled_from([1, 7, 60, 10 ** 9]),
       cut=st.integers(0, 400))
def test_order_stats_equal_a_stepwise_fold(spark, steps, slice_minutes, cut):
    events, now = [], T0
    for i, (who, status, gap, left) in enumerate(steps):
        now += gap * MIN
        events.append({"customer_id": f"CUST-{0 if who < 8 else who}", "status": status, "timestamp": now, "seq": i,
                       "sla_timestamp": now + left * MIN})
    frame = orders(spark, events)
    how = {"slice_ms": slice_minutes * MIN}
    whole = customers.customer_order_stats(frame, **how)
    assert found_orders(whole) == expected_orders(events)
    # The same in two parts, the second on top of the first one's result.
    first = customers.customer_order_stats(frame.where(f"seq < {cut}"), **how)
    later = frame.where(f"seq >= {cut}")
    known = first.join(later.select("customer_id").distinct(), "customer_id", "left_semi")
    both = customers.customer_order_stats(later, state=known, **how)
    touched = {e["customer_id"] for e in events[cut:]}
    assert found_orders(both) == {c: v for c, v in expected_orders(events).items() if c in touched}


@pytest.mark.parametrize("slice_minutes", [1, 13, 10 ** 9])
def test_in_transit_equals_a_stepwise_fold(spark, slice_minutes):
    import random

    rng = random.Random(5)
    events = [{"customer_id": f"CUST-{rng.choice((0, 0, 0, 1, 2, 3, 4, 5, 6))}", "event_type": rng.choice(SHIPMENT_EVENT_TYPES),
               "timestamp": T0 + i // 2 * MIN} for i in range(600)]
    out = customers.customer_shipment_stats(shipments(spark, events), slice_ms=slice_minutes * MIN)
    expected = {c: fold_in_transit(g) for c, g in by_customer(events).items()}
    assert {r.customer_id: r.in_transit_count for r in out.collect()} == expected


def test_events_without_a_customer_are_left_out_of_the_ordered_part(spark):
    df = shipments(spark, [{"event_type": "IN_TRANSIT", "customer_id": None}, {"event_type": "IN_TRANSIT"}])
    steps = df.selectExpr("customer_id", "timestamp", "seq", "1L as d")
    assert ordered.sliced(steps, "customer_id").count() == 1


def test_adjacent_pairs_do_not_depend_on_the_slice(spark):
    events = [{"shipment_id": f"SH-{i % 3}", "event_type": SHIPMENT_EVENT_TYPES[i % 7], "timestamp": T0 + i * MIN} for i in range(90)]
    df = shipments(spark, events)
    pairs = [sorted(tuple(r) for r in ordered.adjacent_pairs(df, "shipment_id", "event_type", m * MIN).collect() if r.previous)
             for m in (2, 11, 10 ** 9)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) == 87
