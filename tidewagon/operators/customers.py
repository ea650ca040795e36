"""Per-customer statistics (AGG-5, AGG-6).

Plain counters combine before the shuffle. Only the events that move a clamped counter are put in
order, in time slices (see ``ordered``). ``state`` continues from earlier results: pass the rows
produced before for the customers at hand and the new events fold on top of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.functions.columns import ARRIVAL, count_where, minutes_to_sla, now_ms
from tidewagon.operators import ordered
from tidewagon.schemas import LATE_GRACE_MS, ORDER_UNTRACKED, SHIPMENT_CLOSED, SLA_RISK_MINUTES

_KEY = "customer_id"
SHIPMENT_CLAMPED = ["in_transit_count"]
ORDER_CLAMPED = ["pending_orders", "shipped_orders", "delivered_orders", "at_risk_orders"]

_STEPS = ["pending_step", "shipped_step", "delivered_step", "at_risk_step"]
# What each order status does to the counters. Taking a failed order from shipped is decided later.
_ORDER_STEPS = {
    "pending_step": {"RECEIVED": 1, "SHIPPED": -1, "CANCELLED": -1, "PARTIAL_FAILURE": -1},
    "shipped_step": {"SHIPPED": 1, "DELIVERED": -1},
    "delivered_step": {"DELIVERED": 1, "RETURNED": -1},
    "at_risk_step": {"DELIVERED": -1, "CANCELLED": -1, "PARTIAL_FAILURE": -1},
}


def _step(name: str, status: Column) -> Column:
    moves = F.create_map(*[F.lit(x) for kv in _ORDER_STEPS[name].items() for x in kv])
    return F.coalesce(moves[status], F.lit(0))


def _plain(events: DataFrame, state: DataFrame | None, counters: dict[str, Column]) -> DataFrame:
    batch = ordered.with_key(events, _KEY).groupBy(_KEY).agg(
        *[count_where(c).alias(name) for name, c in counters.items()],
        F.max("timestamp").alias("last_updated"))
    if state is None:
        return batch
    both = batch.withColumn("age", F.lit(1)).unionByName(
        state.select(*batch.columns).withColumn("age", F.lit(0)))
    return both.groupBy(_KEY).agg(
        *[F.sum(name).alias(name) for name in counters],
        F.max_by("last_updated", "age").alias("last_updated"))


def _merge(plain: DataFrame, clamped: DataFrame, names: list[str]) -> DataFrame:
    zero = F.lit(0).cast("long")
    return (plain.join(clamped, _KEY, "left")
            .select(*plain.columns, *[F.coalesce(F.col(c), zero).alias(c) for c in names]))


def shipment_stats_state(shipment_events: DataFrame, clock: str | int = "event",
                         state: DataFrame | None = None, slice_ms: int = ordered.SLICE_MS) -> DataFrame:
    """``customer_shipment_stats`` plus ``on_time_count`` (delivered no later than the grace period)."""
    kind = F.col("event_type")
    plain = _plain(shipment_events, state, {
        "total_shipments": kind == "CREATED",
        "delivered_count": kind == "DELIVERED",
        "late_count": ~kind.isin(*SHIPMENT_CLOSED) & (F.col("expected_delivery") < now_ms(clock)),
        "cancelled_count": kind == "CANCELLED",
        "exception_count": kind == "EXCEPTION",
        "on_time_count": (kind == "DELIVERED")
        & (F.col("timestamp") <= F.col("expected_delivery") + LATE_GRACE_MS)})
    moving = shipment_events.where(kind.isin("IN_TRANSIT", *SHIPMENT_CLOSED)).select(
        _KEY, *ARRIVAL,
        F.when(kind == "IN_TRANSIT", 1).otherwise(-1).cast("long").alias("in_transit_count"))
    slices = ordered.reduce_slices(ordered.sliced(moving, _KEY, slice_ms), _KEY, SHIPMENT_CLAMPED)
    slices = ordered.with_state(slices, state, _KEY, SHIPMENT_CLAMPED)
    return _merge(plain, ordered.combine_slices(slices, _KEY, SHIPMENT_CLAMPED), SHIPMENT_CLAMPED)


def customer_shipment_stats(shipment_events: DataFrame, clock: str | int = "event",
                            slice_ms: int = ordered.SLICE_MS) -> DataFrame:
    """Shipment counters per customer.

    ``in_transit_count`` rises on IN_TRANSIT and falls on DELIVERED and CANCELLED, never below 0 at
    any step; an EXCEPTION leaves it. ``late_count`` counts open *events* past the expected delivery,
    without grace.
    """
    return shipment_stats_state(shipment_events, clock, None, slice_ms).drop("on_time_count")


def customer_order_stats(order_status: DataFrame, clock: str | int = "event",
                         state: DataFrame | None = None, slice_ms: int = ordered.SLICE_MS) -> DataFrame:
    """Order counters per customer, every one floored at 0 at each step.

    A CANCELLED or PARTIAL_FAILURE takes from pending, or from shipped when nothing is pending, so
    ``shipped_orders`` needs the pending value at each such event. The pending value at the start of
    each slice comes first, then goes back to the events of the slice. ``at_risk_orders`` rises once
    per open event within the risk threshold.
    """
    status = F.col("status")
    failed = status.isin("CANCELLED", "PARTIAL_FAILURE")
    plain = _plain(order_status, state, {
        "total_orders": status == "RECEIVED",
        "cancelled_orders": failed,
        "returned_orders": status == "RETURNED"})

    # One array of bytes, a step per counter, so that both passes below read the same narrow rows and share
    # their shuffle; separate columns would be pruned differently for each pass.
    risky = ~status.isin(*ORDER_UNTRACKED) & minutes_to_sla(clock).between(0, SLA_RISK_MINUTES)
    moves = {name: _step(name, status) for name in _STEPS}
    moves["at_risk_step"] = moves["at_risk_step"] + F.when(risky, 1).otherwise(0)
    moves["failed"] = failed.cast("byte")
    steps = ordered.sliced(
        order_status.select(_KEY, *ARRIVAL, F.array(*[c.cast("byte") for c in moves.values()]).alias("steps"))
        .where(F.exists("steps", lambda x: x != 0)),
        _KEY, slice_ms)
    part = lambda name: F.col("steps")[list(moves).index(name)].cast("long")
    base = [_KEY, "slice", *ARRIVAL]

    simple = ["pending_orders", "delivered_orders", "at_risk_orders"]
    slices = ordered.reduce_slices(
        steps.select(*base, part("pending_step").alias(simple[0]), part("delivered_step").alias(simple[1]),
                     part("at_risk_step").alias(simple[2])),
        _KEY, simple)
    entered = ordered.entering(ordered.with_state(slices, state, _KEY, simple), _KEY, "pending_orders")

    # Pending before an event: the entering value plus the slice's sum so far, unless the clamp inside
    # the slice holds it higher.
    runs = ordered.with_run(
        steps.select(*base, (part("failed") != 0).alias("failed"), part("pending_step").alias("pending_step"),
                     part("shipped_step").alias("shipped_orders")),
        _KEY, "pending_step")
    before = (F.col("pending_step_run") - F.col("pending_step")
              - F.least(-F.col("pending_orders_in"), F.col("pending_step_floor")))
    done = tuple(f"{c}_{part}" for c in simple for part in ("sum", "low"))
    shipped = runs.join(entered, [_KEY, "slice"]).select(
        *base, *done,
        F.when(F.col("failed"), F.when(before == 0, F.lit(-1)).otherwise(F.lit(0)))
        .otherwise(F.col("shipped_orders")).cast("long").alias("shipped_orders"))
    full = ordered.reduce_slices(shipped, _KEY, ["shipped_orders"], keep=done)
    full = ordered.with_state(full, state, _KEY, ORDER_CLAMPED)
    return _merge(plain, ordered.combine_slices(full, _KEY, ORDER_CLAMPED), ORDER_CLAMPED)
