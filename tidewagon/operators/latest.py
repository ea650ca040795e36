"""Latest-value views per key (AGG-7..14).

All are one aggregation of ``last_of``: it combines before the shuffle, so a key that holds a large
share of the events still sends one row per map task, and it runs unchanged on streams in update mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.functions.columns import last_of, minutes_to_sla, now_ms, sla_tracked, whole_minutes
from tidewagon.schemas import (
    LATE_GRACE_MS, ORDER_CLOSED, ORDER_UNTRACKED, SHIPMENT_CLOSED, SLA_HIGH_MINUTES, SLA_RISK_MINUTES,
)


def _latest(df: DataFrame, key: str, fields: list) -> DataFrame:
    return df.groupBy(key).agg(last_of(fields).alias("v")).select(key, "v.fields.*")


# -- late shipments -----------------------------------------------------------------------------

def is_late(clock: str | int) -> Column:
    """Open, with a known expected delivery that is more than the grace period ago (strictly)."""
    return (~F.col("event_type").isin(*SHIPMENT_CLOSED) & (F.col("expected_delivery") != 0)
            & (now_ms(clock) > F.col("expected_delivery") + LATE_GRACE_MS))


def _late_fields(clock: str | int) -> list:
    over = now_ms(clock) - F.col("expected_delivery") - LATE_GRACE_MS
    return ["customer_id", "warehouse_id", "expected_delivery", F.col("event_type").alias("current_status"),
            "destination_city", "destination_country",
            F.greatest(F.lit(0).cast("long"), whole_minutes(over)).alias("delay_minutes"),
            F.col("timestamp").alias("last_updated")]


def late_shipments(shipment_events: DataFrame, clock: str | int = "event") -> DataFrame:
    """Last late event of every shipment that was ever late. A later delivery does not remove it."""
    return _latest(shipment_events.where(is_late(clock)), "shipment_id", _late_fields(clock))


def late_shipments_open(shipment_events: DataFrame, clock: str | int = "event") -> DataFrame:
    """As ``late_shipments`` without the shipments whose latest event closed them.

    The last late event and the last event come out of the same aggregation.
    """
    both = shipment_events.groupBy("shipment_id").agg(
        last_of(_late_fields(clock), is_late(clock)).alias("late"), last_of(["event_type"]).alias("last"))
    return (both.where(F.col("late").isNotNull() & ~F.col("last.fields.event_type").isin(*SHIPMENT_CLOSED))
            .select("shipment_id", "late.fields.*"))


# -- vehicles -----------------------------------------------------------------------------------

def vehicle_state(vehicle_telemetry: DataFrame) -> DataFrame:
    """Latest position and load per vehicle, flattened.

    ``shipment_ids`` is always empty, as telemetry carries none. ``heading`` and
    ``current_load_volume_m3`` are kept for the enriched view.
    """
    latest = _latest(
        vehicle_telemetry, "vehicle_id", ["driver_id",
        F.col("location.latitude").alias("latitude"), F.col("location.longitude").alias("longitude"),
        F.col("location.speed_kmh").alias("speed_kmh"), F.col("location.heading").alias("heading"),
        "fuel_level_percent", "status", F.col("current_load.weight_kg").alias("current_load_kg"),
        F.col("current_load.shipment_count").alias("current_load_items"),
        F.col("current_load.volume_cubic_m").alias("current_load_volume_m3"),
        "odometer_km", F.col("timestamp").alias("last_updated")])
    return latest.withColumn("shipment_ids", F.array().cast("array<string>"))


# -- orders -------------------------------------------------------------------------------------

def _order_fields() -> list:
    return ["customer_id", "status", "priority", "shipment_ids", "total_items", "sla_timestamp",
            F.col("timestamp").alias("last_updated")]


def _sla_fields(clock: str | int) -> list:
    left = minutes_to_sla(clock)
    return ["customer_id", "priority", F.col("status").alias("current_status"), "sla_timestamp",
            left.alias("time_to_sla_minutes"), left.between(0, SLA_RISK_MINUTES).alias("is_at_risk"),
            (left < 0).alias("is_breached"), F.size("shipment_ids").alias("shipment_count"),
            F.col("timestamp").alias("last_updated")]


def order_state(order_status: DataFrame) -> DataFrame:
    """Latest state per order; ``created_at`` is the time of its first event."""
    return (order_status.groupBy("order_id").agg(
        last_of(_order_fields()).alias("v"), F.min("timestamp").alias("created_at"))
        .select("order_id", "v.fields.*", "created_at"))


def order_is_terminal(status: str = "status") -> Column:
    return F.col(status).isin(*ORDER_CLOSED)


def order_sla_tracking(order_status: DataFrame, clock: str | int = "event") -> DataFrame:
    """Last event of every order that was at risk or past its deadline. Later events do not remove it."""
    return _latest(order_status.where(sla_tracked(clock)), "order_id", _sla_fields(clock))


def _orders_both(order_status: DataFrame, clock: str | int) -> DataFrame:
    return order_status.groupBy("order_id").agg(
        last_of(_order_fields()).alias("state"), F.min("timestamp").alias("created_at"),
        last_of(_sla_fields(clock), sla_tracked(clock)).alias("sla"))


def order_state_with_sla(order_status: DataFrame, clock: str | int = "event") -> DataFrame:
    """``order_state`` plus an ``sla`` struct (null when never tracked), in one aggregation."""
    return _orders_both(order_status, clock).select(
        "order_id", "state.fields.*", "created_at", F.col("sla.fields").alias("sla"))


def order_sla_open(order_status: DataFrame, clock: str | int = "event") -> DataFrame:
    """As ``order_sla_tracking`` without the orders whose latest status ended them."""
    both = _orders_both(order_status, clock)
    return (both.where(F.col("sla").isNotNull() & ~F.col("state.fields.status").isin(*ORDER_UNTRACKED))
            .select("order_id", "sla.fields.*"))


def sla_severity(tracker: DataFrame) -> DataFrame:
    level = (F.when(F.col("is_breached"), "CRITICAL")
             .when(F.col("time_to_sla_minutes") <= SLA_HIGH_MINUTES, "HIGH").otherwise("MEDIUM"))
    return tracker.withColumn("severity", level)
