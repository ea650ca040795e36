"""Orders and their shipments (COR-1..5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewagon.functions.columns import last_of, sla_deadline
from tidewagon.operators.latest import order_state
from tidewagon.schemas import SHIPMENT_CLOSED

# Position of a shipment status on its way; other statuses are at -1.
PROGRESS = {"CREATED": 0, "PICKED": 1, "PACKED": 2, "DISPATCHED": 3, "IN_TRANSIT": 4,
            "OUT_FOR_DELIVERY": 5, "DELIVERED": 6}


def shipment_latest(shipment_events: DataFrame) -> DataFrame:
    """Latest status and warehouse per shipment, and whether it ever had an exception."""
    return (shipment_events.groupBy("shipment_id").agg(
        last_of(["warehouse_id", F.col("event_type").alias("status")]).alias("v"),
        F.bool_or(F.col("event_type") == "EXCEPTION").alias("had_exception"))
        .select("shipment_id", "v.fields.*", "had_exception"))


def order_shipment_links(order_status: DataFrame) -> DataFrame:
    """The (order, shipment) pairs ever reported."""
    return (order_status.select("order_id", F.explode("shipment_ids").alias("shipment_id"))
            .dropDuplicates(["order_id", "shipment_id"]))


def shipment_order_map(order_status: DataFrame) -> DataFrame:
    """Shipment to order: the order that named it last."""
    named = order_status.select("timestamp", "seq", "order_id", F.explode("shipment_ids").alias("shipment_id"))
    return (named.groupBy("shipment_id").agg(last_of(["order_id"]).alias("v"))
            .select("shipment_id", "v.fields.order_id"))


def order_rollup(order_status: DataFrame, shipment_events: DataFrame) -> DataFrame:
    """Order status that follows from the shipments of each order; null when none follows.

    One exception makes it PARTIAL_FAILURE; all cancelled, CANCELLED; otherwise the least advanced of
    the others decides. Unknown shipments are ignored.
    """
    links = order_state(order_status).select("order_id", F.explode_outer("shipment_ids").alias("shipment_id"))
    known = shipment_latest(shipment_events).select("shipment_id", "status", "had_exception")
    steps = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    progress = F.coalesce(steps[F.col("status")], F.lit(-1))
    open_progress = F.when(F.col("status").isNotNull() & (F.col("status") != "CANCELLED"), progress)
    rolled = links.join(known, "shipment_id", "left").groupBy("order_id").agg(
        F.bool_or("had_exception").alias("any_exception"),
        F.bool_and(F.col("status") == "CANCELLED").alias("all_cancelled"),
        F.min(open_progress).alias("least"))
    least = F.col("least")
    return rolled.select(
        "order_id",
        F.when(F.col("any_exception"), "PARTIAL_FAILURE").when(F.col("all_cancelled"), "CANCELLED")
        .when(least >= PROGRESS["DELIVERED"], "DELIVERED").when(least >= PROGRESS["DISPATCHED"], "SHIPPED")
        .alias("derived_status"))


def open_shipments_by_warehouse(shipment_events: DataFrame) -> DataFrame:
    """Shipments not yet closed with their origin warehouse, one row each.

    Kept as rows: a warehouse may hold a large share of all open shipments.
    """
    return (shipment_latest(shipment_events).where(~F.col("status").isin(*SHIPMENT_CLOSED))
            .select("warehouse_id", "shipment_id", "status"))


def pickable_shipments(shipment_events: DataFrame) -> DataFrame:
    return shipment_latest(shipment_events).where("status = 'CREATED'").select("shipment_id", "warehouse_id")


def order_deadlines(order_status: DataFrame) -> DataFrame:
    """Deadline of each order by its priority and the time of its first event."""
    return order_state(order_status).select(
        "order_id", "priority", "created_at",
        sla_deadline(F.col("priority"), F.col("created_at")).alias("deadline"))
