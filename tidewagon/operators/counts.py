"""Shipment counts by status (AGG-1..3) and the look-ups on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewagon.functions.columns import count_where, last_of
from tidewagon.schemas import SHIPMENT_EVENT_TYPES


def status_event_counts(shipment_events: DataFrame) -> DataFrame:
    """Number of events ever seen per status. It counts events, not shipments now in that status."""
    return (shipment_events.groupBy(F.col("event_type").alias("status"))
            .agg(F.count("*").alias("event_count")))


def status_counts_zero_filled(shipment_events: DataFrame) -> DataFrame:
    """As ``status_event_counts`` with a row for every known status, 0 when it never occurred."""
    names = SHIPMENT_EVENT_TYPES
    one = shipment_events.agg(*[count_where(F.col("event_type") == s).alias(s) for s in names])
    return one.unpivot([], list(names), "status", "event_count")


def status_count(shipment_events: DataFrame, status: str) -> DataFrame:
    """Count of one status; 0 and a message when there is none. The filter reaches the scan."""
    wanted = status.strip().upper()
    found = shipment_events.where(F.col("event_type") == wanted).agg(F.count("*").alias("event_count"))
    return found.select(
        F.lit(wanted).alias("status"), "event_count",
        F.when(F.col("event_count") == 0, F.lit(f"No shipments found with status: {wanted}")).alias("message"))


def status_counts_total(shipment_events: DataFrame) -> DataFrame:
    """One row: map of status to event count (at most one entry per known status) and their sum."""
    counts = status_event_counts(shipment_events)
    return counts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "event_count")))).alias("status_counts"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_shipments"))


def current_status_counts(shipment_events: DataFrame) -> DataFrame:
    """Number of shipments per latest status, what the name of the counts view suggests."""
    latest = shipment_events.groupBy("shipment_id").agg(last_of(["event_type"]).alias("v"))
    return latest.groupBy(F.col("v.fields.event_type").alias("status")).agg(F.count("*").alias("shipment_count"))
