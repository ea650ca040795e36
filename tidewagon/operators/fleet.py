"""Fleet, warehouse and dashboard summaries (AGG-15..20)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tidewagon.functions.columns import count_where, percent
from tidewagon.operators.latest import is_late
from tidewagon.operators.top import top_with_total
from tidewagon.operators.windows import latest_window
from tidewagon.schemas import VEHICLE_ACTIVE

FLEET_SHOWN = 20
ALERTS_SHOWN = 5
PENDING = ("RECEIVED", "VALIDATED", "ALLOCATED")


def fleet_status(vehicle_state: DataFrame) -> DataFrame:
    """Vehicles per status, with the fleet size on every row."""
    # The view is read once; the window runs over one row per status.
    groups = vehicle_state.groupBy("status").agg(F.count("*").alias("vehicle_count"))
    return groups.withColumn("total_vehicles", F.sum("vehicle_count").over(Window.partitionBy())).where(
        F.col("status").isNotNull())


def fleet_first(vehicle_state: DataFrame, limit: int = FLEET_SHOWN) -> DataFrame:
    """The first vehicles by id, with the size of the whole fleet."""
    return top_with_total(vehicle_state, [F.col("vehicle_id")], limit)


def fleet_utilization(vehicle_state: DataFrame) -> DataFrame:
    """One row: how much of the fleet is at work, and its mean load and fuel level."""
    status = F.col("status")
    one = vehicle_state.agg(
        F.count("*").alias("total_vehicles"),
        count_where(status.isin(*VEHICLE_ACTIVE)).alias("active_vehicles"),
        count_where(status == "IDLE").alias("idle_vehicles"),
        count_where(status == "MAINTENANCE").alias("maintenance_vehicles"),
        F.coalesce(F.avg("current_load_kg"), F.lit(0.0)).alias("average_load_kg"),
        F.coalesce(F.avg("fuel_level_percent"), F.lit(0.0)).alias("average_fuel_level"))
    return one.withColumn("utilization_rate", percent(F.col("active_vehicles"), F.col("total_vehicles"), 0.0))


def warehouse_resource_counts(warehouses: DataFrame, vehicles: DataFrame, drivers: DataFrame,
                              active: tuple = ("IN_USE",)) -> DataFrame:
    """Vehicles and drivers at home in each warehouse. ``active`` names the vehicle statuses at work."""
    v = vehicles.groupBy(F.col("home_warehouse_id").alias("warehouse_id")).agg(
        F.count("*").alias("total_vehicles"), count_where(F.col("status").isin(*active)).alias("active_vehicles"))
    d = drivers.groupBy(F.col("home_warehouse_id").alias("warehouse_id")).agg(
        F.count("*").alias("total_drivers"), count_where(F.col("status") == "AVAILABLE").alias("available_drivers"))
    names = ["total_vehicles", "active_vehicles", "total_drivers", "available_drivers"]
    return (warehouses.select("warehouse_id").join(v, "warehouse_id", "left").join(d, "warehouse_id", "left")
            .select("warehouse_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]))


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each named table; counting needs no columns, so only file footers are read."""
    counts = [df.agg(F.count("*").alias("record_count")).select(F.lit(name).alias("table_name"), "record_count")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def _cards(section: str, one_row: DataFrame) -> DataFrame:
    wide = one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns])
    return wide.unpivot([], wide.columns, "metric", "value").select(
        F.lit(section).alias("section"), "metric", "value")


def shipment_cards(shipment_events: DataFrame, clock: str | int = "event") -> DataFrame:
    """One row: events in transit, delivered and created, and shipments that were ever late, from one scan.

    Events add up per shipment first, before the shuffle, which counts a late shipment once.
    """
    kind = F.col("event_type")
    counted = {"in_transit": "IN_TRANSIT", "delivered": "DELIVERED", "created": "CREATED"}
    each = shipment_events.groupBy("shipment_id").agg(
        *[count_where(kind == value).alias(name) for name, value in counted.items()], F.max(is_late(clock)).alias("was_late"))
    return each.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counted], count_where(F.col("was_late")).alias("late"))


def dashboard_summary(shipment_events: DataFrame, vehicle_state: DataFrame, vehicles: DataFrame,
                      order_state_with_sla: DataFrame, warehouse_metrics: DataFrame, clock: str | int = "event") -> DataFrame:
    """The dashboard figures as (section, metric, value) rows. Every stream behind the arguments is read once.

    Uses the status names that occur: EN_ROUTE, LOADING and UNLOADING vehicles are active; RECEIVED,
    VALIDATED and ALLOCATED orders are pending.
    """
    status = F.col("status")
    load = F.when(F.col("capacity_kg") > 0, F.col("current_load_kg") / F.col("capacity_kg").cast("double") * 100)
    fleet = vehicle_state.join(vehicles.select("vehicle_id", "capacity_kg"), "vehicle_id", "left")
    parts = [
        _cards("shipments", shipment_cards(shipment_events, clock)),
        _cards("vehicles", fleet.agg(
            count_where(status.isin(*VEHICLE_ACTIVE)).alias("active"),
            count_where(status == "IDLE").alias("idle"),
            count_where(status == "MAINTENANCE").alias("maintenance"),
            F.avg(load).alias("average_load_percent"))),
        _cards("orders", order_state_with_sla.agg(
            count_where(status.isin(*PENDING)).alias("pending"),
            count_where(status == "SHIPPED").alias("shipped"),
            F.count("sla").alias("at_risk"))),
        latest_window(warehouse_metrics).select(
            F.lit("warehouse_operations").alias("section"), F.col("warehouse_id").alias("metric"),
            F.col("total_operations").cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dashboard_alerts(late: DataFrame, tracker: DataFrame, limit: int = ALERTS_SHOWN) -> DataFrame:
    """The most delayed shipments and the orders with the least time left, a few of each."""
    worst = late.orderBy(F.desc("delay_minutes"), "shipment_id").limit(limit).select(
        F.lit("late").alias("kind"), F.col("shipment_id").alias("id"), F.col("delay_minutes").alias("minutes"))
    next_due = tracker.orderBy("time_to_sla_minutes", "order_id").limit(limit).select(
        F.lit("sla").alias("kind"), F.col("order_id").alias("id"), F.col("time_to_sla_minutes").alias("minutes"))
    return worst.unionByName(next_due)


def network_performance(recent_hourly: DataFrame, recent_metrics: DataFrame) -> DataFrame:
    """Per warehouse the totals of its newest windows, for every warehouse that has either view."""
    hourly = recent_hourly.groupBy("warehouse_id").agg(
        F.count("*").alias("hourly_windows"), F.sum("total_delivered").alias("delivered"),
        F.sum("on_time_count").alias("on_time"))
    metrics = recent_metrics.groupBy("warehouse_id").agg(
        F.count("*").alias("metric_windows"), F.sum("total_operations").alias("operations"),
        F.sum("error_count").alias("errors"))
    zero = ["hourly_windows", "delivered", "on_time", "metric_windows", "operations", "errors"]
    return hourly.join(metrics, "warehouse_id", "full").select(
        "warehouse_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero])


def network_coverage(network: DataFrame) -> DataFrame:
    """One row: number of warehouses with data in each view."""
    return network.agg(
        count_where(F.col("hourly_windows") > 0).alias("warehouses_with_performance_data"),
        count_where(F.col("metric_windows") > 0).alias("warehouses_with_metrics_data"))
