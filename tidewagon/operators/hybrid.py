"""Live views joined with reference tables (JOIN-1..8), for all keys at once.

Plain equi-joins: Spark broadcasts a side only when its size estimate (at run time, its measured
shuffle size) is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge joins, with
adaptive splitting of skewed partitions. A filter on a key reaches both scans, so the same functions
serve the single-key form: ``customer_overview(customers.where(...), ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.functions.columns import array_or_empty, like_term, percent
from tidewagon.operators.fleet import warehouse_resource_counts
from tidewagon.operators.latest import order_state_with_sla
from tidewagon.operators.windows import nested_windows


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]


def _compliance(at_risk: str, total: str) -> Column:
    """Share of orders not at risk. The risk counts events or tracker rows, so it can fall below 0."""
    return (F.when(F.col(total) > 0, (F.lit(1.0) - F.col(at_risk) / F.col(total)) * 100)
            .otherwise(F.lit(100.0)))


def customer_overview(customers: DataFrame, shipment_stats: DataFrame, order_stats: DataFrame) -> DataFrame:
    """Every customer with its shipment and order counters, 0 where it has none.

    ``shipment_stats`` needs ``on_time_count`` (``customers.shipment_stats_state``).
    """
    ship = shipment_stats.select(
        "customer_id", "total_shipments", "on_time_count",
        F.col("delivered_count").alias("delivered_shipments"),
        F.col("in_transit_count").alias("in_transit_shipments"),
        F.col("exception_count").alias("exception_shipments"))
    orders = order_stats.select("customer_id", "total_orders", "pending_orders", "shipped_orders",
                                "delivered_orders", "at_risk_orders")
    who = ["customer_id", "company_name", "contact_email", "sla_tier", "account_status"]
    joined = (customers.select(*who).join(ship, "customer_id", "left").join(orders, "customer_id", "left")
              .select(*who, *_zero("total_shipments", "delivered_shipments", "in_transit_shipments",
                                   "exception_shipments", "on_time_count", "total_orders", "pending_orders",
                                   "shipped_orders", "delivered_orders", "at_risk_orders")))
    out = (joined
           .withColumn("shipment_on_time_rate", percent(F.col("on_time_count"), F.col("delivered_shipments"), 0.0))
           .withColumn("sla_compliance_rate", _compliance("at_risk_orders", "total_orders"))
           .drop("on_time_count"))
    return out.withColumn("summary", F.format_string(
        "%s, tier %s: %d orders and %d shipments, %.1f%% of the orders without risk",
        "company_name", "sla_tier", "total_orders", "total_shipments", "sla_compliance_rate"))


def late_shipments_for_company(late: DataFrame, customers: DataFrame, warehouses: DataFrame,
                               company: str, literal: bool = False) -> DataFrame:
    """Late shipments of the customers whose company name contains the term, with both reference rows."""
    matched = customers.where(like_term(F.col("company_name"), company, literal)).select(
        "customer_id", "company_name", "sla_tier", "contact_email")
    sites = warehouses.select("warehouse_id", F.col("name").alias("warehouse_name"),
                              F.col("city").alias("warehouse_city"))
    return late.join(matched, "customer_id").join(sites, "warehouse_id", "left").select(
        *late.columns, "company_name", "sla_tier", "contact_email", "warehouse_name", "warehouse_city")


def customer_sla_compliance(customers: DataFrame, order_stats: DataFrame, tracker: DataFrame) -> DataFrame:
    """Compliance from the number of tracked orders, at risk or breached, of each customer.

    The tracked orders themselves are ``customer_tracked_orders``: as rows, since one customer may
    own a large share of them.
    """
    counted = tracker.groupBy("customer_id").agg(F.count("*").alias("at_risk_orders_count"))
    stats = order_stats.select("customer_id", "total_orders", "pending_orders", "shipped_orders",
                               "delivered_orders", "cancelled_orders", "returned_orders", "at_risk_orders")
    who = ["customer_id", "company_name", "sla_tier"]
    joined = (customers.select(*who).join(stats, "customer_id", "left").join(counted, "customer_id", "left")
              .select(*who, *_zero(*stats.columns[1:], "at_risk_orders_count")))
    return (joined.withColumn("sla_compliance_rate", _compliance("at_risk_orders_count", "total_orders"))
            .withColumn("summary", F.format_string(
                "%s: %.1f%% of the orders keep their deadline, %d are tracked",
                "company_name", "sla_compliance_rate", "at_risk_orders_count")))


def customer_tracked_orders(customers: DataFrame, tracker: DataFrame) -> DataFrame:
    """The at-risk and breached orders with their customer, one row each."""
    return customers.select("customer_id", "company_name", "sla_tier").join(tracker, "customer_id")


def enriched_vehicle_state(vehicle_state: DataFrame, vehicles: DataFrame, warehouses: DataFrame,
                           drivers: DataFrame) -> DataFrame:
    """Live vehicles with their reference row, home warehouse and first assigned driver (by id)."""
    fixed = vehicles.select(
        "vehicle_id", "vehicle_type", "license_plate", F.col("capacity_kg").cast("double").alias("capacity_kg"),
        F.col("capacity_cubic_m").cast("double").alias("capacity_cubic_m"), "home_warehouse_id", "fuel_type")
    sites = warehouses.select(F.col("warehouse_id").alias("home_warehouse_id"),
                              F.col("name").alias("home_warehouse_name"), F.col("city").alias("home_warehouse_city"))
    first = (drivers.where(F.col("assigned_vehicle_id").isNotNull())
             .groupBy(F.col("assigned_vehicle_id").alias("vehicle_id"))
             .agg(F.min_by(F.struct("driver_id", F.concat_ws(" ", "first_name", "last_name").alias("driver_name"),
                                    "license_type", "certifications"), "driver_id").alias("driver"))
             .select("vehicle_id", "driver.*"))
    live = vehicle_state.select(
        "vehicle_id", "status", "latitude", "longitude", "speed_kmh", "heading", "fuel_level_percent",
        "current_load_kg", "current_load_volume_m3", F.col("last_updated").alias("telemetry_timestamp"))
    share = F.when(F.col("capacity_kg") > 0, F.col("current_load_kg") / F.col("capacity_kg") * 100)
    joined = (live.join(fixed, "vehicle_id").join(first, "vehicle_id", "left")
              .join(sites, "home_warehouse_id", "left")
              .withColumn("load_percentage", F.coalesce(share, F.lit(0.0))))
    return joined.withColumn("summary", F.format_string(
        "%s, a %s, is %s with %.1f%% of its load and driven by %s", "vehicle_id", "vehicle_type", "status",
        "load_percentage", F.coalesce("driver_name", F.lit("nobody"))))


def driver_tracking(drivers: DataFrame, vehicle_state: DataFrame) -> DataFrame:
    """Every driver with the state of the assigned vehicle; null structs when there is none."""
    fields = [c for c in vehicle_state.columns if c != "vehicle_id"]
    live = vehicle_state.select(
        F.col("vehicle_id").alias("assigned_vehicle_id"), F.struct("vehicle_id", *fields).alias("vehicle_state"),
        F.struct("latitude", "longitude").alias("vehicle_location"))
    return (drivers.join(live, "assigned_vehicle_id", "left").select(
        "driver_id", F.concat_ws(" ", "first_name", "last_name").alias("driver_name"), "license_type",
        array_or_empty(F.col("certifications")).alias("certifications"), "status", "assigned_vehicle_id",
        "vehicle_state", "vehicle_location"))


def warehouse_operational_status(warehouses: DataFrame, vehicles: DataFrame, drivers: DataFrame,
                                 recent_metrics: DataFrame, recent_hourly: DataFrame) -> DataFrame:
    """Every warehouse with its resources and its newest windows, nested oldest first."""
    sites = warehouses.select(
        "warehouse_id", "name", "city", "country", "status",
        F.struct(F.col("latitude").cast("double").alias("latitude"),
                 F.col("longitude").cast("double").alias("longitude")).alias("location"))
    counts = warehouse_resource_counts(warehouses, vehicles, drivers)
    joined = (sites.join(counts, "warehouse_id")
              .join(nested_windows(recent_metrics, "realtime_metrics"), "warehouse_id", "left")
              .join(nested_windows(recent_hourly, "hourly_performance"), "warehouse_id", "left"))
    return joined.withColumn("summary", F.format_string(
        "%s in %s has %d vehicles and %d drivers and is %s", "name", "city", "total_vehicles",
        "total_drivers", "status"))


def order_details(order_status: DataFrame, customers: DataFrame, clock: str | int = "event") -> DataFrame:
    """Order state with customer and SLA tracking. State and tracking come from one aggregation."""
    who = customers.select("customer_id", "company_name", "sla_tier", "contact_email")
    joined = order_state_with_sla(order_status, clock).join(who, "customer_id", "left")
    return joined.withColumn("summary", F.format_string(
        "%s stands at %s for %s", "order_id", "status",
        F.coalesce("company_name", "customer_id")))


def lookup(view: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of one key. The filter on a grouping key moves below the aggregation to the scan."""
    return view.where(F.col(key) == value)


def of_keys(events: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The events of the keys in ``keys``. Build a view from these to look many keys up: the view then
    orders and aggregates the wanted keys only."""
    return events.join(keys.select(key).distinct(), key, "left_semi")


def lookup_many(view: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the view whose key is in ``keys``."""
    return view.join(keys.select(key), key, "left_semi")
