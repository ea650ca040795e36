"""Declared schemas and fixed value sets of the four event streams and six reference tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Status, priority and type symbols of the data model.
SHIPMENT_EVENT_TYPES = (
    "CREATED", "PICKED", "PACKED", "DISPATCHED", "IN_TRANSIT",
    "OUT_FOR_DELIVERY", "DELIVERED", "EXCEPTION", "CANCELLED",
)
ORDER_STATUSES = (
    "RECEIVED", "VALIDATED", "ALLOCATED", "SHIPPED", "DELIVERED",
    "CANCELLED", "RETURNED", "PARTIAL_FAILURE",
)
ORDER_PRIORITIES = ("STANDARD", "EXPRESS", "SAME_DAY", "CRITICAL")
VEHICLE_STATUSES = ("IDLE", "EN_ROUTE", "LOADING", "UNLOADING", "MAINTENANCE")
OPERATION_TYPES = (
    "RECEIVING", "PUTAWAY", "PICK", "PACK", "LOAD", "INVENTORY_ADJUSTMENT", "CYCLE_COUNT",
)
SLA_TIERS = ("STANDARD", "EXPRESS", "SAME_DAY", "CRITICAL")
ACCOUNT_STATUSES = ("ACTIVE", "SUSPENDED", "CLOSED")
VEHICLE_TYPES = ("VAN", "BOX_TRUCK", "SEMI_TRAILER")
FLEET_STATUSES = ("AVAILABLE", "IN_USE", "MAINTENANCE", "RETIRED")
FUEL_TYPES = ("DIESEL", "ELECTRIC", "HYBRID")
LICENSE_TYPES = ("B", "C", "CE")
DRIVER_STATUSES = ("AVAILABLE", "ON_DUTY", "OFF_DUTY", "VACATION")
ROUTE_TYPES = ("DIRECT", "HUB_SPOKE", "MULTI_STOP")

# Status groups and thresholds.
SHIPMENT_CLOSED = ("DELIVERED", "CANCELLED")
ORDER_CLOSED = ("DELIVERED", "CANCELLED", "RETURNED")
ORDER_UNTRACKED = ("DELIVERED", "CANCELLED", "RETURNED", "PARTIAL_FAILURE")
VEHICLE_ACTIVE = ("EN_ROUTE", "LOADING", "UNLOADING")
MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS
LATE_GRACE_MS = 30 * MINUTE_MS
SLA_RISK_MINUTES = 60
SLA_HIGH_MINUTES = 30
RETENTION_MS = 6 * HOUR_MS
NEWEST_WINDOWS = 4

# Partition column of stored events: the UTC day.
DAY = "day"

# Hours granted per order priority.
SLA_HOURS = {"STANDARD": 120, "EXPRESS": 48, "SAME_DAY": 12, "CRITICAL": 4}

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], True) for f in fields])


SHIPMENT_EVENTS = _struct(
    ("shipment_id", _S), ("warehouse_id", _S), ("customer_id", _S), ("expected_delivery", _L),
    ("destination_city", _S), ("destination_country", _S), ("event_type", _S), ("timestamp", _L),
)
VEHICLE_TELEMETRY = _struct(
    ("vehicle_id", _S), ("timestamp", _L),
    ("location", _struct(("latitude", _D), ("longitude", _D), ("speed_kmh", _D), ("heading", _D))),
    ("status", _S),
    ("current_load", _struct(("shipment_count", _I), ("weight_kg", _D), ("volume_cubic_m", _D))),
    ("driver_id", _S), ("fuel_level_percent", _D), ("odometer_km", _D),
)
WAREHOUSE_OPERATIONS = _struct(
    ("event_id", _S), ("warehouse_id", _S), ("timestamp", _L), ("operation_type", _S),
    ("operator_id", _S), ("product_id", _S), ("quantity", _I), ("location", _S),
    ("shipment_id", _S), ("duration_seconds", _I), ("errors", T.ArrayType(_S)),
)
ORDER_STATUS = _struct(
    ("order_id", _S), ("customer_id", _S), ("timestamp", _L), ("status", _S),
    ("shipment_ids", T.ArrayType(_S)), ("total_items", _I), ("sla_timestamp", _L), ("priority", _S),
)

# Stream name -> (topic, key column, record schema). ``seq`` (arrival order) is added by the readers.
STREAMS = {
    "shipment_events": ("shipment.events", "shipment_id", SHIPMENT_EVENTS),
    "vehicle_telemetry": ("vehicle.telemetry", "vehicle_id", VEHICLE_TELEMETRY),
    "warehouse_operations": ("warehouse.operations", "warehouse_id", WAREHOUSE_OPERATIONS),
    "order_status": ("order.status", "order_id", ORDER_STATUS),
}
# (stream, column) -> symbols, for the columns that are enumerations on the wire.
STREAM_ENUMS = {
    ("shipment_events", "event_type"): SHIPMENT_EVENT_TYPES,
    ("vehicle_telemetry", "status"): VEHICLE_STATUSES,
    ("warehouse_operations", "operation_type"): OPERATION_TYPES,
    ("order_status", "status"): ORDER_STATUSES,
    ("order_status", "priority"): ORDER_PRIORITIES,
}


def _dec(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


WAREHOUSES = _struct(
    ("warehouse_id", _S), ("name", _S), ("city", _S), ("country", _S),
    ("latitude", _dec(10, 8)), ("longitude", _dec(11, 8)), ("status", _S),
    ("created_at", T.TimestampType()),
)
CUSTOMERS = _struct(
    ("customer_id", _S), ("company_name", _S), ("contact_email", _S), ("sla_tier", _S),
    ("account_status", _S), ("created_at", T.TimestampType()),
)
VEHICLES = _struct(
    ("vehicle_id", _S), ("vehicle_type", _S), ("license_plate", _S), ("capacity_kg", _dec(10, 2)),
    ("capacity_cubic_m", _dec(8, 2)), ("home_warehouse_id", _S), ("status", _S), ("fuel_type", _S),
    ("created_at", T.TimestampType()),
)
PRODUCTS = _struct(
    ("product_id", _S), ("sku", _S), ("name", _S), ("category", _S), ("weight_kg", _dec(8, 3)),
    ("length_cm", _dec(8, 2)), ("width_cm", _dec(8, 2)), ("height_cm", _dec(8, 2)),
    ("unit_price", _dec(10, 2)), ("created_at", T.TimestampType()),
)
DRIVERS = _struct(
    ("driver_id", _S), ("first_name", _S), ("last_name", _S), ("license_type", _S),
    ("certifications", T.ArrayType(_S)), ("assigned_vehicle_id", _S), ("home_warehouse_id", _S),
    ("status", _S), ("created_at", T.TimestampType()),
)
ROUTES = _struct(
    ("route_id", _S), ("origin_warehouse_id", _S), ("destination_city", _S),
    ("destination_country", _S), ("distance_km", _dec(10, 2)), ("estimated_hours", _dec(6, 2)),
    ("route_type", _S), ("active", T.BooleanType()), ("created_at", T.TimestampType()),
)
# Table -> (primary key, schema).
REFERENCE = {
    "warehouses": ("warehouse_id", WAREHOUSES),
    "customers": ("customer_id", CUSTOMERS),
    "vehicles": ("vehicle_id", VEHICLES),
    "products": ("product_id", PRODUCTS),
    "drivers": ("driver_id", DRIVERS),
    "routes": ("route_id", ROUTES),
}
