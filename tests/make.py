"""Small hand-written event frames."""

from __future__ import annotations

import itertools

T0 = 1_704_067_200_000  # 2024-01-01 00:00 UTC
MIN = 60_000

_SHIP = "seq long, shipment_id string, warehouse_id string, customer_id string, expected_delivery long, " \
        "destination_city string, destination_country string, event_type string, timestamp long"
_ORD = "seq long, order_id string, customer_id string, timestamp long, status string, " \
       "shipment_ids array<string>, total_items int, sla_timestamp long, priority string"
_OPS = "seq long, event_id string, warehouse_id string, timestamp long, operation_type string, quantity int, " \
       "duration_seconds int, errors array<string>"
_TEL = "seq long, vehicle_id string, timestamp long, " \
       "location struct<latitude:double,longitude:double,speed_kmh:double,heading:double>, status string, " \
       "current_load struct<shipment_count:int,weight_kg:double,volume_cubic_m:double>, driver_id string, " \
       "fuel_level_percent double, odometer_km double"


def shipments(spark, rows):
    """rows: dicts with any of the columns; the others get defaults, ``seq`` the position."""
    n = itertools.count()
    data = []
    for r in rows:
        i = next(n)
        ts = r.get("timestamp", T0 + i * MIN)
        data.append((r.get("seq", i), r.get("shipment_id", "SH-1"), r.get("warehouse_id", "WH-A"),
                     r.get("customer_id", "CUST-0001"), r.get("expected_delivery", ts + 600 * MIN), "Oslo", "Norway",
                     r["event_type"], ts))
    return spark.createDataFrame(data, _SHIP)


def orders(spark, rows):
    data = []
    for i, r in enumerate(rows):
        ts = r.get("timestamp", T0 + i * MIN)
        data.append((r.get("seq", i), r.get("order_id", "ORD-1"), r.get("customer_id", "CUST-0001"), ts, r["status"],
                     r.get("shipment_ids", ["SH-1"]), 1, r.get("sla_timestamp", ts + 600 * MIN), r.get("priority", "STANDARD")))
    return spark.createDataFrame(data, _ORD)


def operations(spark, rows):
    data = [(i, f"OP-{i}", r.get("warehouse_id", "WH-A"), r.get("timestamp", T0 + i * MIN), r.get("operation_type", "PICK"),
             r.get("quantity", 1), r.get("duration_seconds", 10), r.get("errors")) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, _OPS)


def telemetry(spark, rows):
    data = [(r.get("seq", i), r.get("vehicle_id", "VEH-001"), r.get("timestamp", T0 + i * MIN),
             (r.get("latitude", 1.0), 2.0, 3.0, 4.0), r.get("status", "IDLE"), (2, r.get("weight_kg", 100.0), 1.0), "DRV-001",
             r.get("fuel", 50.0), 1000.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, _TEL)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
