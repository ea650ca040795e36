"""The named queries: every operator applied to the given tables through the adapters.

Outputs are flat (no structs, maps or arrays) and doubles are rounded, so that they can be compared by
value with another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewagon.functions import ids
from tidewagon.functions.columns import iso_utc
from tidewagon.operators import (
    coordination, counts, customers as cust_ops, fleet, hybrid, late, latest, paging, quality, reference, top, windows,
)
from tidewagon.schemas import OPERATION_TYPES, RETENTION_MS
from tidewagon.session import shared_folder
from tidewagon.sources import builders, tables
from tidewagon.streaming import store, views

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """The streams and reference tables derived from one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _events(self) -> DataFrame:
        return tables.base_events(self.spark, self.folder)

    @property
    def shipments(self) -> DataFrame:
        return tables.shipment_events_from(self._events())

    @property
    def orders(self) -> DataFrame:
        return tables.order_status_from(self._events())

    @property
    def telemetry(self) -> DataFrame:
        return tables.vehicle_telemetry_from(self._events())

    @property
    def operations(self) -> DataFrame:
        return tables.warehouse_operations_from(self._events())

    def stream(self, name: str) -> DataFrame:
        adapt = {"shipment_events": tables.shipment_events_from, "order_status": tables.order_status_from,
                 "vehicle_telemetry": tables.vehicle_telemetry_from,
                 "warehouse_operations": tables.warehouse_operations_from}[name]
        return adapt(tables.base_events_stream(self.spark, self.folder))

    def table(self, name: str) -> DataFrame:
        return getattr(tables, name)(self.spark, self.folder)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(n), 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def _flat_vehicle(df: DataFrame) -> DataFrame:
    return df.drop("shipment_ids")


def _joined(column: str) -> Column:
    return F.array_join(F.array_sort(column), ",").alias(column)


def _flat_order(df: DataFrame) -> DataFrame:
    return df.withColumn("shipment_ids", F.array_join("shipment_ids", ","))


def _flat_metrics(df: DataFrame) -> DataFrame:
    counters = [F.coalesce(F.col("operation_counts")[t], F.lit(0)).alias(windows.operation_column(t))
                for t in OPERATION_TYPES]
    return df.select(*[c for c in df.columns if c != "operation_counts"], *counters)


def _flat_driver(df: DataFrame) -> DataFrame:
    return df.withColumn("certifications", F.array_join("certifications", ","))


# -- composed inputs ------------------------------------------------------------------------------

def _recent_metrics(i: Inputs) -> DataFrame:
    return windows.recent_warehouse_metrics(i.operations)


def _recent_hourly(i: Inputs) -> DataFrame:
    return windows.recent_hourly_performance(i.shipments)


def _vehicle_state(i: Inputs) -> DataFrame:
    return latest.vehicle_state(i.telemetry)


def _customer_overview(i: Inputs) -> DataFrame:
    return hybrid.customer_overview(
        i.table("customers"), cust_ops.shipment_stats_state(i.shipments),
        cust_ops.customer_order_stats(i.orders)).drop("summary")


def _sla_compliance(i: Inputs) -> DataFrame:
    return hybrid.customer_sla_compliance(
        i.table("customers"), cust_ops.customer_order_stats(i.orders),
        latest.order_sla_tracking(i.orders)).drop("summary")


def _driver_tracking(i: Inputs) -> DataFrame:
    live = hybrid.driver_tracking(i.table("drivers"), _vehicle_state(i))
    return live.select(
        "driver_id", "driver_name", "license_type", _joined("certifications"), "status", "assigned_vehicle_id",
        F.col("vehicle_state.status").alias("vehicle_status"), F.col("vehicle_state.speed_kmh").alias("speed_kmh"),
        F.col("vehicle_location.latitude").alias("latitude"), F.col("vehicle_location.longitude").alias("longitude"),
        F.col("vehicle_state.last_updated").alias("last_updated"))


def _enriched_vehicles(i: Inputs) -> DataFrame:
    out = hybrid.enriched_vehicle_state(_vehicle_state(i), i.table("vehicles"), i.table("warehouses"), i.table("drivers"))
    return out.drop("summary").withColumn("certifications", F.array_join("certifications", ","))


def _operational_status(i: Inputs) -> DataFrame:
    out = hybrid.warehouse_operational_status(
        i.table("warehouses"), i.table("vehicles"), i.table("drivers"), _recent_metrics(i), _recent_hourly(i))

    def listed(column: str, value: str) -> Column:
        pairs = F.transform(column, lambda w: F.concat_ws(":", w["window_start"], w[value]))
        return F.coalesce(F.array_join(pairs, ","), F.lit(""))

    return out.select(
        "warehouse_id", "name", "city", "country", "status", "location.latitude", "location.longitude",
        "total_vehicles", "active_vehicles", "total_drivers", "available_drivers",
        listed("realtime_metrics", "total_operations").alias("operations_by_window"),
        listed("hourly_performance", "total_delivered").alias("deliveries_by_window"), "summary")


def _order_details(i: Inputs) -> DataFrame:
    out = _flat_order(hybrid.order_details(i.orders, i.table("customers")))
    return out.select(
        *[c for c in out.columns if c != "sla"], F.col("sla.time_to_sla_minutes").alias("time_to_sla_minutes"),
        F.col("sla.is_at_risk").alias("is_at_risk"), F.col("sla.is_breached").alias("is_breached"),
        F.col("sla.last_updated").alias("sla_last_updated"))


def _status_total(i: Inputs) -> DataFrame:
    out = counts.status_counts_total(i.shipments)
    pairs = F.transform(F.map_entries("status_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select(F.array_join(pairs, ",").alias("status_counts"), "total_shipments")


def _dashboard(i: Inputs) -> DataFrame:
    return fleet.dashboard_summary(
        i.shipments, _vehicle_state(i), i.table("vehicles"), latest.order_state_with_sla(i.orders),
        windows.warehouse_metrics(i.operations))


def _normalized(i: Inputs) -> DataFrame:
    # Every customer row gives one raw id, in one of six spellings.
    raw = F.expr("""case c_custkey % 6 when 0 then c_name when 1 then concat(' cust-', c_custkey, ' ')
        when 2 then lower(c_mktsegment) when 3 then cast(c_custkey * 100000007 + 99999999999 as string)
        when 4 then '  ' else cast(c_custkey as string) end""")
    rows = i.spark.read.parquet(f"{i.folder}/customer.parquet").select("c_custkey", raw.alias("raw"))
    return rows.select(
        "c_custkey", ids.normalize_customer_id(F.col("raw")).alias("as_customer"),
        ids.normalize_vehicle_id(F.col("raw")).alias("as_vehicle"),
        ids.normalize_warehouse_id(F.col("raw")).alias("as_warehouse"),
        ids.normalize_order_id(F.col("raw")).alias("as_order"))


def _delivered_extract(i: Inputs) -> dict[str, DataFrame]:
    """Reference tables as an extract of two systems, whose client numbers overlap."""
    return {"customers": i.table("customers").unionByName(i.table("supplier_clients"))} | {
        t: i.table(t) for t in ("warehouses", "vehicles", "drivers", "routes", "products")}


def _decoded_props(i: Inputs) -> DataFrame:
    """Decode the JSON property column of the events, every ninth cut off on its way, and count by event type."""
    raw = i.spark.read.parquet(f"{i.folder}/events.parquet").select("event_type", F.expr(_CUT_OFF).alias("props"))
    return _decoded_counts(quality.read_json(raw, "props", _PROPS))


def _lenient_props(i: Inputs) -> DataFrame:
    """The same column with a default in place of what cannot be read."""
    raw = i.spark.read.parquet(f"{i.folder}/events.parquet").select("event_type", F.expr(_CUT_OFF).alias("props"))
    read = quality.lenient_fields(raw, "props", {"k": ("int", -1), "missing": ("double", 0.5)})
    return read.groupBy("event_type").agg(F.sum("k").alias("total_k"), F.count_if(F.col("k") == -1).alias("defaults"),
                                          F.sum("missing").alias("total_missing"))


def _order_json(i: Inputs) -> DataFrame:
    state = latest.order_state(i.orders).select(
        "order_id", "customer_id", "status", "priority", "shipment_ids", "total_items", "sla_timestamp",
        "created_at", "last_updated")
    return store.as_json(state)


# -- streams ---------------------------------------------------------------------------------------

def _run_stream(i: Inputs, name: str, retention_ms: int | None = None) -> DataFrame:
    path, checkpoint = shared_folder(i.spark, f"view-{name}"), shared_folder(i.spark, f"offsets-{name}")
    query = views.run_view(name, i.stream(views.VIEWS[name].stream), path, checkpoint, retention_ms=retention_ms)
    query.awaitTermination()
    return views.read(i.spark, name, path, retention_ms)


def _stream(name: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df, retention_ms: int | None = None):
    return lambda i: shape(_run_stream(i, name, retention_ms))


def _measures(view: str, df: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """Rows of a view as (view, key, a, b, c)."""
    return df.select(F.lit(view).alias("view"), F.concat_ws("|", *keys).alias("key"),
                     *[F.col(columns[c]).cast("long").alias(c) for c in ("a", "b", "c")])


def _views_from_one_read(i: Inputs, stream: str, fail_at: tuple[int, str] | None = None) -> dict[str, DataFrame]:
    """All views of a stream. With ``fail_at`` the query dies after that view of that micro-batch, and is started again."""
    folder, checkpoint = shared_folder(i.spark, f"views-{stream}"), shared_folder(i.spark, f"offsets-{stream}")
    names = views.of_stream(stream)

    def die(batch_id: int, name: str) -> None:
        if (batch_id, name) == fail_at:
            raise RuntimeError("stopped on purpose")

    def run(on_written) -> None:
        views.run_views(names, i.stream(stream), folder, checkpoint, retention_ms=None, on_written=on_written).awaitTermination()

    if fail_at is not None:
        try:
            run(die)
        except StreamingQueryException:  # as after the loss of the driver, the checkpoint says what is not committed
            pass
    run(None)
    return {name: views.read(i.spark, name, f"{folder}/{name}", None) for name in names}


def _shipment_views(i: Inputs) -> DataFrame:
    found = _views_from_one_read(i, "shipment_events")
    return reduce(DataFrame.unionByName, [
        _measures("status_event_counts", found["status_event_counts"], ["status"], a="event_count", b="event_count",
                  c="event_count"),
        _measures("customer_shipment_stats", found["customer_shipment_stats"], ["customer_id"], a="in_transit_count",
                  b="late_count", c="last_updated"),
        _measures("late_shipments", found["late_shipments"], ["shipment_id"], a="delay_minutes", b="expected_delivery",
                  c="last_updated"),
        _measures("hourly_delivery_performance", found["hourly_delivery_performance"], ["warehouse_id", "window_start"],
                  a="on_time_count", b="total_delivered", c="total_delivery_time_ms")])


def _resumed_order_views(i: Inputs) -> DataFrame:
    found = _views_from_one_read(i, "order_status", fail_at=(1, "customer_order_stats"))
    return reduce(DataFrame.unionByName, [
        _measures("order_state", found["order_state"], ["order_id"], a="created_at", b="sla_timestamp", c="last_updated"),
        _measures("customer_order_stats", found["customer_order_stats"], ["customer_id"], a="pending_orders", b="shipped_orders",
                  c="at_risk_orders"),
        _measures("order_sla_tracking", found["order_sla_tracking"], ["order_id"], a="time_to_sla_minutes", b="shipment_count",
                  c="last_updated")])


def _native_counts(i: Inputs) -> str:
    """The checkpoint of a finished run of the status counts."""
    path, checkpoint = shared_folder(i.spark, "view-counts"), shared_folder(i.spark, "offsets-counts")
    views.run_view("status_event_counts", i.stream("shipment_events"), path, checkpoint).awaitTermination()
    return checkpoint


def _state_at_batch(i: Inputs) -> DataFrame:
    return views.state_at(i.spark, _native_counts(i), 1).select(F.col("event_type").alias("status"), F.col("count"))


def _view_changes(i: Inputs) -> DataFrame:
    return views.state_changes(i.spark, _native_counts(i)).select(
        F.col("batch_id").cast("long"), F.col("event_type").alias("status"), F.col("before.count").alias("before"),
        F.col("after.count").alias("after"))


# Every ninth property text is cut off on its way.
_CUT_OFF = "case when event_id % 9 = 4 then substr(props, 1, length(props) - 1) else props end"
_PROPS = T.StructType([T.StructField("k", T.IntegerType())])


def _set_aside(i: Inputs) -> DataFrame:
    raw = tables.raw_events_stream(i.spark, i.folder).select("event_type", F.expr(_CUT_OFF).alias("props"))
    good, bad, checkpoint = (shared_folder(i.spark, x) for x in ("decoded", "set-aside", "offsets-decoded"))
    views.run_decoded(raw, "props", _PROPS, good, bad, checkpoint).awaitTermination()
    read = store.read_batches(i.spark, good, T.StructType([*raw.schema.fields, *_PROPS.fields])).withColumn("readable", F.lit(True))
    aside = store.read_batches(i.spark, bad, raw.schema).withColumn("k", F.lit(None).cast("int")).withColumn("readable", F.lit(False))
    return _decoded_counts(read.unionByName(aside))


def _decoded_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("event_type").agg(
        F.count_if("readable").alias("readable"), F.count_if(~F.col("readable")).alias("set_aside"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_k"))


# -- the list --------------------------------------------------------------------------------------

def _keys(i: Inputs, table: str, condition: str, key: str) -> DataFrame:
    return i.table(table).where(condition).select(F.col(key))


def _deep_page(i: Inputs) -> DataFrame:
    products = i.table("products")
    return paging.Pages.of(products, "product_id").page(25, products.count() // 2 + 7)


def _next_page(i: Inputs) -> DataFrame:
    return paging.Pages.of(i.table("products"), "product_id").after("PROD-000100", 25)


# Records come with delays of up to an hour and a half.
_DELAYED = "timestamp + (seq * 7919 % 97) * 60000"


def _late_deliveries(i: Inputs) -> DataFrame:
    return late.late_events(
        i.shipments.where("event_type = 'DELIVERED'").select("seq", "warehouse_id", "timestamp"), [F.expr(_DELAYED), F.col("seq")],
        windows.PERFORMANCE_SIZE_MS, windows.PERFORMANCE_HOP_MS, windows.PERFORMANCE_GRACE_MS)


def _late_operations(i: Inputs) -> DataFrame:
    return late.late_events(
        i.operations.select("seq", "warehouse_id", "timestamp"), [F.expr(_DELAYED), F.col("seq")],
        windows.METRICS_SIZE_MS, windows.METRICS_SIZE_MS, 0, by=("warehouse_id",))


_REFERENCE = {
    "ref_warehouses": lambda i: reference.all_rows(i.table("warehouses"), "warehouses"),
    "ref_warehouse_by_id": lambda i: reference.by_id(i.table("warehouses"), "warehouses", "WH-RTM"),
    "ref_warehouses_by_city": lambda i: reference.warehouses_by_city(i.table("warehouses"), "R"),
    "ref_customers_page": lambda i: reference.customers_page(i.table("customers"), 50, 100),
    "ref_customer_by_id": lambda i: reference.by_id(i.table("customers"), "customers", "CUST-0007"),
    "ref_customers_by_company": lambda i: reference.customers_by_company(i.table("customers"), "CUSTOMER#00000007"),
    "ref_customers_by_tier": lambda i: reference.customers_by_tier(i.table("customers"), "express"),
    "ref_vehicles": lambda i: reference.all_rows(i.table("vehicles"), "vehicles"),
    "ref_vehicle_by_id": lambda i: reference.by_id(i.table("vehicles"), "vehicles", "VEH-007"),
    "ref_vehicles_by_warehouse": lambda i: reference.vehicles_by_warehouse(i.table("vehicles"), "WH-STO"),
    "ref_products_by_category": lambda i: reference.products_by_category(i.table("products"), "economy", 20, 5),
    "ref_products_search": lambda i: reference.products_search(i.table("products"), "RING", 15),
    "ref_drivers": lambda i: reference.all_rows(i.table("drivers"), "drivers"),
    "ref_driver_by_id": lambda i: reference.by_id(i.table("drivers"), "drivers", "DRV-002"),
    "ref_drivers_by_warehouse": lambda i: reference.drivers_by_warehouse(i.table("drivers"), "WH-STO"),
    "ref_drivers_available": lambda i: reference.drivers_available(i.table("drivers")),
    "ref_routes": lambda i: reference.all_rows(i.table("routes"), "routes"),
    "ref_routes_by_origin": lambda i: reference.routes_by_origin(i.table("routes"), "WH-STO"),
    "ref_routes_by_destination": lambda i: reference.routes_by_destination(i.table("routes"), "an"),
    "ref_vehicles_by_warehouse_count": lambda i: reference.with_count(
        reference.vehicles_by_warehouse(i.table("vehicles"), "WH-STO")),
    "ref_drivers_available_count": lambda i: reference.with_count(reference.drivers_available(i.table("drivers"))),
    "ref_routes_by_origin_count": lambda i: reference.with_count(reference.routes_by_origin(i.table("routes"), "WH-STO")),
    "ref_products_category_first": lambda i: reference.products_query(i.table("products"), "standard", "ring", 12),
    "ref_products_search_next": lambda i: reference.products_query(i.table("products"), " ", "ring", 12),
    "ref_products_listed": lambda i: reference.products_query(i.table("products"), limit=12),
    "ref_products_page_deep": _deep_page,
    "ref_products_page_next": _next_page,
    "ref_distinct_destinations": lambda i: reference.distinct_destinations(i.table("routes")),
}

_ALL: dict[str, Callable[[Inputs], DataFrame]] = {
    # counts
    "status_event_counts": lambda i: counts.status_event_counts(i.shipments),
    "status_counts_zero_filled": lambda i: counts.status_counts_zero_filled(i.shipments),
    "status_counts_total": _status_total,
    "status_count": lambda i: counts.status_count(i.shipments, "delivered"),
    "current_status_counts": lambda i: counts.current_status_counts(i.shipments),
    # per-key state
    "customer_shipment_stats": lambda i: cust_ops.customer_shipment_stats(i.shipments),
    "customer_order_stats": lambda i: cust_ops.customer_order_stats(i.orders),
    "late_shipments": lambda i: latest.late_shipments(i.shipments),
    "late_shipments_open": lambda i: latest.late_shipments_open(i.shipments),
    "vehicle_state": lambda i: _flat_vehicle(_vehicle_state(i)),
    "order_state": lambda i: _flat_order(latest.order_state(i.orders)),
    "order_terminal": lambda i: latest.order_state(i.orders).select(
        "order_id", latest.order_is_terminal().alias("is_terminal")),
    "order_state_json": _order_json,
    "order_sla_tracking": lambda i: latest.order_sla_tracking(i.orders),
    "order_sla_open": lambda i: latest.order_sla_open(i.orders),
    "sla_severity": lambda i: latest.sla_severity(latest.order_sla_tracking(i.orders)),
    # windows
    "hourly_delivery_performance": lambda i: windows.hourly_delivery_performance(i.shipments),
    "warehouse_metrics": lambda i: _flat_metrics(windows.warehouse_metrics(i.operations)),
    "last_windows_metrics": lambda i: _flat_metrics(_recent_metrics(i)),
    "last_windows_hourly": _recent_hourly,
    "late_deliveries": _late_deliveries,
    "late_operations": _late_operations,
    "latest_window": lambda i: _flat_metrics(windows.latest_window(windows.warehouse_metrics(i.operations))),
    # summaries
    "fleet_status": lambda i: fleet.fleet_status(_vehicle_state(i)),
    "fleet_first": lambda i: _flat_vehicle(fleet.fleet_first(_vehicle_state(i))),
    "fleet_utilization": lambda i: fleet.fleet_utilization(_vehicle_state(i)),
    "warehouse_resource_counts": lambda i: fleet.warehouse_resource_counts(
        i.table("warehouses"), i.table("vehicles"), i.table("drivers"), active=("AVAILABLE", "IN_USE")),
    "table_row_counts": lambda i: fleet.table_row_counts({t: i.table(t) for t in reference.COLUMNS}),
    "dashboard_summary": _dashboard,
    "dashboard_alerts": lambda i: fleet.dashboard_alerts(
        latest.late_shipments(i.shipments), latest.order_sla_tracking(i.orders)),
    "network_performance": lambda i: fleet.network_performance(_recent_hourly(i), _recent_metrics(i)),
    "network_coverage": lambda i: fleet.network_coverage(
        fleet.network_performance(_recent_hourly(i), _recent_metrics(i))),
    # joins
    "customer_overview": _customer_overview,
    "late_shipments_for_company": lambda i: hybrid.late_shipments_for_company(
        latest.late_shipments(i.shipments), i.table("customers"), i.table("warehouses"), "customer#00000001"),
    "customer_sla_compliance": _sla_compliance,
    "customer_tracked_orders": lambda i: hybrid.customer_tracked_orders(
        i.table("customers"), latest.order_sla_tracking(i.orders)),
    "enriched_vehicle_state": _enriched_vehicles,
    "driver_tracking": _driver_tracking,
    "warehouse_operational_status": _operational_status,
    "order_details": _order_details,
    # look-ups of many keys
    "lookup_vehicle_state": lambda i: _flat_vehicle(hybrid.lookup_many(
        _vehicle_state(i), _keys(i, "drivers", "status = 'AVAILABLE'", "assigned_vehicle_id")
        .withColumnRenamed("assigned_vehicle_id", "vehicle_id"), "vehicle_id")),
    "lookup_customer_shipment_stats": lambda i: cust_ops.customer_shipment_stats(hybrid.of_keys(
        i.shipments, _keys(i, "customers", "sla_tier = 'CRITICAL'", "customer_id"), "customer_id")),
    "lookup_late_shipments": lambda i: latest.late_shipments(hybrid.of_keys(
        i.shipments, i.operations.where(F.size("errors") > 0), "shipment_id")),
    "lookup_warehouse_metrics": lambda i: _flat_metrics(windows.recent_warehouse_metrics(hybrid.of_keys(
        i.operations, _keys(i, "warehouses", "country <> 'Spain'", "warehouse_id"), "warehouse_id"),
        windows.stream_time(i.operations))),
    "lookup_hourly_performance": lambda i: windows.recent_hourly_performance(hybrid.of_keys(
        i.shipments, _keys(i, "warehouses", "country <> 'Spain'", "warehouse_id"), "warehouse_id"),
        windows.stream_time(i.shipments)),
    "lookup_order_state": lambda i: _flat_order(latest.order_state(hybrid.of_keys(
        i.orders, i.orders.where("status = 'CANCELLED'"), "order_id"))),
    "lookup_customer_order_stats": lambda i: cust_ops.customer_order_stats(hybrid.of_keys(
        i.orders, _keys(i, "customers", "account_status = 'SUSPENDED'", "customer_id"), "customer_id")),
    "lookup_order_sla_tracking": lambda i: latest.order_sla_tracking(hybrid.of_keys(
        i.orders, i.orders.where("priority = 'CRITICAL'"), "order_id")),
    # look-ups of one key
    "lookup_one_vehicle_state": lambda i: _flat_vehicle(hybrid.lookup(_vehicle_state(i), "vehicle_id", "VEH-007")),
    "lookup_one_customer_shipment_stats": lambda i: hybrid.lookup(
        cust_ops.customer_shipment_stats(hybrid.lookup(i.shipments, "customer_id", "CUST-0007")), "customer_id", "CUST-0007"),
    "lookup_one_customer_order_stats": lambda i: hybrid.lookup(
        cust_ops.customer_order_stats(hybrid.lookup(i.orders, "customer_id", "CUST-0007")), "customer_id", "CUST-0007"),
    "lookup_one_late_shipment": lambda i: hybrid.lookup(latest.late_shipments(i.shipments), "shipment_id", "SH-7-3"),
    "lookup_one_order_state": lambda i: _flat_order(hybrid.lookup(latest.order_state(i.orders), "order_id", "ORD-00037")),
    "lookup_one_order_sla": lambda i: hybrid.lookup(latest.order_sla_tracking(i.orders), "order_id", "ORD-00037"),
    "lookup_one_warehouse_metrics": lambda i: _flat_metrics(
        windows.recent_warehouse_metrics(i.operations, warehouse_id="WH-STO")),
    "lookup_one_hourly_performance": lambda i: windows.recent_hourly_performance(i.shipments, warehouse_id="WH-STO"),
    # reference tables
    **_REFERENCE,
    "insert_if_absent": lambda i: builders.insert_if_absent(
        i.table("customers"), i.table("supplier_clients"), "customer_id"),
    "normalize_ids": _normalized,
    "customer_search_top": lambda i: top.customer_search_top(
        reference.customers_by_company(i.table("customers"), "customer#0000000")),
    "late_top_k": lambda i: top.late_top(latest.late_shipments(i.shipments)),
    "at_risk_top_k": lambda i: top.at_risk_top(latest.order_sla_tracking(i.orders)),
    # orders and shipments
    "order_rollup": lambda i: coordination.order_rollup(i.orders, i.shipments),
    "open_shipments_by_warehouse": lambda i: coordination.open_shipments_by_warehouse(i.shipments),
    "pickable_shipments": lambda i: coordination.pickable_shipments(i.shipments),
    "order_shipment_links": lambda i: coordination.order_shipment_links(i.orders),
    "shipment_order_map": lambda i: coordination.shipment_order_map(i.orders),
    "order_deadlines": lambda i: coordination.order_deadlines(i.orders),
    # data quality
    "lifecycle_violations": lambda i: quality.lifecycle_violations(i.shipments),
    "reference_violations": lambda i: quality.reference_violations(_delivered_extract(i)),
    "decoded_props": _decoded_props,
    "lenient_props": _lenient_props,
    "event_times_iso": lambda i: i.shipments.select(
        "seq", iso_utc(F.col("timestamp")).alias("at"), iso_utc(F.col("expected_delivery")).alias("expected_at")),
    # streams, read back from their views
    "stream_status_event_counts": _stream("status_event_counts"),
    "stream_customer_shipment_stats": _stream("customer_shipment_stats", lambda df: df.drop("on_time_count")),
    "stream_late_shipments": _stream("late_shipments"),
    "stream_hourly_performance": _stream("hourly_delivery_performance"),
    "stream_vehicle_state": _stream("vehicle_state", _flat_vehicle),
    "stream_warehouse_metrics": _stream("warehouse_metrics", _flat_metrics),
    "stream_order_state": _stream("order_state", _flat_order),
    "stream_customer_order_stats": _stream("customer_order_stats"),
    "stream_order_sla_tracking": _stream("order_sla_tracking"),
    "stream_recent_hourly": _stream("hourly_delivery_performance", retention_ms=RETENTION_MS),
    "stream_recent_metrics": _stream("warehouse_metrics", _flat_metrics, RETENTION_MS),
    "stream_shipment_views": _shipment_views,
    "stream_resumed_order_views": _resumed_order_views,
    "stream_state_at_batch": _state_at_batch,
    "view_changes": _view_changes,
    "stream_set_aside": _set_aside,
}
# Flattening of collections in reference results that carry them.
_SHAPES = {"ref_drivers": _flat_driver, "ref_driver_by_id": _flat_driver, "ref_drivers_by_warehouse": _flat_driver,
           "ref_drivers_available": _flat_driver}


def _query(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _rounded(_SHAPES.get(name, lambda df: df)(_ALL[name](Inputs(spark, folder))))
    run.__name__ = name
    return run


def named_queries() -> dict[str, Query]:
    return {name: _query(name) for name in _ALL}
