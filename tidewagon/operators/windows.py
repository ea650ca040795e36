"""Time-window views (WIN-1..4).

Times are epoch millis. On a batch frame the windows are plain arithmetic on the event time; on a
stream they use ``window`` with a watermark, whose delay is the grace period of the view. A watermark
moves once per micro-batch and for the whole query, and lateness is judged by its value one batch
before, so a late row can still count where an engine that moves its clock per record would drop it;
for input in order the results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewagon.functions.columns import count_where
from tidewagon.schemas import (
    DAY, DAY_MS, HOUR_MS, LATE_GRACE_MS, MINUTE_MS, NEWEST_WINDOWS, OPERATION_TYPES, RETENTION_MS,
)

PERFORMANCE_SIZE_MS = HOUR_MS
PERFORMANCE_HOP_MS = 30 * MINUTE_MS
PERFORMANCE_GRACE = "5 minutes"
PERFORMANCE_GRACE_MS = 5 * MINUTE_MS
METRICS_SIZE_MS = 15 * MINUTE_MS
METRICS_GRACE = "0 seconds"


def _floor_to(ms: Column, size: int) -> Column:
    return ms - F.pmod(ms, F.lit(size))


def _event_time(df: DataFrame, grace: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", grace)


def hourly_delivery_performance(shipment_events: DataFrame) -> DataFrame:
    """Deliveries per warehouse in one-hour windows that start every half hour.

    On time means no later than the expected delivery plus the grace period. The delivery time is the
    distance between actual and expected delivery.
    """
    delivered = shipment_events.where(F.col("event_type") == "DELIVERED")
    off = F.abs(F.col("timestamp") - F.col("expected_delivery"))
    on_time = F.col("timestamp") <= F.col("expected_delivery") + LATE_GRACE_MS
    measures = [count_where(on_time).alias("on_time_count"), F.count("*").alias("total_delivered"),
                F.sum(off).alias("total_delivery_time_ms"), F.max("timestamp").alias("last_updated")]
    if shipment_events.isStreaming:
        w = F.window("event_time", "1 hour", "30 minutes")
        sums = (_event_time(delivered, PERFORMANCE_GRACE).groupBy(w, "warehouse_id").agg(*measures)
                .withColumn("window_start", F.unix_millis("window.start")).drop("window"))
    else:
        # Every window is two half-hour panes: aggregate the events once per pane, then add panes up,
        # rather than copying each event into both of its windows.
        pane = _floor_to(F.col("timestamp"), PERFORMANCE_HOP_MS).alias("pane")
        panes = delivered.groupBy(pane, "warehouse_id").agg(*measures)
        starts = F.array(F.col("pane"), F.col("pane") - PERFORMANCE_HOP_MS)
        sums = panes.withColumn("window_start", F.explode(starts)).groupBy("warehouse_id", "window_start").agg(
            *[F.sum(c).alias(c) for c in ("on_time_count", "total_delivered", "total_delivery_time_ms")],
            F.max("last_updated").alias("last_updated"))
    return _performance(sums)


def _performance(sums: DataFrame) -> DataFrame:
    total = F.col("total_delivered")
    return sums.select(
        "warehouse_id", "window_start", (F.col("window_start") + PERFORMANCE_SIZE_MS).alias("window_end"),
        "on_time_count", (total - F.col("on_time_count")).alias("late_count"), "total_delivered",
        (F.lit(100.0) * F.col("on_time_count") / total).alias("on_time_percentage"),
        "total_delivery_time_ms", (F.col("total_delivery_time_ms") / total).alias("avg_delivery_time_ms"),
        "last_updated")


def add_performance(rows: DataFrame) -> DataFrame:
    """Add up rows of ``hourly_delivery_performance`` of the same warehouse and window, from different events."""
    return _performance(rows.groupBy("warehouse_id", "window_start").agg(
        *[F.sum(c).alias(c) for c in ("on_time_count", "total_delivered", "total_delivery_time_ms")],
        F.max("last_updated").alias("last_updated")))


def operation_column(name: str) -> str:
    return f"{name.lower()}_count"


def warehouse_metrics(warehouse_operations: DataFrame) -> DataFrame:
    """Operations per warehouse in 15-minute windows.

    ``error_count`` is the number of operations with at least one error. ``operation_counts`` maps the
    operation types that occurred to their number; it comes from one counter per known type, which
    keeps the aggregation to a single pass with fixed-width state.
    """
    measures = [
        *[count_where(F.col("operation_type") == t).alias(operation_column(t)) for t in OPERATION_TYPES],
        F.count("*").alias("total_operations"),
        F.sum(F.col("duration_seconds").cast("long")).alias("total_duration_seconds"),
        count_where(F.size("errors") > 0).alias("error_count"),
        F.sum(F.col("quantity").cast("long")).alias("total_items_processed"),
        F.max("timestamp").alias("last_updated")]
    if warehouse_operations.isStreaming:
        sums = (_event_time(warehouse_operations, METRICS_GRACE)
                .groupBy(F.window("event_time", "15 minutes"), "warehouse_id").agg(*measures)
                .withColumn("window_start", F.unix_millis("window.start")).drop("window"))
    else:
        start = _floor_to(F.col("timestamp"), METRICS_SIZE_MS).alias("window_start")
        sums = warehouse_operations.groupBy("warehouse_id", start).agg(*measures)
    return _metrics(sums)


def _metrics(sums: DataFrame) -> DataFrame:
    counts = F.create_map(*[x for t in OPERATION_TYPES for x in (F.lit(t), F.col(operation_column(t)))])
    return sums.select(
        "warehouse_id", "window_start", (F.col("window_start") + METRICS_SIZE_MS).alias("window_end"),
        F.map_filter(counts, lambda _, n: n > 0).alias("operation_counts"),
        "total_operations", "total_duration_seconds",
        (F.col("total_duration_seconds") / F.col("total_operations")).alias("avg_duration_seconds"),
        "error_count", "total_items_processed", "last_updated")


def add_metrics(rows: DataFrame) -> DataFrame:
    """Add up rows of ``warehouse_metrics`` of the same warehouse and window, from different events."""
    return _metrics(rows.groupBy("warehouse_id", "window_start").agg(
        *[F.sum(F.coalesce(F.col("operation_counts")[t], F.lit(0))).alias(operation_column(t)) for t in OPERATION_TYPES],
        *[F.sum(c).alias(c) for c in ("total_operations", "total_duration_seconds", "error_count", "total_items_processed")],
        F.max("last_updated").alias("last_updated")))


def stream_time(events: DataFrame) -> Column:
    """Time of the newest event, as a scalar subquery. Stands in for "now" when replaying tables."""
    return events.agg(F.max("timestamp")).scalar()


def within_retention(events: DataFrame, as_of: Column | int) -> DataFrame:
    """Events that can belong to a window starting in the retention period before ``as_of``.

    A window holds no event before its start, so this narrows the scan without changing any of them.
    Of events stored by day only the days concerned are listed.
    """
    earliest = as_of - F.lit(RETENTION_MS)
    recent = events.where(F.col("timestamp") >= earliest)
    if DAY in events.columns:
        recent = recent.where(F.datediff(F.col(DAY), F.lit("1970-01-01").cast("date")) >= F.floor(earliest / DAY_MS))
    return recent


def last_windows(view: DataFrame, as_of: Column | int, n: int = NEWEST_WINDOWS,
                 warehouse_id: str | None = None) -> DataFrame:
    """The newest ``n`` windows of each warehouse that start in the retention period before ``as_of``.

    The period bounds the windows of a warehouse to a few dozen, whatever the number of events.
    """
    if not isinstance(as_of, Column):
        as_of = F.lit(as_of)
    start = F.col("window_start")
    recent = view.where((start >= as_of - F.lit(RETENTION_MS)) & (start <= as_of))
    if warehouse_id is not None:
        recent = recent.where(F.col("warehouse_id") == warehouse_id)
    place = F.row_number().over(Window.partitionBy("warehouse_id").orderBy(F.desc("window_start")))
    return recent.withColumn("place", place).where(F.col("place") <= n).drop("place")


def recent_hourly_performance(shipment_events: DataFrame, as_of: Column | int | None = None,
                              n: int = NEWEST_WINDOWS, warehouse_id: str | None = None) -> DataFrame:
    as_of = stream_time(shipment_events) if as_of is None else as_of
    view = hourly_delivery_performance(within_retention(shipment_events, as_of))
    return last_windows(view, as_of, n, warehouse_id)


def recent_warehouse_metrics(warehouse_operations: DataFrame, as_of: Column | int | None = None,
                             n: int = NEWEST_WINDOWS, warehouse_id: str | None = None) -> DataFrame:
    as_of = stream_time(warehouse_operations) if as_of is None else as_of
    view = warehouse_metrics(within_retention(warehouse_operations, as_of))
    return last_windows(view, as_of, n, warehouse_id)


def nested_windows(windows: DataFrame, name: str) -> DataFrame:
    """One row per warehouse with its windows as an array, oldest first. For ``last_windows`` output,
    where a warehouse has at most ``n`` rows."""
    fields = [c for c in windows.columns if c not in ("warehouse_id", "window_start")]
    by_start = lambda a, b: F.sign(a["window_start"] - b["window_start"]).cast("int")
    return windows.groupBy("warehouse_id").agg(
        F.array_sort(F.collect_list(F.struct("window_start", *fields)), by_start).alias(name))


def latest_window(view: DataFrame, as_of: Column | int | None = None) -> DataFrame:
    """The newest window of each warehouse, if it starts in the retention period before ``as_of``.

    Without ``as_of`` that is the time of the newest event in the view, found among the newest windows: one row per
    warehouse, so the events behind the view are read once.
    """
    fields = [c for c in view.columns if c != "warehouse_id"]
    newest = (view.groupBy("warehouse_id").agg(F.max_by(F.struct(*fields), "window_start").alias("v"))
              .select("warehouse_id", "v.*"))
    now = F.max("last_updated").over(Window.partitionBy()) if as_of is None else F.lit(as_of)
    return newest.withColumn("_now", now).where(F.col("window_start") >= F.col("_now") - F.lit(RETENTION_MS)).drop("_now")
