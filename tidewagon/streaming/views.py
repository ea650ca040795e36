"""Continuous views (STR-1..7, SNK-3).

``run_view`` keeps one view: latest-value, counting and windowed views are native aggregations in update mode, whose state
lives in the state store; every changed row goes to the view. The two customer views need an ordered, clamped fold, which
streaming aggregation does not offer. They fold each micro-batch with the batch operator on top of the rows that
the view holds for its customers, so there is no per-key Python and a customer with a large share of the
micro-batch is still spread over time slices.

``run_views`` keeps many views of one stream from a single query: a micro-batch is read once, every view folds it into its
stored rows, and one checkpoint commits it. A view that has been written when the query dies is written again with the same
rows, so every event counts once in each view.

Events of one micro-batch fold in event order; a later micro-batch folds after it, whatever its event
times, which is arrival order. Latest-value views keep the row with the greatest event time, of equal times the later batch's.
Windows past the retention period of the newest one leave the windowed views, unless they are to be kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidewagon.operators import counts, customers, latest, quality, windows
from tidewagon.schemas import RETENTION_MS, STREAMS
from tidewagon.streaming import store

# Most views keep a row per key for ever, so their state is kept on disk; changes are uploaded as such, and can be read.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _added(key: str, *counters: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])


def _last(key: str, first: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """The row with the greatest ``last_updated``, of equal ones that of the micro-batch; ``first`` keeps its least value."""
    def join(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (key, "age", first)]
        held = [F.max_by(F.struct(*values), F.struct("last_updated", "age")).alias("v")]
        held += [F.min(first).alias(first)] if first else []
        return rows.groupBy(key).agg(*held).select(key, "v.*", *([first] if first else []))
    return join


@dataclass(frozen=True)
class View:
    stream: str
    keys: list[str]
    build: Callable[..., DataFrame]
    join: Callable[[DataFrame], DataFrame] | None = None  # of stored rows (age 0) and those of a micro-batch (age 1)
    clocked: bool = False

    @property
    def folds(self) -> bool:
        """Whether the operator itself continues from stored rows."""
        return self.join is None

    @property
    def windowed(self) -> bool:
        return "window_start" in self.keys

    def options(self, clock: str | int) -> dict:
        return {"clock": clock} if self.clocked else {}

    def schema(self, spark: SparkSession) -> T.StructType:
        events = T.StructType([*STREAMS[self.stream][2].fields, T.StructField("seq", T.LongType())])
        return self.build(spark.createDataFrame([], events), **self.options("event")).schema


VIEWS = {
    "status_event_counts": View("shipment_events", ["status"], counts.status_event_counts, _added("status", "event_count")),
    "customer_shipment_stats": View("shipment_events", ["customer_id"], customers.shipment_stats_state, clocked=True),
    "late_shipments": View("shipment_events", ["shipment_id"], latest.late_shipments, _last("shipment_id"), clocked=True),
    "hourly_delivery_performance": View("shipment_events", ["warehouse_id", "window_start"],
                                        windows.hourly_delivery_performance, windows.add_performance),
    "vehicle_state": View("vehicle_telemetry", ["vehicle_id"], latest.vehicle_state, _last("vehicle_id")),
    "warehouse_metrics": View("warehouse_operations", ["warehouse_id", "window_start"], windows.warehouse_metrics,
                              windows.add_metrics),
    "order_state": View("order_status", ["order_id"], latest.order_state, _last("order_id", "created_at")),
    "customer_order_stats": View("order_status", ["customer_id"], customers.customer_order_stats, clocked=True),
    "order_sla_tracking": View("order_status", ["order_id"], latest.order_sla_tracking, _last("order_id"), clocked=True),
}


def of_stream(stream: str) -> list[str]:
    return [name for name, view in VIEWS.items() if view.stream == stream]


def _keep(changed: DataFrame, view: View, retention_ms: int | None):
    if retention_ms is None or not view.windowed:
        return None
    return F.col("window_start") >= changed.agg(F.max("window_start")).scalar() - F.lit(retention_ms)


def _fold_and_write(name: str, batch: DataFrame, batch_id: int, path: str, clock: str | int, buckets: int,
                    retention_ms: int | None) -> None:
    """Fold a micro-batch into the stored rows of its keys and store what that changes."""
    view, spark = VIEWS[name], batch.sparkSession
    schema = view.schema(spark)
    rows = batch if view.folds else view.build(batch, **view.options(clock)).persist()
    state = None
    if batch_id:  # before the first micro-batch there is nothing
        state = store.read_view(spark, path, view.keys, schema, batch_id, rows.select(*view.keys).distinct(), buckets).persist()
    if view.folds:
        changed = view.build(batch, state=state, **view.options(clock))
    else:
        changed = rows if state is None else view.join(
            state.withColumn("age", F.lit(0)).unionByName(rows.withColumn("age", F.lit(1))))
    changed = changed.persist()
    try:
        store.write_view(changed, batch_id, path, view.keys, schema, buckets, _keep(changed, view, retention_ms))
    finally:
        changed.unpersist()
        if state is not None:
            state.unpersist()
        if rows is not batch:
            rows.unpersist()


def _started(source: DataFrame, mode: str, sink, name: str, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (source.writeStream.queryName(f"{name}-{zlib.crc32(path.encode()):08x}").outputMode(mode)
            .option("checkpointLocation", checkpoint).foreachBatch(sink)
            .trigger(**(trigger or {"availableNow": True})).start())


def run_view(name: str, events: DataFrame, path: str, checkpoint: str, clock: str | int = "event",
             buckets: int = store.BUCKETS, retention_ms: int | None = RETENTION_MS,
             trigger: dict | None = None) -> StreamingQuery:
    """Start maintaining a view from its event stream.

    The checkpoint makes the offsets, and the slots of the store make the output, repeatable: together
    every event counts once. ``retention_ms`` is how long windows stay, None for ever.
    """
    view, spark = VIEWS[name], events.sparkSession
    for setting in STATE_SETTINGS.items():
        spark.conf.set(*setting)
    schema = view.schema(spark)
    store.prepare(spark, path, schema)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.repartition(*view.keys).persist()  # dealt out anew, as the order within the state store cannot be kept
        try:
            store.write_view(rows, batch_id, path, view.keys, schema, buckets, _keep(rows, view, retention_ms))
        finally:
            rows.unpersist()

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _fold_and_write(name, batch, batch_id, path, clock, buckets, retention_ms)
        finally:
            batch.unpersist()

    source, mode, sink = (events, "append", fold) if view.folds else (
        view.build(events, **view.options(clock)), "update", write)
    return _started(source, mode, sink, name, path, checkpoint, trigger)


def run_views(names: Iterable[str], events: DataFrame, folder: str, checkpoint: str, clock: str | int = "event",
              buckets: int = store.BUCKETS, retention_ms: int | None = RETENTION_MS, trigger: dict | None = None,
              on_written: Callable[[int, str], None] | None = None) -> StreamingQuery:
    """Start maintaining several views of one stream, each below ``folder``, from one read of every micro-batch.

    ``on_written`` is called with the micro-batch and the view after a view has been written. Late events count, as there is no
    watermark: the stored windows take them in as long as they are retained.
    """
    names = list(names)
    if len({VIEWS[n].stream for n in names}) > 1:
        raise ValueError(f"views of several streams: {names}")
    for name in names:
        store.prepare(events.sparkSession, f"{folder}/{name}", VIEWS[name].schema(events.sparkSession))

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name in names:
                _fold_and_write(name, batch, batch_id, f"{folder}/{name}", clock, buckets, retention_ms)
                if on_written is not None:
                    on_written(batch_id, name)
        finally:
            batch.unpersist()

    return _started(events, "append", fan_out, "+".join(names), folder, checkpoint, trigger)


def read(spark: SparkSession, name: str, path: str, retention_ms: int | None = RETENTION_MS) -> DataFrame:
    """Current content of a view, readable while its query runs."""
    view = VIEWS[name]
    content = store.read_view(spark, path, view.keys, view.schema(spark))
    if retention_ms is None or not view.windowed:
        return content
    return content.where(_keep(content, view, retention_ms))


# -- the state store of a running view ------------------------------------------------------------------


def state_at(spark: SparkSession, checkpoint: str, batch_id: int) -> DataFrame:
    """Keys and values that the state of a native view had after a micro-batch, from its checkpoint."""
    return spark.read.format("statestore").option("batchId", batch_id).load(checkpoint).select("key.*", "value.*")


def state_changes(spark: SparkSession, checkpoint: str, first: int = 0) -> DataFrame:
    """(batch_id, key columns, before, after) of every change of the state of a native view since a micro-batch.

    Taking the last ``after`` of each key gives the state. ``before`` is null for a key without an earlier change in the list.
    """
    feed = (spark.read.format("statestore").option("readChangeFeed", True).option("changeStartBatchId", first).load(checkpoint)
            .select("batch_id", "key", F.when(F.col("change_type") == "update", F.col("value")).alias("after")))
    before = F.lag("after").over(Window.partitionBy("key").orderBy("batch_id"))
    return feed.withColumn("before", before).select("batch_id", "key.*", "before", "after")


# -- records that cannot be read ------------------------------------------------------------------------


def run_decoded(rows: DataFrame, column: str, schema: T.StructType, good: str, bad: str, checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
    """Decode a JSON column of a stream: readable rows go to ``good``, the others as they came to ``bad``.

    A micro-batch is read once for both; a repeated one replaces what it had written.
    """
    def deal(batch: DataFrame, batch_id: int) -> None:
        parsed = quality.read_json(batch, column, schema).persist()
        try:
            store.write_batch(parsed.where("readable").drop("readable"), batch_id, good)
            store.write_batch(parsed.where("not readable").select(*batch.columns), batch_id, bad)
        finally:
            parsed.unpersist()

    return _started(rows, "append", deal, "decoded", good, checkpoint, trigger)
