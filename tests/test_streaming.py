"""Streams against the batch operators: same rows in ordered files, one file per micro-batch."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F, types as T

from make import MIN, T0, operations, orders, rows, shipments, telemetry
from tidewagon.operators import quality, windows
from tidewagon.schemas import OPERATION_TYPES, ORDER_STATUSES, SHIPMENT_EVENT_TYPES, VEHICLE_STATUSES
from tidewagon.sources import streams
from tidewagon.streaming import store, views

PARTS = 4


def _events(spark, stream):
    rng = random.Random(11)
    n, at = 400, lambda i: T0 + i * 2 * MIN
    if stream == "shipment_events":
        return shipments(spark, [{
            "shipment_id": f"SH-{rng.randint(0, 40)}", "customer_id": f"CUST-{rng.choice((0, 0, 1, 2, 3))}",
            "warehouse_id": f"WH-{rng.randint(0, 2)}", "event_type": rng.choice(SHIPMENT_EVENT_TYPES), "timestamp": at(i),
            "expected_delivery": at(i) + rng.randint(-60, 60) * MIN} for i in range(n)])
    if stream == "order_status":
        return orders(spark, [{
            "order_id": f"ORD-{rng.randint(0, 40)}", "customer_id": f"CUST-{rng.choice((0, 0, 1, 2, 3))}",
            "status": rng.choice(ORDER_STATUSES), "timestamp": at(i), "sla_timestamp": at(i) + rng.randint(-60, 120) * MIN,
            "shipment_ids": [f"SH-{i % 7}", "SH-X"]} for i in range(n)])
    if stream == "vehicle_telemetry":
        return telemetry(spark, [{"vehicle_id": f"VEH-{rng.randint(0, 9)}", "timestamp": at(i), "status": rng.choice(VEHICLE_STATUSES),
                                  "latitude": float(i)} for i in range(n)])
    return operations(spark, [{"warehouse_id": f"WH-{rng.randint(0, 2)}", "timestamp": at(i), "operation_type": rng.choice(OPERATION_TYPES),
                               "errors": ["E"] if i % 5 == 0 else [], "quantity": i} for i in range(n)])


def _write_parts(df, folder, bounds):
    """One file per part, written in order."""
    for low, high in bounds:
        df.where(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, name, source, tmp_path, **more):
    query = views.run_view(name, source, str(tmp_path / "view"), str(tmp_path / "checkpoint"), **more)
    query.awaitTermination()
    return views.read(spark, name, str(tmp_path / "view"), **more)


def _comparable(df):
    text = df
    for column, kind in df.dtypes:
        if kind.startswith("map"):
            text = text.withColumn(column, text[column].cast("string"))
    return rows(text, *sorted(text.columns))


def _files(spark, tmp_path, stream, parts=PARTS):
    folder, size = str(tmp_path / "in"), 400 // parts
    _write_parts(_events(spark, stream), folder, [(i * size, (i + 1) * size) for i in range(parts)])
    return folder, streams.file_events(spark, stream, folder, streaming=True, files_per_trigger=1)


@pytest.mark.parametrize("name", sorted(views.VIEWS))
def test_stream_equals_batch(spark, tmp_path, name):
    view = views.VIEWS[name]
    folder, source = _files(spark, tmp_path, view.stream)
    result = _run(spark, name, source, tmp_path, retention_ms=None)
    batch = view.build(streams.file_events(spark, view.stream, folder))
    assert _comparable(result) == _comparable(batch)
    # Starting again finds nothing new and changes nothing.
    assert _comparable(_run(spark, name, source, tmp_path, retention_ms=None)) == _comparable(batch)


@pytest.mark.parametrize("stream", sorted({v.stream for v in views.VIEWS.values()}))
def test_all_views_of_a_stream_come_from_one_read(spark, tmp_path, stream):
    folder, source = _files(spark, tmp_path, stream)
    names = views.of_stream(stream)
    query = views.run_views(names, source, str(tmp_path / "v"), str(tmp_path / "c"), retention_ms=None)
    query.awaitTermination()
    read = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert len(read) == PARTS and sum(read) == 400  # every row once, whatever the number of views
    for name in names:
        batch = views.VIEWS[name].build(streams.file_events(spark, stream, folder))
        assert _comparable(views.read(spark, name, str(tmp_path / "v" / name), None)) == _comparable(batch), name


@pytest.mark.parametrize("batch_id,name", [(0, "late_shipments"), (1, "hourly_delivery_performance")])
def test_every_event_counts_once_after_a_failure(spark, tmp_path, batch_id, name):
    """The query dies after one of the views has been written, before the micro-batch is committed."""
    folder, source = _files(spark, tmp_path, "shipment_events", 2)
    names = views.of_stream("shipment_events")
    died = []

    def die(number, written):
        if (number, written) == (batch_id, name):
            died.append(number)
            raise RuntimeError("stopped on purpose")

    with pytest.raises(StreamingQueryException):
        views.run_views(names, source, str(tmp_path / "v"), str(tmp_path / "c"), retention_ms=None, on_written=die).awaitTermination()
    assert died == [batch_id]
    views.run_views(names, source, str(tmp_path / "v"), str(tmp_path / "c"), retention_ms=None).awaitTermination()
    for n in names:
        batch = views.VIEWS[n].build(streams.file_events(spark, "shipment_events", folder))
        assert _comparable(views.read(spark, n, str(tmp_path / "v" / n), None)) == _comparable(batch), n


@pytest.mark.parametrize("name", ["customer_order_stats", "order_state"])
@pytest.mark.parametrize("after_write", [False, True])
def test_one_view_after_a_failure(spark, tmp_path, monkeypatch, name, after_write):
    folder, source = _files(spark, tmp_path, "order_status", 2)
    original, calls = store.write_view, []

    def failing(changed, number, *more):
        calls.append(number)
        if number == 1 and not after_write:
            raise RuntimeError("stopped on purpose")
        original(changed, number, *more)
        if number == 1:
            raise RuntimeError("stopped on purpose")

    monkeypatch.setattr(store, "write_view", failing)
    with pytest.raises(StreamingQueryException):
        _run(spark, name, source, tmp_path)
    monkeypatch.setattr(store, "write_view", original)
    assert calls == [0, 1]
    batch = views.VIEWS[name].build(streams.file_events(spark, "order_status", folder))
    assert _comparable(_run(spark, name, source, tmp_path)) == _comparable(batch)


_KV = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType())])


def _kv(spark, *pairs):
    return spark.createDataFrame(list(pairs), _KV)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    store.prepare(spark, path, _KV)
    assert rows(store.read_view(spark, path, ["k"], _KV)) == []
    store.write_view(_kv(spark, ("a", 1), ("b", 1), (None, 3)), 0, path, ["k"], _KV)
    for _ in range(2):
        store.write_view(_kv(spark, ("a", 2), (None, 4)), 1, path, ["k"], _KV)
    assert rows(store.read_view(spark, path, ["k"], _KV)) == sorted([("a", 2), ("b", 1), (None, 4)], key=repr)
    assert rows(store.read_view(spark, path, ["k"], _KV, before=1)) == sorted([("a", 1), ("b", 1), (None, 3)], key=repr)
    only = _kv(spark, ("b", 0), (None, 0))
    assert rows(store.read_view(spark, path, ["k"], _KV, only=only)) == sorted([("b", 1), (None, 4)], key=repr)


def test_a_view_holds_two_versions_and_reads_the_touched_buckets(spark, tmp_path):
    path, n = str(tmp_path / "v"), 64
    store.prepare(spark, path, _KV)
    store.write_view(_kv(spark, *[(f"k{i}", 0) for i in range(2000)]), 0, path, ["k"], _KV, n)
    for batch in range(1, 8):
        store.write_view(_kv(spark, ("k1", batch), ("k2", batch)), batch, path, ["k"], _KV, n)
    assert dict(rows(store.read_view(spark, path, ["k"], _KV, buckets=n).where("v > 0"))) == {"k1": 7, "k2": 7}
    files = spark.read.parquet(path)
    assert files.groupBy("bucket").agg(F.count_distinct("batch_id").alias("b")).where("b > 2").isEmpty()
    wanted = store.touched(_kv(spark, ("k1", 0), ("k2", 0)), ["k"], n)
    assert len(wanted) <= 2
    plan = store.read_view(spark, path, ["k"], _KV, only=_kv(spark, ("k1", 0), ("k2", 0)), buckets=n)
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*bucket", text)
    assert files.where(F.col("bucket").isin(wanted)).count() < 2 * 2000 / 8  # a few buckets of 64, in two versions


def test_the_state_of_a_view_by_micro_batch(spark, tmp_path):
    _, source = _files(spark, tmp_path, "shipment_events")
    _run(spark, "status_event_counts", source, tmp_path)
    events = _events(spark, "shipment_events")
    for batch in range(PARTS):
        known = events.where(f"seq < {(batch + 1) * 100}").groupBy("event_type").count()
        assert rows(views.state_at(spark, str(tmp_path / "checkpoint"), batch)) == rows(known)
    changes = views.state_changes(spark, str(tmp_path / "checkpoint")).collect()
    replayed = {}
    for r in sorted(changes, key=lambda r: r["batch_id"]):
        assert (r["before"][0] if r["before"] else None) == replayed.get(r["event_type"])
        replayed[r["event_type"]] = r["after"][0]
    assert sorted(replayed.items()) == rows(events.groupBy("event_type").count())


def test_records_that_cannot_be_read_are_set_aside(spark, tmp_path):
    folder = str(tmp_path / "in")
    texts = ['{"k": 1}', '{"k": 2', None, '{"k": "x"}', '{"k": 5, "z": 1}', "[]", '{"k": 7}', "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, props string")
    _write_parts(df, folder, [(0, 3), (3, 6), (6, 8)])
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    good, bad, checkpoint = (str(tmp_path / x) for x in ("good", "bad", "c"))
    for _ in range(2):  # the second run finds nothing new
        query = views.run_decoded(source, "props", schema, good, bad, checkpoint)
        query.awaitTermination()
    parsed = quality.read_json(df, "props", schema)
    assert rows(store.read_batches(spark, good, T.StructType([*df.schema.fields, *schema.fields]))) == rows(
        parsed.where("readable").drop("readable"))
    assert rows(store.read_batches(spark, bad, df.schema)) == rows(parsed.where("not readable").select("seq", "props"))


def test_late_deliveries_within_grace_count_and_later_ones_do_not(spark, tmp_path):
    folder = str(tmp_path / "in")
    end = T0 + 60 * MIN
    df = shipments(spark, [
        {"event_type": "DELIVERED", "timestamp": T0 + 10 * MIN},
        {"event_type": "DELIVERED", "timestamp": end + 4 * MIN},     # clock reaches end + 4: within the grace period
        {"event_type": "DELIVERED", "timestamp": T0 + 20 * MIN},     # counts
        {"event_type": "DELIVERED", "timestamp": end + 200 * MIN},   # clock passes the grace period
        {"event_type": "DELIVERED", "timestamp": end + 201 * MIN},   # lateness is judged a batch behind
        {"event_type": "DELIVERED", "timestamp": T0 + 30 * MIN}])    # dropped
    _write_parts(df, folder, [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)])
    source = streams.file_events(spark, "shipment_events", folder, streaming=True, files_per_trigger=1)
    out = _run(spark, "hourly_delivery_performance", source, tmp_path)
    assert rows(out.where(f"window_start = {T0}"), "total_delivered") == [(2,)]


def test_late_operations_have_no_grace(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = operations(spark, [{"timestamp": T0}, {"timestamp": T0 + 16 * MIN}, {"timestamp": T0 + 17 * MIN}, {"timestamp": T0 + MIN}])
    _write_parts(df, folder, [(0, 2), (2, 3), (3, 4)])
    source = streams.file_events(spark, "warehouse_operations", folder, streaming=True, files_per_trigger=1)
    out = _run(spark, "warehouse_metrics", source, tmp_path)
    assert rows(out, "window_start", "total_operations") == [(T0, 1), (T0 + 15 * MIN, 2)]
    assert windows.last_windows(out, T0 + 20 * MIN, n=1).count() == 1


def test_windows_past_their_retention_go(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = operations(spark, [{"timestamp": T0}, {"timestamp": T0 + 300 * MIN}, {"timestamp": T0 + 600 * MIN}])
    _write_parts(df, folder, [(0, 1), (1, 2), (2, 3)])
    source = streams.file_events(spark, "warehouse_operations", folder, streaming=True, files_per_trigger=1)
    out = _run(spark, "warehouse_metrics", source, tmp_path)  # six hours unless told otherwise
    assert rows(out, "window_start") == [(T0 + 300 * MIN,), (T0 + 600 * MIN,)]
    assert store.BUCKETS > 1 and views.read(spark, "warehouse_metrics", str(tmp_path / "view"), 60 * MIN).count() == 1


def test_an_older_event_in_a_later_batch_folds_on_arrival(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = orders(spark, [{"status": "RECEIVED", "timestamp": T0 + 10 * MIN}, {"status": "CANCELLED", "timestamp": T0}])
    _write_parts(df, folder, [(0, 1), (1, 2)])
    source = streams.file_events(spark, "order_status", folder, streaming=True, files_per_trigger=1)
    out = _run(spark, "customer_order_stats", source, tmp_path)
    assert rows(out, "pending_orders", "cancelled_orders", "last_updated") == [(0, 1, T0)]


def test_state_rows_as_json(spark):
    df = spark.createDataFrame([("a", T0), ("b", 0)], "vehicle_id string, last_updated long")
    assert rows(store.as_json(df)) == [('{"vehicle_id":"a","last_updated":"2024-01-01T00:00:00Z"}',), ('{"vehicle_id":"b"}',)]


def test_avro_schemas_cover_every_stream():
    import json

    for name, (_, key, schema) in streams.STREAMS.items():
        record = json.loads(streams.avro_schema(name))
        assert [f["name"] for f in record["fields"]] == schema.fieldNames() and key in schema.fieldNames()
    ops = {f["name"]: f["type"] for f in json.loads(streams.avro_schema("warehouse_operations"))["fields"]}
    assert ops["shipment_id"] == ["null", "string"] and ops["operation_type"]["symbols"][0] == "RECEIVING"
    assert ops["errors"] == {"type": "array", "items": "string"}
