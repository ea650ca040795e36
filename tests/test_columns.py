from __future__ import annotations

from pyspark.sql import functions as F

from make import rows
from tidewagon.functions import columns, ids


def _one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_ids_as_people_type_them(spark):
    typed = ["7", " cust-0007 ", "abc", "99999999999", "  ", None, "12345", "customer 42", "\tCUST-1\n"]
    assert _one(spark, typed, ids.normalize_customer_id) == [
        "CUST-0007", "CUST-0007", "CUST-ABC", "CUST-99999999999", None, None, "CUST-12345", "CUST-0042", "CUST-1"]
    assert _one(spark, ["7", "veh-9", "1234"], ids.normalize_vehicle_id) == ["VEH-007", "VEH-9", "VEH-1234"]
    assert _one(spark, ["rtm", "WH-FRA", ""], ids.normalize_warehouse_id) == ["WH-RTM", "WH-FRA", None]
    assert _one(spark, ["42", "ord-1a2b", "1a2b"], ids.normalize_order_id) == ["ORD-00042", "ORD-1A2B", "ORD-00012"]


def test_iso_time_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = _one(spark, [0, 1_704_067_200_000, 1_704_067_200_005, -1], columns.iso_utc, "long")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out == [None, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.005Z", "1969-12-31T23:59:59.999Z"]


def test_minutes_truncate_toward_zero(spark):
    assert _one(spark, [59_999, 60_000, -59_999, -60_000], columns.whole_minutes, "long") == [0, 1, 0, -1]


def test_lenient_numbers(spark):
    assert _one(spark, ["5", "x", None, " 7 "], lambda c: columns.lenient_number(c, "bigint", 0)) == [5, 0, 0, 7]
    assert _one(spark, ["2.5", "x"], lambda c: columns.lenient_number(c, "double", 1.0)) == [2.5, 1.0]


def test_padding_never_cuts(spark):
    assert _one(spark, [7, 12345], lambda c: columns.padded("CUST-", c, 4), "long") == ["CUST-0007", "CUST-12345"]


def test_deadlines(spark):
    hours = _one(spark, ["STANDARD", "EXPRESS", "SAME_DAY", "CRITICAL", "OTHER"],
                 lambda c: columns.sla_deadline(c, F.lit(0).cast("long")) / 3_600_000)
    assert hours == [120, 48, 12, 4, None]


def test_percent_of_nothing(spark):
    df = spark.createDataFrame([(1, 4), (0, 0)], "a long, b long")
    assert rows(df.select(columns.percent(F.col("a"), F.col("b"), 0.0))) == [(0.0,), (25.0,)]
