"""Positions over ranges against a window over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewagon.functions.ranges import numbered


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") % 3).alias("k")).repartition(7)
    found = numbered(rows, [F.col("k").desc(), F.col("id")], "at").orderBy("at").collect()
    assert [r["at"] for r in found] == list(range(5000))
    assert [(r["k"], r["id"]) for r in found] == sorted(((r["k"], r["id"]) for r in found), key=lambda x: (-x[0], x[1]))


def test_numbers_of_nothing(spark):
    assert numbered(spark.range(0), [F.col("id")], "at").columns == ["id", "at"]
    assert numbered(spark.range(0), [F.col("id")], "at").count() == 0
