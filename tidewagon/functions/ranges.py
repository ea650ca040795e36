"""Positions in a total order without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.session import shared_folder


def sorted_ranges(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` as a written table in ranges of ``order``, sorted within a range, with its number in ``_range`` and the
    place in it in ``_in_range`` (from 0); and (range, rows before it). One number per range reaches the driver."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    path = shared_folder(spark, "ranges")
    # The identifier of a row is its range in the upper bits and its place in the range in the lower 33.
    at = F.monotonically_increasing_id()
    ranged.withColumn("_range", F.shiftright(at, 33).cast("int")).withColumn(
        "_in_range", at.bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    held = spark.read.parquet(path)
    counts = sorted((r["_range"], r["n"]) for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for number, n in counts:
        starts.append((number, before))
        before += n
    return held, starts


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their position in ``order`` in column ``name``, from 0.

    Rows are ranged and sorted, the counts of the ranges are added up, and each row gets the rows before its range
    plus its place in it. Equal rows must be interchangeable, or ``order`` must be total.
    """
    held, starts = sorted_ranges(rows, order)
    spark = rows.sparkSession
    if not starts:
        return held.withColumn(name, F.lit(0).cast("long")).drop("_range", "_in_range")
    offsets = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))  # a row per range
    return held.join(offsets, "_range").withColumn(name, F.col("_before") + F.col("_in_range")).drop(
        "_range", "_in_range", "_before")
