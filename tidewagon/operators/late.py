"""Events that come too late for their window, judged by a clock that moves with every record (STR-1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewagon.functions.ranges import sorted_ranges


def stream_times(events: DataFrame, arrival: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with ``stream_time``: the greatest event time among all records that have arrived, their own included.

    A prefix maximum: the records are put into ranges of their arrival, each range has its own running maximum, and the
    maxima of the ranges before it, one row per range, are carried over its edge. ``by`` gives every value of these columns its
    own clock, such as a partition of the topic. ``arrival`` must be a total order. Records without a time do not move the
    clock.
    """
    held, _ = sorted_ranges(events, [*[F.col(c) for c in by], *arrival])
    own = held.groupBy("_range", *by).agg(F.max("timestamp").alias("own"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.withColumn("before", F.max("own").over(earlier)).select(
        F.col("_range").alias("_at"), *[F.col(c).alias(f"_{c}") for c in by], "before")
    same = [F.col("_range") == F.col("_at"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]]
    so_far = Window.partitionBy("_range", *by).orderBy("_in_range").rowsBetween(Window.unboundedPreceding, 0)
    inside = held.withColumn("running", F.max("timestamp").over(so_far))
    return inside.join(carried, same).withColumn("stream_time", F.greatest("running", "before")).select(
        *events.columns, "stream_time")


def late_events(events: DataFrame, arrival: list[Column], size_ms: int, hop_ms: int, grace_ms: int,
                by: tuple[str, ...] = ()) -> DataFrame:
    """Every record with each of its windows that had closed when it arrived: window end plus grace no later than the
    stream time. An engine with this clock drops the record from these windows; other windows of it may be open."""
    pane = F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(hop_ms))
    starts = F.array(*[pane - k * hop_ms for k in range(size_ms // hop_ms)])
    timed = stream_times(events, arrival, by).withColumn("window_start", F.explode(starts))
    end = F.col("window_start") + size_ms
    return timed.withColumn("window_end", end).where(F.col("window_end") + grace_ms <= F.col("stream_time"))
