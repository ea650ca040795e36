"""Order-dependent work on keys that may be very large.

A window over a whole key would put that key into one task. Here every key is cut into time slices: the
ordered part runs per (key, slice), each slice is reduced to one row, and only those few rows are put in
order per key. The number of slices of a key is at most the covered time divided by the slice width, whatever
the number of its events. All keys go the same way at every size.

**Clamped counters.** ``x <- max(0, x + d)``, applied in order from ``x0 >= 0``, ends at
``x0 + S - least(0, L)`` where ``S`` is the sum of all steps and ``L`` the lowest value that the
running sum started at ``x0`` takes. ``(S, L)`` of adjacent slices combine by
``(S1 + S2, least(L1, S1 + L2))``, so a slice needs only these two numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewagon.functions.columns import ARRIVAL
from tidewagon.schemas import MINUTE_MS

SLICE_MS = 15 * MINUTE_MS
# Slice number of a stored state, before every slice of events.
STATE_SLICE = -(1 << 62)


def sliced(df: DataFrame, key: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Add ``slice`` and spread the events by (key, slice).

    The events move once, in the explicit ``repartition``, which several ordered passes over the same columns
    share. Events without a key or time are left out, as they belong to no group.
    """
    number = F.call_function("div", F.col("timestamp"), F.lit(slice_ms).cast("long"))
    return (with_key(df, key).withColumn("slice", number)
            # Always true; stated so that every pass has the same filters, and so the same shuffle.
            .where(F.col("slice").isNotNull()).repartition(key, "slice"))


def with_key(df: DataFrame, key: str) -> DataFrame:
    """The events that have a key and a time."""
    return df.where(F.col(key).isNotNull() & F.col("timestamp").isNotNull())


def _in_slice(key: str):
    return Window.partitionBy(key, "slice").orderBy(*ARRIVAL)


def running(step: Column, key: str) -> Column:
    """Sum of the steps of the slice so far, this event included."""
    return F.sum(step).over(_in_slice(key).rowsBetween(Window.unboundedPreceding, 0))


def with_run(steps: DataFrame, key: str, step: str) -> DataFrame:
    """Add ``<step>_run`` (running sum in the slice) and ``<step>_floor`` (its lowest earlier value)."""
    earlier = _in_slice(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = steps.withColumn(f"{step}_run", running(F.col(step), key))
    return summed.withColumn(f"{step}_floor", F.min(f"{step}_run").over(earlier))


def reduce_slices(steps: DataFrame, key: str, counters: list[str], keep: tuple = ()) -> DataFrame:
    """One row per (key, slice) with ``<counter>_sum`` and ``<counter>_low`` of the step columns.

    ``keep`` names columns that have one value per slice and are carried along.
    """
    runs = steps.select(key, "slice", *counters, *keep,
                        *[running(F.col(c), key).alias(f"{c}_run") for c in counters])
    return runs.groupBy(key, "slice").agg(
        *[F.sum(c).alias(f"{c}_sum") for c in counters],
        *[F.min(f"{c}_run").alias(f"{c}_low") for c in counters],
        *[F.max(c).alias(c) for c in keep])


def with_state(slices: DataFrame, state: DataFrame | None, key: str, counters: list[str]) -> DataFrame:
    """Put the counters of an earlier state in front of the slices, as one more slice."""
    if state is None:
        return slices
    first = state.select(
        key, F.lit(STATE_SLICE).alias("slice"),
        *[F.col(c).alias(f"{c}_sum") for c in counters],
        *[F.col(c).alias(f"{c}_low") for c in counters])
    return slices.unionByName(first)


def _before(column: str, key: str) -> Column:
    w = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(f"{column}_sum").over(w), F.lit(0).cast("long"))


def entering(slices: DataFrame, key: str, counter: str) -> DataFrame:
    """Add ``<counter>_in``: the value of a clamped counter when each slice begins."""
    w = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("sum_before", _before(counter, key)).withColumn(
        "low_here", F.col("sum_before") + F.col(f"{counter}_low"))
    low = F.coalesce(F.min("low_here").over(w), F.lit(0))
    return (placed.withColumn(f"{counter}_in", F.col("sum_before") - F.least(F.lit(0), low))
            .drop("sum_before", "low_here"))


def combine_slices(slices: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Final value of every clamped counter per key."""
    placed = slices.select(
        key, *[f"{c}_sum" for c in counters],
        *[(_before(c, key) + F.col(f"{c}_low")).alias(f"{c}_low") for c in counters])
    return placed.groupBy(key).agg(*[
        (F.sum(f"{c}_sum") - F.least(F.lit(0), F.min(f"{c}_low"))).alias(c) for c in counters])


def adjacent_pairs(df: DataFrame, key: str, value: str, slice_ms: int = SLICE_MS) -> DataFrame:
    """Each event with the value of the event before it: ``previous``, null for the first of a key.

    Within a slice this is ``lag``. The first event of a slice takes the last value of the slice
    before, and these pairs are found on the reduced slices and joined by union, not by a join.
    """
    rows = sliced(df.select(key, *ARRIVAL, value), key, slice_ms)
    w = _in_slice(key)
    inside = rows.select(key, "slice", *ARRIVAL, value, F.lag(value).over(w).alias("previous"),
                         F.row_number().over(w).alias("position"))
    order = F.struct(*ARRIVAL)
    edges = rows.groupBy(key, "slice").agg(
        F.min_by(F.struct(*ARRIVAL, value), order).alias("head"), F.max_by(value, order).alias("tail"))
    heads = edges.select(
        key, "head.*",
        F.lag("tail").over(Window.partitionBy(key).orderBy("slice")).alias("previous"))
    return inside.where("position > 1").select(key, *ARRIVAL, value, "previous").unionByName(heads)
