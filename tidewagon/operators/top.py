"""Capped lists that still report how many rows there are (TOP-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LIST_SHOWN = 10


def top_with_total(df: DataFrame, order: list[Column], limit: int = LIST_SHOWN) -> DataFrame:
    """The first ``limit`` rows, each with ``total`` (of all rows) and ``note`` (null when none is cut).

    The total is a scalar subquery: a count over an unpartitioned window would bring every row into
    one task. Both columns come before the limit, so that order and limit stay together as a per-task top-k.
    """
    total = F.col("total")
    return (df.withColumn("total", df.agg(F.count("*")).scalar())
            .withColumn("note", F.when(total > limit, F.format_string(f"Showing first {limit} of %d results", total)))
            .orderBy(*order).limit(limit))


def late_top(late: DataFrame, limit: int = LIST_SHOWN) -> DataFrame:
    """Most delayed first."""
    return top_with_total(late, [F.desc("delay_minutes"), F.col("shipment_id")], limit)


def at_risk_top(tracker: DataFrame, limit: int = LIST_SHOWN) -> DataFrame:
    """Least time left first."""
    return top_with_total(tracker, [F.col("time_to_sla_minutes"), F.col("order_id")], limit)


def customer_search_top(customers: DataFrame, limit: int = LIST_SHOWN) -> DataFrame:
    shown = customers.withColumn("contact_email", F.coalesce("contact_email", F.lit("N/A")))
    return top_with_total(shown, [F.col("customer_id")], limit)
