"""The fixed main sites, and loading without overwriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the main sites: id, name, city, country, latitude, longitude.
MAIN_SITES = (
    ("WH-RTM", "Rotterdam Distribution Center", "Rotterdam", "Netherlands", "51.9225", "4.47917"),
    ("WH-FRA", "Frankfurt Logistics Hub", "Frankfurt", "Germany", "50.1109", "8.68213"),
    ("WH-BCN", "Barcelona Fulfillment Center", "Barcelona", "Spain", "41.3874", "2.16996"),
    ("WH-WAW", "Warsaw Regional Depot", "Warsaw", "Poland", "52.2297", "21.0122"),
    ("WH-STO", "Stockholm Nordic Hub", "Stockholm", "Sweden", "59.3293", "18.0686"),
)
SITE_CODES = tuple(s[0] for s in MAIN_SITES)


def number_series(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1).withColumnRenamed("id", "n")


def _cycle(values: tuple, offset: int = 0) -> Column:
    """The value at position ``n`` modulo the list length."""
    items = F.array(*[F.lit(v) for v in values])
    return F.element_at(items, (F.pmod(F.col("n") + offset, F.lit(len(values))) + 1).cast("int"))


def build_warehouses(series: DataFrame) -> DataFrame:
    """The fixed main sites, for the numbers 1 to 5 of the series."""
    site = lambda i: _cycle(tuple(s[i] for s in MAIN_SITES), -1)
    return series.where(F.col("n").between(1, len(MAIN_SITES))).select(
        site(0).alias("warehouse_id"), site(1).alias("name"), site(2).alias("city"),
        site(3).alias("country"), site(4).cast("decimal(10,8)").alias("latitude"),
        site(5).cast("decimal(11,8)").alias("longitude"), F.lit("OPERATIONAL").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows plus the incoming ones whose key is new.

    Of a key repeated in the load the smallest row by all its columns is kept, however the load is partitioned.
    """
    fresh = incoming.join(existing.select(key), key, "left_anti")
    least = F.min(F.struct(*[F.col(c) for c in incoming.columns if c != key])).alias("row")
    new = fresh.groupBy(key).agg(least).select(key, "row.*")
    return existing.unionByName(new, allowMissingColumns=True)
