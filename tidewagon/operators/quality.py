"""Data-quality checks (DQ-1, DQ-2, SRC-8)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tidewagon import schemas as s
from tidewagon.functions.columns import lenient_number
from tidewagon.operators.ordered import SLICE_MS, adjacent_pairs
from tidewagon.session import shared_folder

# Status changes a shipment may make.
ALLOWED_CHANGES = (
    ("CREATED", "PICKED"), ("CREATED", "CANCELLED"), ("PICKED", "PACKED"), ("PACKED", "DISPATCHED"),
    ("DISPATCHED", "IN_TRANSIT"), ("IN_TRANSIT", "OUT_FOR_DELIVERY"), ("IN_TRANSIT", "EXCEPTION"),
    ("EXCEPTION", "EXCEPTION"), ("EXCEPTION", "OUT_FOR_DELIVERY"), ("OUT_FOR_DELIVERY", "DELIVERED"),
)
# Declared constraints: table -> column -> allowed values.
DOMAINS = {
    "customers": {"sla_tier": s.SLA_TIERS, "account_status": s.ACCOUNT_STATUSES},
    "vehicles": {"vehicle_type": s.VEHICLE_TYPES, "status": s.FLEET_STATUSES, "fuel_type": s.FUEL_TYPES},
    "drivers": {"license_type": s.LICENSE_TYPES, "status": s.DRIVER_STATUSES},
    "routes": {"route_type": s.ROUTE_TYPES},
}
NOT_NULL = {
    "warehouses": ("name", "city", "country"),
    "customers": ("company_name", "sla_tier"),
    "vehicles": ("vehicle_type", "license_plate", "capacity_kg", "capacity_cubic_m", "home_warehouse_id"),
    "products": ("sku", "name", "category", "weight_kg"),
    "drivers": ("first_name", "last_name", "license_type"),
    "routes": ("origin_warehouse_id", "destination_city", "destination_country", "distance_km", "estimated_hours"),
}
# (table, column, referenced table); the referenced column is its primary key.
FOREIGN_KEYS = (
    ("vehicles", "home_warehouse_id", "warehouses"), ("drivers", "assigned_vehicle_id", "vehicles"),
    ("drivers", "home_warehouse_id", "warehouses"), ("routes", "origin_warehouse_id", "warehouses"),
)
UNIQUE = (("products", "sku"),)


def lifecycle_violations(shipment_events: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """Status changes outside the shipment life cycle. The first event of a shipment is no change."""
    change = F.concat_ws(">", "previous", "event_type")
    pairs = adjacent_pairs(shipment_events, "shipment_id", "event_type", slice_ms)
    return (pairs.where(F.col("previous").isNotNull() & ~change.isin(*[f"{a}>{b}" for a, b in ALLOWED_CHANGES]))
            .select("shipment_id", "seq", "timestamp", F.col("previous").alias("from_status"),
                    F.col("event_type").alias("to_status")))


def _findings(table: str, df: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """What one scan of a table says: rows (role, domain, value, table_name, rule, key).

    Role ``bad`` is a broken value check. ``own`` is a value that must occur once in its domain, ``ref`` one
    that must occur there as the other table's own.
    """
    key = s.REFERENCE[table][0]
    null, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")

    def row(role: str, domain: str, value, rule: str):
        return F.struct(F.lit(role).alias("role"), F.lit(domain).alias("domain"), value.alias("value"),
                        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), text(key).alias("key"))

    found = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), row("bad", "", null, f"domain:{c}"))
             for c, values in DOMAINS.get(table, {}).items()]
    found += [F.when(F.col(c).isNull(), row("bad", "", null, f"not_null:{c}")) for c in (key, *NOT_NULL[table])]
    found += [F.when(F.col(c).isNotNull(), row("own", f"{table}.{c}", text(c), f"unique:{c}"))
              for c in (key, *[c for t, c in UNIQUE if t == table])]
    found += [F.when(F.col(c).isNotNull(), row("ref", f"{target}.{s.REFERENCE[target][0]}", text(c), f"foreign_key:{c}"))
              for t, c, target in FOREIGN_KEYS if t == table and target in tables]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def reference_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rule, key) for every row that breaks a declared constraint, of the tables given.

    A check on a value finds one row per offending row, a repeated key one row per key. As in SQL, a
    null passes a value check and a foreign key. Every table is scanned once, into narrow tagged rows that are
    written; one aggregation of the own values, combined before its shuffle, answers all uniqueness rules, and the
    references are held against it.
    """
    spark = next(iter(tables.values())).sparkSession
    path = shared_folder(spark, "constraints")
    reduce(DataFrame.unionByName, [_findings(t, df, tables) for t, df in tables.items()]).write.parquet(path)
    tagged = spark.read.parquet(path)
    own = tagged.where("role = 'own'").groupBy("domain", "value").agg(
        F.count("*").alias("n"), F.min("table_name").alias("table_name"), F.min("rule").alias("rule"))
    names = ["table_name", "rule", "key"]
    orphans = tagged.where("role = 'ref'").join(own.select("domain", "value"), ["domain", "value"], "left_anti")
    return (tagged.where("role = 'bad'").select(*names)
            .unionByName(own.where("n > 1").select("table_name", "rule", F.col("value").alias("key")))
            .unionByName(orphans.select(*names)))


def read_json(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Decode a JSON column in one pass: its fields, and ``readable``, false for text that is not a JSON object of
    the declared types. Unknown fields are ignored and a missing one is null."""
    wide = T.StructType(list(schema.fields) + [T.StructField("_bad", T.StringType())])
    parsed = df.withColumn("_json", F.from_json(
        F.col(column), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    readable = F.col("_json").isNotNull() & F.col("_json._bad").isNull()
    fields = [F.when(readable, F.col(f"_json.{f.name}")).alias(f.name) for f in schema.fields]
    return parsed.select(*df.columns, *fields, readable.alias("readable"))


def split_json(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The readable rows with their fields, and the others set aside, so that a stream goes on past a bad record."""
    parsed = read_json(df, column, schema)
    return parsed.where("readable").drop("readable"), parsed.where("not readable").select(*df.columns)


def lenient_fields(df: DataFrame, column: str, fields: Mapping[str, tuple[str, object]]) -> DataFrame:
    """Numbers of a JSON column, read leniently: what is missing, cut off or no number takes its default. ``fields`` maps a
    name to (type, default)."""
    return df.withColumns({name: lenient_number(F.get_json_object(column, f"$.{name}"), kind, default)
                           for name, (kind, default) in fields.items()})
