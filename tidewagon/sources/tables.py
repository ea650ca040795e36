"""Adapters from a general event table and star-schema tables to the logistics streams.

Each ``*_from`` function is pure and takes the ``base_events`` frame, which may be batch or streaming.
Only the columns an operator uses reach the parquet scan, as everything here is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewagon.functions.columns import padded
from tidewagon.schemas import LICENSE_TYPES, OPERATION_TYPES, ORDER_STATUSES, ROUTE_TYPES, SLA_TIERS, VEHICLE_TYPES
from tidewagon.session import shared_folder
from tidewagon.sources import builders

# The columns of the general event table; ``ts`` is declared as stored.
EVENT_COLUMNS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _base(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id as seq", "unix_millis(cast(ts as timestamp)) as ts_ms", "user_id", "event_type",
        "value", "cast(get_json_object(props, '$.k') as int) as k")


def base_events(spark: SparkSession, folder: str) -> DataFrame:
    # Stored event times carry no zone and are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _base(spark.read.parquet(f"{folder}/events.parquet"))


PARTS = 3
PART_FILE_ROWS = 1_000_000
_STAGED: dict[tuple, tuple[str, int]] = {}


def part_of(parts: int) -> Column:
    """Which of ``parts`` equal stretches of event ids an event is in, from 0; needs the columns ``low`` and ``high``."""
    return F.expr(f"cast(((event_id - low) * {parts}) div (high - low + 1) as int)")


def staged_events(spark: SparkSession, folder: str, parts: int = PARTS) -> tuple[str, int]:
    """The event table as files that arrive one stretch of ids after the other, and the files of a stretch.

    Written once per application below the shared folder, for streams over several micro-batches.
    """
    key = (spark.sparkContext.applicationId, folder, parts)
    if key not in _STAGED:
        events = spark.read.schema(EVENT_COLUMNS).parquet(f"{folder}/events.parquet")
        span = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"), F.count("*").alias("n")).first()
        files = max(1, -(-(span["n"] // parts) // PART_FILE_ROWS))
        path = shared_folder(spark, "events-in-parts")
        marked = events.withColumns({"low": F.lit(span["low"]), "high": F.lit(span["high"])}).withColumn("part", part_of(parts))
        for part in range(parts):
            (marked.where(F.coalesce("part", F.lit(0)) == part).select(*EVENT_COLUMNS.fieldNames()).repartition(files)
             .write.mode("append").parquet(path))
        _STAGED[key] = path, files
    return _STAGED[key]


def raw_events_stream(spark: SparkSession, folder: str, parts: int = PARTS) -> DataFrame:
    """The event table as a stream of ``parts`` micro-batches, in order of the event ids."""
    path, files = staged_events(spark, folder, parts)
    return spark.readStream.schema(EVENT_COLUMNS).option("maxFilesPerTrigger", files).parquet(path)


def base_events_stream(spark: SparkSession, folder: str, parts: int = PARTS) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return _base(raw_events_stream(spark, folder, parts))


def _pick(column: str, *pairs: tuple, default: str) -> Column:
    """Simple value-to-value mapping of one column."""
    out = F
    for value, result in pairs:
        out = out.when(F.expr(column) == F.lit(value), F.lit(result))
    return out.otherwise(F.lit(default))


def _nth(index: str, *values: str) -> Column:
    """The value at a position counted from 0."""
    items = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"array({items})[cast({index} as int)]")


def _warehouse() -> Column:
    return _nth("user_id % 5", *builders.SITE_CODES)


def shipment_events_from(ev: DataFrame) -> DataFrame:
    event_type = F.expr("""
        case event_type when 'signup' then 'CREATED' when 'purchase' then 'DELIVERED'
          when 'view' then 'IN_TRANSIT'
          when 'error' then case when seq % 4 = 0 then 'CANCELLED' else 'EXCEPTION' end
          else array('PICKED', 'PACKED', 'DISPATCHED', 'OUT_FOR_DELIVERY')[cast(seq % 4 as int)] end""")
    return ev.select(
        "seq",
        F.expr("concat('SH-', cast(user_id as string), '-', cast(seq % 7 as string))").alias("shipment_id"),
        _warehouse().alias("warehouse_id"),
        padded("CUST-", F.col("user_id"), 4).alias("customer_id"),
        F.expr("ts_ms + ((seq * 37) % 121 - 60) * 60000").alias("expected_delivery"),
        _nth("user_id % 4", "Berlin", "Paris", "Madrid", "Oslo").alias("destination_city"),
        _nth("user_id % 4", "Germany", "France", "Spain", "Norway").alias("destination_country"),
        event_type.alias("event_type"),
        F.col("ts_ms").alias("timestamp"),
    )


def order_status_from(ev: DataFrame) -> DataFrame:
    statuses = _nth("seq * 31 % 8", *ORDER_STATUSES)
    return ev.select(
        "seq",
        padded("ORD-", F.expr("user_id * 5 + seq % 5"), 5).alias("order_id"),
        padded("CUST-", F.col("user_id"), 4).alias("customer_id"),
        F.col("ts_ms").alias("timestamp"),
        statuses.alias("status"),
        F.expr("""array_compact(array(
            concat('SH-', cast(user_id as string), '-', cast(seq % 5 as string)),
            case when seq % 2 = 0 then concat('SH-', cast(user_id as string), '-', cast(seq % 5 + 2 as string)) end
        ))""").alias("shipment_ids"),
        F.expr("1 + k % 10").alias("total_items"),
        F.expr("ts_ms + ((seq * 53) % 181 - 60) * 60000").alias("sla_timestamp"),
        F.expr("""case when seq % 20 < 12 then 'STANDARD' when seq % 20 < 17 then 'EXPRESS'
                  when seq % 20 < 19 then 'SAME_DAY' else 'CRITICAL' end""").alias("priority"),
    )


def vehicle_telemetry_from(ev: DataFrame) -> DataFrame:
    return ev.select(
        "seq",
        padded("VEH-", F.expr("user_id % 50 + 1"), 3).alias("vehicle_id"),
        F.col("ts_ms").alias("timestamp"),
        F.struct(
            F.expr("45.0D + value / 50").alias("latitude"), F.expr("5.0D + value / 100").alias("longitude"),
            F.expr("case when event_type = 'view' then 40.0D + value / 10 else 0.0D end").alias("speed_kmh"),
            F.expr("cast(seq % 360 as double)").alias("heading")).alias("location"),
        _pick("event_type", ("view", "EN_ROUTE"), ("click", "IDLE"), ("signup", "LOADING"),
              ("purchase", "UNLOADING"), default="MAINTENANCE").alias("status"),
        F.struct(
            F.expr("cast(k % 20 as int)").alias("shipment_count"), F.expr("value * 3").alias("weight_kg"),
            F.expr("value / 100").alias("volume_cubic_m")).alias("current_load"),
        padded("DRV-", F.expr("user_id % 75 + 1"), 3).alias("driver_id"),
        F.expr("100 - value / 5").alias("fuel_level_percent"),
        F.expr("10000.0D + seq").alias("odometer_km"),
    )


def warehouse_operations_from(ev: DataFrame) -> DataFrame:
    operation = _nth("seq % 7", *OPERATION_TYPES)
    return ev.select(
        "seq",
        F.expr("concat('WOP-', cast(seq as string))").alias("event_id"),
        _warehouse().alias("warehouse_id"),
        F.col("ts_ms").alias("timestamp"),
        operation.alias("operation_type"),
        padded("OP-", F.expr("user_id % 50 + 1"), 3).alias("operator_id"),
        padded("PROD-", F.expr("seq % 2000"), 6).alias("product_id"),
        F.col("k").alias("quantity"),
        F.expr("""case when seq % 7 in (2, 3, 4)
                  then concat('SH-', cast(user_id as string), '-', cast(seq % 5 as string)) end""").alias("shipment_id"),
        F.expr("10 + k * 3").alias("duration_seconds"),
        F.expr("case when event_type = 'error' then array('SCANNER_FAILURE') else cast(array() as array<string>) end").alias("errors"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        padded("CUST-", F.col("c_custkey"), 4).alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.expr("concat(lower(c_mktsegment), cast(c_custkey as string), '@example.com')").alias("contact_email"),
        _nth("c_nationkey % 4", *SLA_TIERS).alias("sla_tier"),
        F.expr("case when c_acctbal < 0 then 'SUSPENDED' else 'ACTIVE' end").alias("account_status"),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("decimal(8,2)")
    return spark.read.parquet(f"{folder}/part.parquet").select(
        padded("PROD-", F.col("p_partkey"), 6).alias("product_id"),
        padded("SKU-", F.col("p_partkey"), 8).alias("sku"),
        F.col("p_name").alias("name"), F.upper("p_type").alias("category"),
        F.expr("p_size / 10.0D").alias("weight_kg"),
        none.alias("length_cm"), none.alias("width_cm"), none.alias("height_cm"),
        F.col("p_retailprice").alias("unit_price"),
    )


def supplier_clients(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as the clients of a second system, whose numbers run in steps of twenty: some are new, some are taken."""
    return spark.read.parquet(f"{folder}/supplier.parquet").select(
        padded("CUST-", F.expr("s_suppkey * 20"), 4).alias("customer_id"),
        F.col("s_name").alias("company_name"),
        F.expr("concat('supplier', cast(s_suppkey as string), '@example.com')").alias("contact_email"),
        _nth("s_nationkey % 4", *SLA_TIERS).alias("sla_tier"),
        F.expr("case when s_acctbal < 0 then 'SUSPENDED' when s_acctbal > 9000 then 'REVIEW' else 'ACTIVE' end").alias("account_status"),
    )


def _site(key: str) -> Column:
    """The warehouse of a supplier number, as ``warehouses`` names it."""
    return F.when(F.expr(f"{key} < {len(builders.SITE_CODES)}"), _nth(f"least({key}, {len(builders.SITE_CODES) - 1})", *builders.SITE_CODES)
                  ).otherwise(padded("WH-", F.expr(key), 4))


def _home(balance: str, nation: str, key: str) -> Column:
    """Home warehouse: unknown for deep debtors, a code of the nation that no warehouse has for the richest."""
    return (F.when(F.expr(f"{balance} < -500"), F.lit(None).cast("string"))
            .when(F.expr(f"{balance} > 9500"), F.concat(F.lit("WH-N"), F.col(nation).cast("string"))).otherwise(_site(key)))


def warehouses(spark: SparkSession, folder: str) -> DataFrame:
    """One site per supplier: the first five are the fixed main sites, the rest are regional depots."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    depots = (
        read("supplier").where("s_suppkey >= 5")
        .join(read("nation"), F.expr("s_nationkey = n_nationkey"))
        .join(read("region"), F.expr("n_regionkey = r_regionkey"))
        .select(
            padded("WH-", F.col("s_suppkey"), 4).alias("warehouse_id"), F.col("s_name").alias("name"),
            F.col("n_name").alias("city"), F.col("r_name").alias("country"),
            F.expr("cast(40 + s_nationkey as decimal(10,8))").alias("latitude"),
            F.expr("cast(s_nationkey as decimal(11,8))").alias("longitude"),
            F.expr("case when s_acctbal < 0 then 'CLOSED' else 'OPERATIONAL' end").alias("status")))
    main = read("supplier").where("s_suppkey < 5").select((F.col("s_suppkey") + 1).alias("n"))
    return builders.build_warehouses(main).drop("created_at").unionByName(depots)


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    """One vehicle per supplier."""
    return spark.read.parquet(f"{folder}/supplier.parquet").select(
        padded("VEH-", F.expr("s_suppkey + 1"), 3).alias("vehicle_id"),
        _nth("s_nationkey % 3", *VEHICLE_TYPES).alias("vehicle_type"),
        F.expr("concat(upper(substr(s_name, 1, 3)), '-', cast(s_nationkey as string), '-', cast(s_suppkey as string))").alias("license_plate"),
        F.expr("cast(1500 + s_nationkey * 500 as decimal(10,2))").alias("capacity_kg"),
        F.expr("cast(10 + s_nationkey * 2 as decimal(8,2))").alias("capacity_cubic_m"),
        _home("s_acctbal", "s_nationkey", "s_suppkey").alias("home_warehouse_id"),
        F.expr("""case when s_acctbal < 0 then 'MAINTENANCE' when s_acctbal < 4000 then 'AVAILABLE'
                  when s_acctbal < 9000 then 'IN_USE' else 'RETIRED' end""").alias("status"),
        F.expr("case s_nationkey % 5 when 0 then 'ELECTRIC' when 1 then 'HYBRID' else 'DIESEL' end").alias("fuel_type"),
    )


def drivers(spark: SparkSession, folder: str) -> DataFrame:
    """One driver per customer; fifteen of them belong to a supplier's warehouse, and the richer share its vehicle."""
    return spark.read.parquet(f"{folder}/customer.parquet").select(
        padded("DRV-", F.expr("c_custkey + 1"), 3).alias("driver_id"),
        F.lower("c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name"),
        _nth("c_nationkey % 3", *LICENSE_TYPES).alias("license_type"),
        F.expr("""case c_nationkey % 4 when 0 then array('ADR') when 1 then array('HACCP')
                  when 2 then array('ADR', 'HACCP') else cast(array() as array<string>) end""").alias("certifications"),
        F.when(F.expr("c_acctbal > 5000"), padded("VEH-", F.expr("c_custkey div 15 + 1"), 3)).alias("assigned_vehicle_id"),
        _home("c_acctbal", "c_nationkey", "c_custkey div 15").alias("home_warehouse_id"),
        F.expr("""case when c_mktsegment = 'BUILDING' then 'VACATION' when c_acctbal < 0 then 'OFF_DUTY'
                  when c_mktsegment = 'MACHINERY' then 'ON_DUTY' else 'AVAILABLE' end""").alias("status"),
    )


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """One route per part, from a warehouse to a nation; the largest parts start at a code that no warehouse has."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return (read("part").join(read("nation"), F.expr("p_size % 25 = n_nationkey"))
            .join(read("region"), F.expr("n_regionkey = r_regionkey")).select(
        padded("RTE-", F.expr("p_partkey + 1"), 3).alias("route_id"),
        F.when(F.expr("p_size >= 50"), F.expr("concat('WH-P', cast(p_size as string))")).otherwise(
            _site("p_partkey div 20")).alias("origin_warehouse_id"),
        F.col("n_name").alias("destination_city"), F.col("r_name").alias("destination_country"),
        F.expr("cast(p_retailprice as decimal(10,2))").alias("distance_km"),
        F.expr("cast(p_size * 0.25 as decimal(6,2))").alias("estimated_hours"),
        _nth("p_size % 3", *ROUTE_TYPES).alias("route_type"),
        F.expr("p_size < 45").alias("active"),
    ))
