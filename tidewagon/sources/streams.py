"""Event streams from files and from a message broker (SRC-1..4), reference tables over JDBC (SRC-5)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewagon.schemas import DAY, DAY_MS, REFERENCE, STREAM_ENUMS, STREAMS

FILE_ROWS = 5_000_000

_AVRO_PRIMITIVES = {T.StringType(): "string", T.LongType(): "long", T.IntegerType(): "int",
                    T.DoubleType(): "double"}
# Columns that may be absent on the wire.
_NULLABLE = {("warehouse_operations", "shipment_id")}


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    """Store events as parquet in one folder per UTC day, so that reads by time list only their days.

    ``rebalance`` gathers a day and splits it again when it is large, so the number of tasks follows its size;
    a file holds at most ``FILE_ROWS`` events.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("timestamp") / DAY_MS).cast("int"))
    (events.withColumn(DAY, day).hint("rebalance", F.col(DAY)).write.option("maxRecordsPerFile", FILE_ROWS).mode(mode)
     .partitionBy(DAY).parquet(folder))


def file_events(spark: SparkSession, name: str, folder: str, file_format: str = "parquet",
                streaming: bool = False, files_per_trigger: int = 64, by_day: bool = False) -> DataFrame:
    """Events of one stream from files that carry the declared columns and ``seq``.

    ``by_day`` adds the ``day`` column of folders written by ``write_events``.
    """
    extra = [T.StructField("seq", T.LongType())] + ([T.StructField(DAY, T.DateType())] if by_day else [])
    schema = T.StructType(list(STREAMS[name][2].fields) + extra)
    if streaming:
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                .format(file_format).load(folder))
    return spark.read.schema(schema).format(file_format).load(folder)


def avro_schema(name: str) -> str:
    """The Avro record schema of a stream, from its declared columns."""
    def field_type(path: str, data_type: T.DataType):
        symbols = STREAM_ENUMS.get((name, path))
        if symbols:
            return {"type": "enum", "name": f"{path}_symbol", "symbols": list(symbols)}
        if isinstance(data_type, T.ArrayType):
            return {"type": "array", "items": field_type(f"{path}_item", data_type.elementType)}
        if isinstance(data_type, T.StructType):
            return record(path, data_type)
        return _AVRO_PRIMITIVES[data_type]

    def record(record_name: str, schema: T.StructType):
        fields = []
        for f in schema.fields:
            kind = field_type(f.name, f.dataType)
            fields.append({"name": f.name, "type": ["null", kind] if (name, f.name) in _NULLABLE else kind})
        return {"type": "record", "name": record_name, "fields": fields}

    return json.dumps(record(name, STREAMS[name][2]))


def broker_events(spark: SparkSession, name: str, servers: str, header_bytes: int = 5,
                  starting: str = "earliest", max_offsets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A stream read from its topic, and the records set aside. Needs the Kafka and Avro packages on the cluster.

    ``header_bytes`` is the length of the schema-registry header before each record. A record that cannot be
    decoded, or that has no key or time, goes to the second frame with its topic, partition, offset and raw
    value, so the stream goes on and nothing is lost. ``seq`` is the offset: all events of a key are in one
    partition.
    """
    from pyspark.sql.avro.functions import from_avro

    topic, key, _ = STREAMS[name]
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    body = F.expr(f"substring(value, {header_bytes + 1})")
    decoded = reader.load().select(
        "topic", "partition", "offset", "value", from_avro(body, avro_schema(name), {"mode": "PERMISSIVE"}).alias("event"))
    usable = F.col(f"event.{key}").isNotNull() & F.col("event.timestamp").isNotNull()
    return (decoded.where(usable).select(F.col("offset").alias("seq"), "event.*"),
            decoded.where(~usable).select("topic", "partition", "offset", "value"))


def jdbc_reference(spark: SparkSession, table: str, url: str, properties: dict[str, str],
                   partitions: int = 1, key_hash: str = "abs(hashtext({key})::bigint)") -> DataFrame:
    """A reference table over JDBC; Spark pushes the columns, filters and limits that queries use.

    With several ``partitions`` each task reads the keys of one remainder. ``key_hash`` is the database's
    expression for a non-negative hash of the key column.
    """
    if partitions == 1:
        found = spark.read.jdbc(url, table, properties=properties)
    else:
        number = key_hash.format(key=REFERENCE[table][0])
        found = spark.read.jdbc(url, table, predicates=[f"{number} % {partitions} = {k}" for k in range(partitions)],
                                properties=properties)
    return found.select(*REFERENCE[table][1].fieldNames())


def file_reference(spark: SparkSession, table: str, folder: str) -> DataFrame:
    return spark.read.schema(REFERENCE[table][1]).parquet(f"{folder}/{table}")
