"""Materialised views on shared storage (SNK-1, SNK-2, SNK-4), as plain partitioned tables.

A view is dealt out to buckets by the hash of its keys. A bucket has two slots; each holds all rows of the bucket after some
micro-batch, with the number of that micro-batch. A micro-batch reads the newer slot of the buckets that its keys
touch, which are the partitions that Spark lists for them, and overwrites the other slot. So

* what is read and written grows with the touched buckets, not with the view or with the number of micro-batches;
* a micro-batch that is run again after a failure finds what there was before it, whatever the failed run had written;
* a reader always finds the content of a bucket in one of its slots.

Choose ``buckets`` so that a bucket stays at some ten thousand rows. A view keeps the number it was started with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewagon.functions.columns import iso_utc

BUCKETS = 8
_OWN = ("batch_id", "bucket", "slot")


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + [
        T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.IntegerType())])


def prepare(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty view of the columns, where there is none."""
    spark.createDataFrame([], _stored(schema)).write.mode("ignore").partitionBy("bucket", "slot").parquet(path)


def _versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_stored(schema)).parquet(path)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, *_OWN)]
    return rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"), F.max("batch_id").alias("batch_id"))


def read_view(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, before: int | None = None,
              only: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Current row per key, or that before a micro-batch. ``only`` limits the view to some keys, and to their buckets."""
    rows = _versions(spark, path, schema)
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    if only is not None:
        rows = rows.where(F.col("bucket").isin(touched(only, keys, buckets)))
        wanted = only.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        rows = rows.join(wanted, same, "left_semi")
    return _newest(rows, keys).select(*keys, "v.*").select(*schema.fieldNames())


def touched(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    """The buckets that hold the keys of ``rows``; at most ``buckets`` numbers."""
    return sorted(r["b"] for r in rows.select(bucket_of(keys, buckets).alias("b")).distinct().collect())


def write_view(changed: DataFrame, batch_id: int, path: str, keys: list[str], schema: T.StructType, buckets: int = BUCKETS,
               keep: Column | None = None) -> None:
    """Replace the rows of the keys in ``changed``. ``keep`` is a condition on the rows that stay in the touched buckets."""
    spark = changed.sparkSession
    wanted = touched(changed, keys, buckets)
    if not wanted:
        return
    old, used = None, {}
    if batch_id:
        old = _versions(spark, path, schema).where(F.col("bucket").isin(wanted) & (F.col("batch_id") < batch_id))
        used = {r["bucket"]: r["slot"] for r in old.groupBy("bucket").agg(F.max_by("slot", "batch_id").alias("slot")).collect()}
    slots = F.create_map(*[F.lit(x) for b in wanted for x in (b, 1 - used.get(b, 1))])
    kinds = dict(changed.dtypes)
    new = changed.select(*[F.col(f.name) if kinds[f.name] == f.dataType.simpleString() else F.col(f.name).cast(f.dataType)
                           for f in schema.fields]).withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn(
        "bucket", bucket_of(keys, buckets))
    # Dealt out by bucket once: the rows of a key meet there, and each bucket is written by one task.
    rows = (new if old is None else old.drop("slot").unionByName(new)).repartition("bucket")
    rows = rows if old is None else _newest(rows, keys).select(*keys, "v.*", "bucket")
    rows = rows if keep is None else rows.where(keep)
    (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("slot", slots[F.col("bucket")])
     .select(*schema.fieldNames(), *_OWN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", "slot").parquet(path))


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Rows that a micro-batch adds to a list; a repeated micro-batch replaces its own."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def as_json(view: DataFrame) -> DataFrame:
    """State rows as snake_case JSON, ``last_updated`` as ISO-8601 UTC text (left out when 0)."""
    shaped = view.withColumn("last_updated", iso_utc(F.col("last_updated")))
    return shaped.select(F.to_json(F.struct(*shaped.columns)).alias("json"))
