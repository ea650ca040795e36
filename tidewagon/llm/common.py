"""What the operators share: reading a table, written intermediate tables, bounded samples, held-out rows."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import tidewagon
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewagon.session import shared_folder


FEW_GROUPS = 10_000
BATCH_ROWS = 2_000  # rows of one Arrow batch, so that a batch of whole texts stays small
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(tidewagon.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewagon-code-"), "tidewagon.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tidewagon", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)  # served by the driver
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Later steps read it instead of computing it again, and a lost executor takes none of it along.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, object] = {}


def kept_in_worker(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps for its later tasks: one thing at a time, so those of several operators do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def reuse_memory() -> None:
    """Let a task's arrays of some MB be made from memory it had before.

    The C library gives the memory of large arrays back at every release, to fetch it page by page for the next one, up to
    twice the size of the largest block it has seen released: so one of 16 MB, never touched, is released here.
    """
    np.empty(1 << 24, dtype=np.uint8)


def strings(column) -> list[str | None]:
    """A pandas column of texts as Python strings, whatever it holds for null."""
    return [t if isinstance(t, str) else None for t in column.tolist()]


def objects(values) -> pd.Series:
    """A pandas column of plain Python objects, which becomes one Arrow array at any size."""
    return pd.Series(list(values), dtype=object)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus))


def held_out(key: str, modulus: int, rest: int) -> Column:
    """Whether the row is kept from learning; a row without an id is not held out."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def bounded_sample(rows: DataFrame, group: str, per_group: int, key: str) -> DataFrame:
    """At most ``per_group`` distinct (``group``, ``key``) of every value of ``group``, chosen by a hash of ``key``; for training only.

    A first cut by the counted share leaves about ``per_group`` rows of each group before anything is put
    in order, so a group with most of the rows never meets in one task. A key that repeats over many rows is one row from
    there on; it leaves fewer than ``per_group`` of its group. Null groups and keys are left out.
    """
    rows = rows.select(group, key).where(F.col(group).isNotNull() & F.col(key).isNotNull())
    counts = written(rows.groupBy(group).agg(F.count("*").alias("_in_group")), "sample-counts")
    # Few groups are broadcast, after a check of their number: a join by group would deal all rows out by group.
    counts = F.broadcast(counts) if counts.count() <= FEW_GROUPS else counts
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
    near = (rows.withColumn("_draw", draw).join(counts, group)
            .where(F.col("_draw") * F.col("_in_group") <= F.lit((per_group * 1.25 + 16) * (1 << 30)))
            .select(group, key, "_draw").distinct())
    order = Window.partitionBy(group).orderBy("_draw", key)
    return (near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= per_group)
            .select(group, key))


def one_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One text of every value of ``keys``: the first by a hash, then by the text. Tasks choose among their own rows first."""
    first = F.min(F.struct(F.xxhash64("text").alias("draw"), F.col("text")))
    return rows.where(F.col("text").isNotNull()).groupBy(*keys).agg(first.alias("_first")).select(*keys, F.col("_first.text"))


def within_budget(texts: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The rows of ``texts``, a written bounded sample, in order of a hash until they have ``budget`` characters.

    A row stays whole if those before it have fewer, so no length is left out. The order is that of narrow rows.
    """
    draw = F.xxhash64(*[F.col(k).cast("string") for k in keys])
    before = F.sum("_chars").over(Window.orderBy("_draw", *keys).rowsBetween(Window.unboundedPreceding, -1))
    narrow = texts.select(*keys, F.length("text").cast("long").alias("_chars"), draw.alias("_draw"))
    kept = narrow.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < budget).select(*keys)
    return texts.join(F.broadcast(kept), keys)  # no more rows than the sample


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int, rest: int,
                   max_chars: int) -> DataFrame:
    """(doc_id, _label, text) of a bounded sample of labelled documents that are not held out, for training.

    The sample is drawn from the narrow label rows. It has at most ``2 * per_class`` rows, which bounds
    the side that is broadcast, so the texts of the documents are not shuffled. It has one text of an id, and texts until
    they have ``max_chars`` characters together; no text is cut or left out for its length. An id with both labels is left out.
    """
    sure = (labels.select("doc_id", F.col(label).cast("int").alias("_label"))
            .where(F.col("_label").isin(0, 1) & (remainder("doc_id", modulus) != rest))
            .groupBy("doc_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_most"))
            .where(F.col("_label") == F.col("_most")).drop("_most"))
    chosen = bounded_sample(sure, "_label", per_class, "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return within_budget(written(one_text(texts, ["doc_id", "_label"]), "labelled-texts"), ["doc_id", "_label"], max_chars)


def with_group_columns(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner",
                       salts: int = 64) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per value of ``key`` (nulls are a value).

    Few groups are broadcast, after a check of their number. Many are joined with the rows of ``rows``, a written table,
    dealt out to ``salts`` copies of their group, so a group with most of the rows is spread over so many tasks.
    """
    right = groups.select(F.col(key).alias("_group"), *[c for c in groups.columns if c != key])
    same = F.col(key).eqNullSafe(F.col("_group"))
    if groups.count() <= FEW_GROUPS:
        return rows.join(F.broadcast(right), same, how).drop("_group")
    copies = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    return salted.join(copies, same & (F.col("_salt") == F.col("_copy")), how).drop("_group", "_salt", "_copy")
