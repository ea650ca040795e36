"""Vectors as exact integers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

LIMIT = 1 << 24  # integers are held within this, so that all products and sums stay exact
TREE = 256


def integers(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a batch, and floor(scale * x) of their components.

    Usable are vectors of ``width`` components, none of them null or not finite. An integer beyond
    ``LIMIT`` (an x beyond LIMIT / scale) becomes that limit.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == width)
    flat = pc.cast(column.take(pa.array(at)).flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    values = flat.reshape(len(at), width)
    good = np.isfinite(values).all(axis=1)
    scaled = np.clip(np.floor(values[good] * scale), -LIMIT, LIMIT)
    return at[good], scaled.astype(np.int64)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), type=kind))


def first_vectors(rows: DataFrame, key: str, vector: str, count: int, scale: int, width: int) -> np.ndarray:
    """The ``count`` usable vectors with the smallest keys (null keys last, ties by components), in that order.

    Every task hands on its own first ones, and groups of ``TREE`` tasks theirs, so what reaches the driver
    is ``count`` rows for so many tasks.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        keys = None
        for batch in batches:
            at, numbers = integers(batch.column(1), scale, width)
            keys = batch.column(0).take(pa.array(at))
            order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
            if len(order) > count:  # and all that tie with the last of them
                last = keys[int(order[count - 1])].as_py()
                tie = count
                while tie < len(order) and keys[int(order[tie])].as_py() == last:
                    tie += 1
                order = order[:tie]
            for i in order.tolist():
                k = keys[i].as_py()
                held.append(((k is None, k if k is not None else 0), numbers[i].tolist()))
            held = sorted(held)[:count]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if k[0] else k[1] for k, _ in held], type=keys.type),
                 pa.array([v for _, v in held], type=pa.list_(pa.int32())),
                 pa.array([TaskContext.get().partitionId()] * len(held), type=pa.int32())], ["key", "numbers", "node"])

    narrow = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = narrow.schema["key"].dataType.simpleString()
    own = narrow.mapInArrow(smallest, f"key {kind}, numbers array<int>, node int")
    order = [F.col("key").asc_nulls_last(), F.col("numbers")]
    few = (own.withColumn("place", F.row_number().over(
        Window.partitionBy(F.expr(f"node div {TREE}")).orderBy(*order))).where(F.col("place") <= count))
    found = [r["numbers"] for r in few.orderBy(*order).limit(count).collect()]
    return np.array(found, dtype=np.int64).reshape(len(found), width)
