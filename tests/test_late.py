"""Late records against a clock moved record by record in Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from make import MIN, T0
from tidewagon.operators.late import late_events, stream_times


def _records(n: int):
    rng = random.Random(4)
    return [(i, rng.choice(("a", "b", "b", "b", None)), T0 + i * MIN - rng.choice((0, 0, 0, 30, 400)) * MIN if i % 50 else None)
            for i in range(n)]


@pytest.mark.parametrize("by", [(), ("site",)])
def test_the_clock_moves_with_every_record(spark, by):
    data = _records(700)
    df = spark.createDataFrame(data, "seq long, site string, timestamp long").repartition(6)
    clocks, expected, late = {}, [], []
    for seq, site, at in data:
        key = site if by else "all"
        clocks[key] = max((t for t in (clocks.get(key), at) if t is not None), default=None)
        expected.append((seq, clocks[key]))
        if at is not None:
            pane = at - at % (30 * MIN)
            late += [(seq, s) for s in (pane, pane - 30 * MIN) if s + 65 * MIN <= clocks[key]]
    found = stream_times(df, [F.col("seq")], by).collect()
    assert sorted((r["seq"], r["stream_time"]) for r in found) == expected
    dropped = late_events(df, [F.col("seq")], 60 * MIN, 30 * MIN, 5 * MIN, by).collect()
    assert late and sorted((r["seq"], r["window_start"]) for r in dropped) == sorted(late)


def test_the_end_of_a_window_and_its_grace(spark):
    rows = [(0, T0), (1, T0 + 65 * MIN - 1), (2, T0 + 1), (3, T0 + 65 * MIN), (4, T0 + 1)]
    df = spark.createDataFrame(rows, "seq long, timestamp long")
    found = late_events(df, [F.col("seq")], 60 * MIN, 60 * MIN, 5 * MIN)
    assert [(r["seq"], r["window_end"]) for r in found.collect()] == [(4, T0 + 60 * MIN)]
    assert late_events(df.where("false"), [F.col("seq")], 60 * MIN, 60 * MIN, 0).count() == 0
