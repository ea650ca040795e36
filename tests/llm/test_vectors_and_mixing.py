"""Mixing, centroid clustering and vector codes against plain computations, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewagon.llm import centroids, common, mixing, vector_codes
from tidewagon.llm.common import ship, with_group_columns

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, code string, distance long"


def random_vectors(count: int, width: int = 64, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((5, width)) * 0.2
    return [(int(i), (middle[i % 5] + rng.standard_normal(width) * 0.1).astype(np.float32).tolist(), int(i % 3) if i % 7 else None,
             1, "x", 2) for i in range(count)]


AWKWARD = [(100, None, 1, 1, "x", 2), (101, [], 1, 1, "x", 2), (102, [0.5] * 63, 1, 1, "x", 2),
           (103, [0.5] * 63 + [None], 1, 1, "x", 2), (104, [0.5] * 63 + [float("nan")], 1, 1, "x", 2),
           (105, [0.5] * 63 + [float("inf")], 1, 1, "x", 2), (None, [0.25] * 64, 2, 1, "x", 2), (3, [0.25] * 64, None, 1, "x", 2),
           (3, [0.25] * 64, None, 1, "x", 2), (106, [1e30] * 64, 0, 1, "x", 2)]


def floors(vector, scale: int) -> list[int]:
    return [max(-(1 << 24), min(1 << 24, math.floor(scale * x))) for x in vector]


def usable(vector, width=None) -> bool:
    return vector is not None and (width is None or len(vector) == width) and all(
        x is not None and math.isfinite(x) for x in vector)


def squared(a, b) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(rows: list[list[int]], start: list[list[int]], rounds: int):
    """Plain rounds: entries, codes and distances."""
    entries = [list(e) for e in start]
    for number in range(rounds + 1):
        codes = [min(range(len(entries)), key=lambda k: (squared(r, entries[k]), k)) for r in rows]
        if number == rounds:
            return entries, codes, [squared(r, entries[c]) for r, c in zip(rows, codes)]
        for k in range(len(entries)):
            mine = [r for r, c in zip(rows, codes) if c == k]
            if mine:
                entries[k] = [sum(x) // len(mine) for x in zip(*mine)]


# --- centroids -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 64])
def test_scanning_outwards_finds_the_nearest(width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-20, 20, size=(40, width))
    entries[7] = entries[3]  # ties
    rows = np.concatenate([rng.integers(-30, 30, size=(500, width)), entries, -entries])
    found, distance, measured = centroids.Centroids(entries).nearest(rows)
    plain = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert measured < plain.size


def test_most_centroids_are_rejected():
    rng = np.random.default_rng(1)
    entries = rng.integers(-1000, 1000, size=(200, 1)) + rng.integers(-20, 20, size=(200, 64))
    rows = entries[rng.integers(200, size=1000)] + rng.integers(-20, 20, size=(1000, 64))
    _, _, measured = centroids.Centroids(entries).nearest(rows)
    assert measured < 0.1 * 200 * 1000


def test_largest_integers_stay_exact():
    far = 1 << 24
    entries = np.array([[far] * 64, [-far] * 64, [far] * 63 + [far - 1]])
    found, distance, _ = centroids.Centroids(entries).nearest(np.array([[far] * 64, [-far] * 64, [far] * 63 + [far - 2]]))
    assert found.tolist() == [0, 1, 2] and distance.tolist() == [0, 0, 1]


@pytest.mark.parametrize("extra", [[], AWKWARD])
def test_clusters_equal_plain_rounds(spark, extra):
    ship(spark)
    data = random_vectors(60) + extra
    found = centroids.cluster(spark.createDataFrame(data, VECTORS).repartition(5)).collect()
    kept = [(i, floors(v, 64)) for i, v, *_ in data if usable(v, 64)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    entries, codes, distances = lloyd([r[1] for r in kept], [r[1] for r in ranked[:16]], 3)
    of = defaultdict(int)
    for c, d in zip(codes, distances):
        of[c] += d
    expected = [(i, c, d, of[c], sum(distances), hashlib.sha256(",".join(map(str, entries[c])).encode()).hexdigest())
                for (i, _), c, d in zip(kept, codes, distances)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_fewer_vectors_than_centroids(spark):
    ship(spark)
    rows = centroids.cluster(spark.createDataFrame(random_vectors(3), VECTORS)).collect()
    assert sorted(r["cluster"] for r in rows) == [0, 1, 2] and {r["distance"] for r in rows} == {0}
    assert centroids.cluster(spark.createDataFrame(AWKWARD[:3], VECTORS)).count() == 0


# --- codes -----------------------------------------------------------------------------------------------


def test_balls_equal_a_full_search_over_rounds():
    rng = np.random.default_rng(4)
    middle = rng.integers(-900, 900, size=(16, 8))
    rows = middle[rng.integers(16, size=3000)] + rng.integers(-60, 60, size=(3000, 8))
    entries, codes, reach, ball = rows[:16].copy(), np.zeros(3000, dtype=np.int64), None, None
    ball, asleep, all_measured = vector_codes.Balls(entries), 0, []
    for _ in range(12):
        codes, best, measured = ball.assign(rows, codes)
        plain = ((rows[:, None] - ball.entries[None]) ** 2).sum(axis=2)
        assert (codes == plain.argmin(axis=1)).all()
        all_measured.append(measured)
        totals = np.array([[[int((codes == k).sum()), *rows[codes == k].sum(axis=0).tolist()] for k in range(16)]], dtype=object)
        grown = np.array([[int(max(best[codes == k], default=-1)) for k in range(16)]], dtype=object)
        books, reach, balls = vector_codes._updated(ball.entries[None], totals, [ball], reach, grown)
        ball = balls[0]
        asleep += int(ball.asleep.sum())
        own = ((rows - ball.entries[codes]) ** 2).sum(axis=1)
        assert all(own[codes == k].max(initial=0) <= reach[0, k] for k in range(16))
    assert asleep and all_measured[-1] < all_measured[0] / 3


def test_equal_entries_go_to_the_lower_number():
    entries = np.array([[5, 5], [1, 1], [1, 1], [9, 9]])
    codes, _, _ = vector_codes.Balls(entries).assign(np.array([[1, 1], [3, 3], [7, 7]]), np.array([2, 2, 3]))
    assert codes.tolist() == [1, 0, 0]


@pytest.mark.parametrize("extra", [[], AWKWARD])
def test_codes_equal_plain_rounds(spark, extra):
    ship(spark)
    data = random_vectors(70, seed=2) + extra
    found = vector_codes.compress(spark.createDataFrame(data, VECTORS).repartition(5)).collect()
    kept = [(i, floors(v, 4096), label) for i, v, label, *_ in data if usable(v, 64)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books, codes, errors = [], [""] * len(kept), [0] * len(kept)
    for p in range(8):
        part = slice(8 * p, 8 * p + 8)
        entries, one, distances = lloyd([r[1][part] for r in kept], [r[1][part] for r in first], 6)
        books += itertools.chain.from_iterable(entries)
        codes = [a + f"{c:02x}" for a, c in zip(codes, one)]
        errors = [a + d for a, d in zip(errors, distances)]
    of = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        of[label] += e
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    expected = [(i, c, e, of[label], digest) for (i, _, label), c, e in zip(kept, codes, errors)]
    other = [(i, None, None, of.get(label), digest) for i, v, label, *_ in data if usable(v) and len(v) != 64]
    assert sorted(map(tuple, found), key=repr) == sorted(expected + other, key=repr)


def test_a_dimension_that_does_not_divide_and_nothing_at_all(spark):
    ship(spark)
    rows = vector_codes.compress(spark.createDataFrame(random_vectors(40, width=11), VECTORS)).collect()
    assert len(rows) == 40 and all(len(r["code"]) == 16 and r["error"] >= 0 for r in rows)
    assert vector_codes.compress(spark.createDataFrame([AWKWARD[0]], VECTORS)).count() == 0


def test_columns_of_groups_whatever_their_number(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 2 else i % 3) for i in range(60)], "id int, g int")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"))
    plain = sorted(map(tuple, with_group_columns(rows, groups, "g").collect()), key=repr)
    monkeypatch.setattr(common, "FEW_GROUPS", 0)
    assert sorted(map(tuple, with_group_columns(rows, groups, "g").collect()), key=repr) == plain
    assert len(plain) == 60 and {r[2] for r in plain if r[1] is None} == {30}


# --- mixing ----------------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    target, free, left = {}, set(ordered), 1.5 * sum(sizes.values())
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 500, None: 40}, {"a": 0, "b": 7}, {"z": 1, "Z": 100, "é": 3, "": 9},
                                   {f"s{i}": i * i % 37 for i in range(30)}])
def test_targets_equal_plain_sharing(spark, sizes):
    ship(spark)
    rows = [(s, n) for s, n in sizes.items()]
    found = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    expected = plain_targets(sizes)
    assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) < 1e-6 for s in found)


def test_a_flight_keeps_both_totals_and_leaves_two():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 1000, size=3000).tolist()
    flight, decided = mixing.Flight(5), []
    for i, x in enumerate(sizes):
        flight.add(i, x, 0.3, decided)
    open_ones = flight.held
    assert len(open_ones) <= 2 and len(decided) + len(open_ones) == 3000
    count = sum(e for _, e in decided) + sum(p for _, _, p in open_ones)
    words = sum(sizes[i] * e for i, e in decided) + sum(x * p for _, x, p in open_ones)
    assert abs(count - 900) < 1e-3 and abs(words - 0.3 * sum(sizes)) < 1e-3 * sum(sizes)


def test_every_document_has_its_probability():
    taken = Counter()
    for seed in range(3000):
        flight, decided = mixing.Flight(mixing.draw_seed(seed)), []
        for i, x in enumerate([9, 4, 4, 1, 30]):
            flight.add(i, x, 0.4, decided)
        flight.land(decided)
        assert len(decided) == 5
        taken.update(i for i, e in decided if e)
    assert all(abs(taken[i] / 3000 - 0.4) < 0.05 for i in range(5))


def documents(spark, count: int):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 80))), ["a", "b", "c", "d", None][min(int(rng.exponential(1.2)), 4)], 1, "x")
            for i in range(count)]
    rows += [(7, "same words here", "b", 1, "x")] * (count // 3)  # many copies of a row
    rows += [(None, None, "a", 1, "x"), (None, "", None, 1, "x"), (1, " \t\n", "empty", 1, "x"), (2, "w " * 5000, "d", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")


def test_sources_come_near_their_targets(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 30)
    docs = documents(spark, 3000)
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    taken, target, size, largest = Counter(), {}, Counter(), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    expected = plain_targets(size)
    for s in target:
        assert abs(target[s] - expected[s]) < 1e-6
        assert abs(taken[s] - target[s]) <= 0.01 * size[s] + 100


def test_a_mix_depends_on_the_rows_alone(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    docs = documents(spark, 600)
    one, two = mixing.mix(docs.repartition(2)), mixing.mix(docs.repartition(13).orderBy(F.rand(3)))
    key = lambda r: repr(tuple(r))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


def test_nothing_to_mix(spark):
    ship(spark)
    docs = documents(spark, 3)
    assert mixing.mix(docs.where("false")).count() == 0
    silent = docs.where("doc_id is null").withColumn("doc_id", F.lit("q-1"))
    assert {(r["taken"], r["target"]) for r in mixing.mix(silent).collect()} == {(0, 0.0)}
