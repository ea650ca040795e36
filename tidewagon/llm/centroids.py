"""Centroid clustering (12): equal-average equal-variance nearest-neighbour search.

Lloyd's rounds over integer vectors, with the exact nearest centroid of every vector found by scanning outwards.
The centroids are sorted by the mean of their components. The scan starts at the mean of the vector and takes the nearer
mean of both sides. With D components, sums S and spreads T = sqrt(D * sum of squares - S * S),

    D * distance >= (S_x - S_c) ** 2                          (equal average)
    D * distance >= (S_x - S_c) ** 2 + (T_x - T_c) ** 2       (equal variance)

Once the first bound exceeds the best distance so far, all centroids further out are rejected at once; the second
one rejects single centroids. Only what is left is measured, in integers; equal distances go to the smaller number.

A round is one pass over the vectors. Every task adds up its own members of a centroid; what meets on the driver is
one sum per centroid and component. Nothing but these sums is shuffled, and no state is kept between rounds but the centroids.

Cases: vectors of another length, null vectors and those with null or non-finite components are left out. Integers beyond
2**24 (a component beyond 2**18) are held at that limit. Repeated ids are vectors of their own; a null id is kept, but starts
a centroid only when too few ids are left. With fewer vectors than centroids there are as many centroids as vectors;
without any the result is empty. A sum of distances over 2**63 - 1 is given as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewagon.llm.common import written
from tidewagon.llm.vectors import first_vectors, integers

COMPONENTS, SCALE = 64, 64
CENTROIDS, ROUNDS, SEED = 16, 3, 1
_LARGEST = (1 << 63) - 1


class Centroids:
    """The index over one set of centroids."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.number], sums[self.number]
        self.spread = _spread(self.entries, self.sums)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of every row, its squared distance, and how many distances were measured."""
        count, width = self.entries.shape
        sums = rows.sum(axis=1)
        spread = _spread(rows, sums)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best = np.full(len(rows), (1 << 62) // width, dtype=np.int64)
        found = np.full(len(rows), count, dtype=np.int64)
        far, measured = np.int64((1 << 31) + 1), 0
        open_rows = np.arange(len(rows))
        for _ in range(count):
            down, up, at = low[open_rows], high[open_rows], sums[open_rows]
            below = np.where(down >= 0, at - self.sums[np.maximum(down, 0)], far)
            above = np.where(up < count, self.sums[np.minimum(up, count - 1)] - at, far)
            lower = below <= above
            gap = np.where(lower, below, above) ** 2
            within = gap <= width * best[open_rows]
            open_rows, lower, gap = open_rows[within], lower[within], gap[within]
            if not len(open_rows):
                break
            place = np.where(lower, low[open_rows], high[open_rows])
            low[open_rows[lower]] -= 1
            high[open_rows[~lower]] += 1
            # The roots are rounded, so the bound is taken a little lower than it is.
            apart = np.abs(spread[open_rows] - self.spread[place])
            apart = np.maximum(apart * (1 - 1e-9) - 1e-4, 0.0)
            close = gap + apart * apart <= width * best[open_rows].astype(np.float64) * (1 + 1e-9)
            some, place = open_rows[close], place[close]
            difference = rows[some] - self.entries[place]
            distance = np.einsum("ij,ij->i", difference, difference)
            measured += len(some)
            name = self.number[place]
            better = (distance < best[some]) | ((distance == best[some]) & (name < found[some]))
            best[some[better]], found[some[better]] = distance[better], name[better]
        return found, best, measured


def _spread(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.shape[1] * np.einsum("ij,ij->i", rows, rows) - sums * sums).astype(np.float64))


def member_sums(vectors: DataFrame, vector: str, entries: np.ndarray, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number of members and componentwise sums of every centroid that has members."""
    count, width = entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(entries)
        sums, members = np.zeros((count, width), dtype=np.int64), np.zeros(count, dtype=np.int64)
        for batch in batches:
            _, rows = integers(batch.column(0), scale, width)
            found, _, _ = index.nearest(rows)
            members += np.bincount(found, minlength=count)
            one = np.zeros((count, len(rows)))
            one[found, np.arange(len(rows))] = 1
            sums += (one @ rows).astype(np.int64)  # far below 2**53, so exact
        some = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, type=pa.int32()),
             pa.array([[int(members[k]), *sums[k].tolist()] for k in some], type=pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = vectors.select(vector).mapInArrow(add, "cluster int, sums array<long>")
    rows = (parts.select("cluster", F.posexplode("sums").alias("place", "value")).groupBy("cluster", "place")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())  # centroids x components
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r["cluster"], [0] * (width + 1))[r["place"]] = int(r["value"])
    return {k: (v[0], v[1:]) for k, v in found.items()}


def fit(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS,
        rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds; they start as the vectors with the smallest SHA-256 of ``seed:id``."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    keyed = vectors.select(drawn.alias("drawn"), F.col(vector).alias("vector"))
    entries = first_vectors(keyed, "drawn", "vector", centroids, scale, components)
    for _ in range(rounds if len(entries) else 0):
        for k, (members, sums) in member_sums(vectors, vector, entries, scale).items():
            entries[k] = [s // members for s in sums]
    return entries


def assign(vectors: DataFrame, entries: np.ndarray, id_column: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance) of every usable vector."""
    width = entries.shape[1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(entries)
        for batch in batches:
            at, rows = integers(batch.column(1), scale, width)
            found, distance, _ = index.nearest(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(found, type=pa.int32()), pa.array(distance)],
                [id_column, "cluster", "distance"])

    narrow = vectors.select(id_column, vector)
    kind = narrow.schema[id_column].dataType.simpleString()
    return narrow.mapInArrow(find, f"`{id_column}` {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS,
            rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    entries = fit(vectors, id_column, vector, centroids, rounds, components, scale, seed)
    kind = vectors.schema[id_column].dataType.simpleString()
    if not len(entries):
        return spark.createDataFrame([], f"`{id_column}` {kind}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    assigned = written(assign(vectors, entries, id_column, vector, scale), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row per centroid
    whole = min(sum(sums.values()), _LARGEST)
    facts = spark.createDataFrame(
        [(k, min(s, _LARGEST), whole, hashlib.sha256(",".join(map(str, entries[k].tolist())).encode()).hexdigest())
         for k, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # a row per centroid
        id_column, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    usable = f"""embedding IS NOT NULL AND len(embedding) = {COMPONENTS}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}"""
    steps = [f"""WITH v AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS r,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE {usable}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x
    FROM (SELECT sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {CENTROIDS}))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT vec_id, r, x, k, d FROM (
        SELECT v.vec_id, v.r, v.x, c.k,
               list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM v, c{i} AS c)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS MATERIALIZED (
    SELECT k, list(m ORDER BY i) AS x FROM (
        SELECT k, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM (SELECT k, unnest(x) AS y, unnest(range({COMPONENTS})) AS i FROM a{i}) GROUP BY k, i)
    GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.x, c.x) AS x FROM c{i} AS c LEFT JOIN s{i} AS s ON c.k = s.k)""")
    return ",\n".join(steps) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN c{ROUNDS} AS c ON a.k = c.k"""


ORACLE_SQL = _oracle()
