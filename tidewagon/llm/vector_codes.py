"""Vector code compression (13): product quantisation, its codebooks learned by ball k-means.

A vector of integers is cut into equal parts; each part position has a codebook of its own, and a part is replaced by
the number of the nearest entry. The codebooks are learned by Lloyd's rounds, whose assignment step is that of ball k-means:

* The parts that an entry holds form its ball. Its radius is the greatest distance in it, counted when the parts were
  assigned and increased by what the entry moved since. Entries within twice the radius are its neighbours;
  no other entry can take a part of the ball.
* A part nearer to its entry than half way to the nearest neighbour is in the stable core and keeps its code. The rest
  is cut into rings by the half distances to the neighbours: a part in ring m is compared with the m nearest only.
* A ball without neighbours, or that has not moved and whose neighbours have not, is left as it is.

All comparisons are of integers (4 * d(x, own) < d(own, other) for the squared distances d), radii are rounded up; so
the codes are those of a full search, ties to the lower number.

A ball must know its members, so every round writes integers and codes to the shared folder, taking two folders in turn, and reads
them again: nothing is shuffled, and what reaches the driver is one row per entry and component. Tasks hand on only
the sums of the parts that changed their entry; they stand in the same files as rows of their own.

Cases: null vectors and those with null or non-finite components are left out. The dimension is the most frequent
length (of equally frequent ones the greatest); usable vectors of another length keep their row, with null code and error.
A dimension that is no multiple of the number of parts is filled up with zeros. Integers beyond 2**24 are held at that limit.
Repeated ids are vectors of their own; null ids come last when the first codebook is chosen. With fewer vectors than
entries the codebooks are that small; without vectors the result is empty. Sums over 2**63 - 1 are given as that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewagon.llm.common import with_group_columns
from tidewagon.llm.vectors import first_vectors, integers, lists
from tidewagon.session import shared_folder

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_LARGEST = (1 << 63) - 1


class Balls:
    """One codebook with the ball around every entry. ``reach`` bounds the squared radii, None: no bound is known;
    ``moved`` tells which entries have moved since the codes were given."""

    def __init__(self, entries: np.ndarray, reach: list[int] | None = None, moved: np.ndarray | None = None):
        self.entries = entries
        count = len(entries)
        between = np.stack([((entries - e) ** 2).sum(axis=1) for e in entries])
        self.order, self.half = [], []  # neighbours of an entry by distance, and 4 * (half that distance) ** 2
        self.asleep = np.zeros(count, dtype=bool)
        for j in range(count):
            others = np.delete(np.arange(count), j)
            others = others[np.argsort(between[j, others], kind="stable")]
            if reach is not None:  # a neighbour is within twice the radius
                others = others[between[j, others] <= 4 * reach[j]]
            self.order.append(others)
            self.half.append(between[j, others])
            self.asleep[j] = not len(others) or (moved is not None and not moved[j] and not moved[others].any())

    def assign(self, rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New codes of parts with known codes, the squared distances (-1: not measured), and how many were measured."""
        found, best = codes.copy(), np.full(len(rows), -1, dtype=np.int64)
        measured = 0
        for j in np.unique(codes):
            if self.asleep[j]:
                continue
            here = np.flatnonzero(codes == j)
            own = self.distance(rows[here], j)
            measured += len(here)
            # Number of the ring: how many neighbours are less than twice as far from the entry as the part is, or just so far.
            ring = np.searchsorted(self.half[j], 4 * own, side="right")
            near, name = own.copy(), np.full(len(here), j, dtype=codes.dtype)
            for m in range(int(ring.max())):
                some = np.flatnonzero(ring > m)
                other = self.order[j][m]
                d = self.distance(rows[here[some]], other)
                measured += len(some)
                better = (d < near[some]) | ((d == near[some]) & (other < name[some]))
                near[some[better]], name[some[better]] = d[better], other
            found[here], best[here] = name, near
        return found, best, measured

    def distance(self, rows: np.ndarray, entry: int) -> np.ndarray:
        difference = rows - self.entries[entry]
        return np.einsum("ij,ij->i", difference, difference)


_STATE = "numbers array<int>, codes array<int>, part int, entry int, sums array<long>, reach long"


def _state_schema(rows: DataFrame, id_column: str, label: str) -> str:
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (id_column, label)]
    return ", ".join([*kinds, _STATE])


def _first_state(vectors: DataFrame, id_column: str, label: str, vector: str, scale: int, width: int, parts: int) -> DataFrame:
    """id, label and integers of every vector that has no null or non-finite component; null integers for another length."""
    padded = -(-width // parts) * parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            at, rows = integers(column, scale, width)
            if padded > width:
                rows = np.pad(rows, ((0, 0), (0, padded - width)))
            other = _of_other_length(column, width)
            ids = pa.array(np.concatenate([at, other]))
            numbers = pa.concat_arrays([lists(rows, pa.int32()), pa.nulls(len(other), pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), numbers],
                                             [id_column, label, "numbers"])

    narrow = vectors.select(id_column, label, vector)
    kinds = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in (id_column, label)]
    return narrow.mapInArrow(cut, ", ".join([*kinds, "numbers array<int>"])).withColumn(
        "codes", F.lit(None).cast("array<int>"))


def _of_other_length(column: pa.Array, width: int) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero((lengths >= 0) & (lengths != width))
    good = [all(x is not None and np.isfinite(x) for x in column[int(i)].as_py()) for i in places]
    return places[np.array(good, dtype=bool)] if len(places) else places


def _one_round(state: DataFrame, id_column: str, label: str, books: list[Balls]) -> DataFrame:
    """The state with new codes, and rows (part, entry, sums, reach) of every task: what its balls gained, count first,
    and the greatest distance in them; -1 for a ball that was left as it is."""
    parts, count = len(books), len(books[0].entries)
    names = [id_column, label, "numbers", "codes", "part", "entry", "sums", "reach"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = books[0].entries.shape[1]
        gained = np.zeros((parts, count, length + 1), dtype=np.int64)
        reach = np.full((parts, count), -1, dtype=np.int64)
        head = None
        for batch in batches:
            head = batch.schema
            numbers, old = batch.column(2), batch.column(3)
            known = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
            rows = numbers.take(pa.array(known)).flatten().to_numpy().astype(np.int64).reshape(len(known), parts, length)
            codes = np.zeros((len(known), parts), dtype=np.int64)
            first = old.null_count == len(old)
            if not first:
                codes = old.take(pa.array(known)).flatten().to_numpy().astype(np.int64).reshape(len(known), parts)
            now = codes.copy()
            for p in range(parts):
                now[:, p], best, _ = books[p].assign(rows[:, p], codes[:, p])
                moved = np.arange(len(known)) if first else np.flatnonzero(now[:, p] != codes[:, p])
                if len(moved):
                    change = np.zeros((count, len(moved)))
                    change[now[moved, p], np.arange(len(moved))] += 1
                    if not first:
                        change[codes[moved, p], np.arange(len(moved))] -= 1
                    gained[p, :, 0] += change.sum(axis=1).astype(np.int64)
                    gained[p, :, 1:] += (change @ rows[moved, p]).astype(np.int64)
                np.maximum.at(reach[p], now[:, p], best)
            place = np.full(len(numbers), -1)
            place[known] = np.arange(len(known))
            coded = lists(now, pa.int32()).take(pa.array(place, mask=place < 0))
            yield _state_batch(names, [batch.column(0), batch.column(1), numbers, coded])
        if head is not None:
            p, e = np.divmod(np.arange(parts * count), count)
            yield _state_batch(names, [
                pa.nulls(parts * count, head.field(0).type), pa.nulls(parts * count, head.field(1).type),
                pa.nulls(parts * count, head.field(2).type), pa.nulls(parts * count, pa.list_(pa.int32())),
                pa.array(p, type=pa.int32()), pa.array(e, type=pa.int32()),
                lists(gained.reshape(parts * count, -1), pa.int64()), pa.array(reach.ravel())])

    return state.mapInArrow(work, _state_schema(state, id_column, label))


def _state_batch(names: list[str], columns: list[pa.Array]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()]
    n = len(columns[0])
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(n, kinds[k - 4]) for k in range(len(columns), 8)], names)


def _rows(state: DataFrame, id_column: str, label: str) -> DataFrame:
    return state.where(F.col("part").isNull()).select(id_column, label, "numbers", "codes")


def learn(vectors: DataFrame, id_column: str, label: str, vector: str, scale: int, parts: int, entries: int, rounds: int):
    """The codebooks (parts x entries x length) and the written state with the codes of the last round; None without vectors."""
    spark = vectors.sparkSession
    sizes = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        return None
    width = top["width"]
    first = first_vectors(vectors, id_column, vector, entries, scale, width)
    if not len(first):
        return None
    first = np.pad(first, ((0, 0), (0, -width % parts)))
    count, length = len(first), first.shape[1] // parts
    books = first.reshape(count, parts, length).transpose(1, 0, 2).copy()
    totals = np.zeros((parts, count, length + 1), dtype=object)
    folders = [shared_folder(spark, "codes-even"), shared_folder(spark, "codes-odd")]
    state = _first_state(vectors, id_column, label, vector, scale, width, parts)
    balls = [Balls(b) for b in books]
    reach = None
    for number in range(rounds):
        after = _one_round(state, id_column, label, balls)
        after.write.mode("overwrite").parquet(folders[number % 2])
        held = spark.read.schema(after.schema).parquet(folders[number % 2])
        gains = (held.where(F.col("part").isNotNull()).select("part", "entry", "reach", F.posexplode("sums").alias("at", "v"))
                 .groupBy("part", "entry", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"),
                                                    F.max("reach").alias("reach")).collect())
        grown = np.full((parts, count), -1, dtype=object)
        for r in gains:  # parts x entries x components
            totals[r["part"], r["entry"], r["at"]] += int(r["v"])
            grown[r["part"], r["entry"]] = int(r["reach"])
        books, reach, balls = _updated(books, totals, balls, reach, grown)
        state = _rows(held, id_column, label)
    return books, balls, state


def _updated(books: np.ndarray, totals: np.ndarray, balls: list[Balls], reach, grown):
    """New codebooks from the sums, bounds of the squared radii around the new entries, and their balls."""
    new = books.copy()
    bounds = np.zeros(grown.shape, dtype=object)
    for p in range(len(books)):
        for e in range(len(books[p])):
            members, sums = totals[p, e, 0], totals[p, e, 1:]
            if members:
                new[p, e] = [s // members for s in sums]
            # A ball that was left as it is keeps the bound that it had; parts of others may have come in as well.
            before = max(grown[p, e], reach[p, e]) if balls[p].asleep[e] and reach is not None else grown[p, e]
            shift = float(((new[p, e] - books[p, e]).astype(np.float64) ** 2).sum()) ** 0.5
            bounds[p, e] = int(((max(before, 0) ** 0.5 + shift) * (1 + 1e-9)) ** 2) + 1 if shift else max(before, 0)
    moved = (new != books).any(axis=2)
    return new, bounds, [Balls(new[p], list(bounds[p]), moved[p]) for p in range(len(new))]


def compress(vectors: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
             scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every vector."""
    spark = vectors.sparkSession
    learned = learn(vectors, id_column, label, vector, scale, parts, entries, rounds)
    kind = vectors.schema[id_column].dataType.simpleString()
    if learned is None:
        return spark.createDataFrame([], f"`{id_column}` {kind}, code string, error long, label_error long, "
                                         "codebooks_sha256 string")
    books, balls, state = learned
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, old = batch.column(2), batch.column(3)
            known = np.flatnonzero(numbers.is_valid().to_numpy(zero_copy_only=False))
            rows = numbers.take(pa.array(known)).flatten().to_numpy().astype(np.int64)
            rows = rows.reshape(len(known), len(balls), -1)
            codes = old.take(pa.array(known)).flatten().to_numpy().astype(np.int64).reshape(len(known), len(balls)) \
                if old.null_count < len(old) else np.zeros((len(known), len(balls)), dtype=np.int64)
            error = np.zeros(len(known), dtype=np.int64)
            for p, ball in enumerate(balls):
                codes[:, p], _, _ = ball.assign(rows[:, p], codes[:, p])
                difference = rows[:, p] - ball.entries[codes[:, p]]
                error += np.einsum("ij,ij->i", difference, difference)
            code, errors = [None] * len(numbers), [None] * len(numbers)
            for i, c, e in zip(known.tolist(), codes.tolist(), error.tolist()):
                code[i], errors[i] = "".join(f"{x:02x}" for x in c), e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, type=pa.string()),
                                              pa.array(errors, type=pa.int64())], [id_column, label, "code", "error"])

    label_kind = vectors.schema[label].dataType.simpleString()
    coded = state.mapInArrow(encode, f"`{id_column}` {kind}, `{label}` {label_kind}, code string, error long")
    folder = shared_folder(spark, "codes-final")
    coded.write.parquet(folder)
    coded = spark.read.schema(coded.schema).parquet(folder)
    errors = coded.groupBy(label).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)"))
                                      .cast("long").alias("label_error"))
    return with_group_columns(coded, errors, label).select(
        id_column, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    steps = [f"""WITH v AS MATERIALIZED (
    SELECT vec_id, label, row_number() OVER () AS r, len(embedding) // {PARTS} AS width,
           list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, p, list_slice(x, p * width + 1, (p + 1) * width) AS x FROM v, range({PARTS}) AS t(p)),
c0 AS MATERIALIZED (
    SELECT q.p, f.k, q.x FROM q JOIN (
        SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS k FROM v
        ORDER BY vec_id NULLS LAST, x LIMIT {ENTRIES}) AS f ON q.r = f.r)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT r, p, x, k, d FROM (
        SELECT q.r, q.p, q.x, c.k,
               list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM q JOIN c{i} AS c ON q.p = c.p)
    QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, k) = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS MATERIALIZED (
    SELECT p, k, list(m ORDER BY i) AS x FROM (
        SELECT p, k, i, CAST((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM (SELECT p, k, unnest(x) AS y, unnest(range(len(x))) AS i FROM a{i}) GROUP BY p, k, i)
    GROUP BY p, k),
c{i + 1} AS MATERIALIZED (
    SELECT c.p, c.k, coalesce(s.x, c.x) AS x FROM c{i} AS c LEFT JOIN s{i} AS s ON c.p = s.p AND c.k = s.k)""")
    return ",\n".join(steps) + f""",
codes AS (SELECT r, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM a{ROUNDS} GROUP BY r)
SELECT v.vec_id, codes.code, codes.error, CAST(sum(codes.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN codes ON v.r = codes.r"""


ORACLE_SQL = _oracle()
