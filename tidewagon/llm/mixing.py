"""Mixing sources to target weights (11): balanced sampling by the cube method.

Every source has a target in words. With r = target / size of the source, each of its documents is taken floor(r) times
and once more with probability r - floor(r). The cube method draws that last copy so that, in every source, the number of
documents and the number of words come out as expected, up to a small rest.

Flight: three documents with open probabilities are held. Their probabilities move along the direction that changes
neither the count nor the words (the null-space of the two constraints, the cross product of (1, 1, 1) and the three sizes) until one of
them is 0 or 1; that document is decided and the next one takes its place. Which way it goes is drawn so that the
probabilities are kept on average. What is left of a source has at most two documents with different sizes.
Landing: their outcomes are drawn with the given probabilities by the joint distribution that has the
smallest expected error in words.

A large document would stay open to the end, as small ones reach 0 or 1 before it, and leave its source far off. So those with more
than 1 / ``LARGE`` of the words of a source fly and land first, and the probabilities of all others move together to make up for
what that changed in words, which again keeps the words of the source, and the probabilities on average unless they meet 0 or
the limit of copies.

Rows are dealt out to blocks of about ``BLOCK_ROWS`` by a hash of what is in them, and every source flies in each block on its own,
large documents first. The few open documents of ``TREE`` blocks then fly together, and so on up a tree; the landing is at
its root. So no task ever holds more than one block's stream, a source of any size is spread over many blocks,
and the result depends on the rows alone, not on partitions. Rows with the same id, source and size are interchangeable; they are
counted before they are dealt out, in chunks, so many copies of a row are many blocks' work.

Targets: sources in code point order (null last) weigh 5, 2, 1 and again 5, 2, 1; they share 150 % of all words by
weight, a target is at most twice its source, and what is above is shared by weight among the others until none is above. Positions and
sums over the sources are distributed as well, so there may be many.

Cases: null, empty and blank texts have no words; they are documents of size 0. A source without words has the target 0, and
its documents are not taken. Null and repeated ids are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.functions.ranges import numbered
from tidewagon.llm.common import with_group_columns, written

WEIGHTS = (5, 2, 1)
TOTAL = 1.5  # of all words
MOST = 2.0  # times its size that a source may be taken
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 1_000
CHUNK_ROWS = 500  # rows alike that are dealt out together
TASK_ROWS = 200_000
LARGE = 100  # a document with more than this part of the words of its source is large
TREE = 128
NEAR = 1e-9  # a probability this close to 0 or 1 is that


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of every document, as a written table."""
    count = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", F.col("source").cast("string").alias("source"), count.alias("size")), "mix-sizes")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of every source, as a written table."""
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = numbered(sums, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    held = written(placed.withColumn("weight", weight).drop("_place"), "mix-weights")
    cap = F.col("source_size") * F.lit(most)
    whole = held.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, number = 0.0, -1  # words for each unit of weight; sources below their cap
    while True:
        # In every pass the sources that would be above their cap are held at it; the rest shares what they leave.
        free = F.col("weight") * F.lit(level) <= cap
        rest = held.agg(F.count(F.when(free, 1)).alias("n"), F.sum(F.when(free, F.col("weight"))).alias("w"),
                        F.sum(F.when(~free, cap)).alias("c")).first()
        if rest["n"] in (0, number):
            break
        number, level = rest["n"], (whole * total - (rest["c"] or 0.0)) / rest["w"]
    shared = F.col("weight") * F.lit(level)
    return written(held.select("source", "source_size", F.least(shared, cap).cast("double").alias("target")), "mix-targets")


def draw(*numbers: int) -> float:
    """A number in [0, 1) that depends on the given ones alone (a 64-bit mixing step for each)."""
    state = 0x9E3779B97F4A7C15
    for n in numbers:
        state = (state ^ (n & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 29
        state = state * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        state ^= state >> 32
    return (state >> 11) / (1 << 53)


class Flight:
    """Moves the probabilities of the documents of one source. ``decided`` gets (document, taken once more)."""

    def __init__(self, seed: int):
        self.seed, self.steps = seed, 0
        self.held: list[list] = []  # [document, size, probability]

    def add(self, document, size: int, chance: float, decided: list) -> None:
        if chance <= NEAR or chance >= 1 - NEAR:
            decided.append((document, int(chance > 0.5)))
            return
        self.held.append([document, size, chance])
        while len(self.held) > 2 or len(self.held) == 2 and self.held[0][1] == self.held[1][1]:
            self.move(decided)

    def move(self, decided: list) -> None:
        held = self.held
        a = held[0][1]
        b = held[1][1]
        if len(held) == 2 or a == b:
            way = (1.0, -1.0, 0.0)
        else:
            c = held[2][1]
            scale = max(abs(c - b), abs(a - c), abs(b - a))
            way = ((c - b) / scale, (a - c) / scale, (b - a) / scale)
        up = down = math.inf
        for (_, _, p), u in zip(held, way):
            if u > 0:
                up, down = min(up, (1 - p) / u), min(down, p / u)
            elif u < 0:
                up, down = min(up, p / -u), min(down, (1 - p) / -u)
        self.steps += 1
        step = up if draw(self.seed, self.steps) * (up + down) < down else -down
        left = []
        for unit, u in zip(held, way):
            unit[2] += step * u
            if unit[2] <= NEAR or unit[2] >= 1 - NEAR:
                decided.append((unit[0], int(unit[2] > 0.5)))
            else:
                left.append(unit)
        self.held = left

    def land(self, decided: list) -> None:
        """Decide the last one or two documents with their probabilities and the smallest expected error in words."""
        if len(self.held) == 1:
            document, _, p = self.held[0]
            decided.append((document, int(draw(self.seed, -1) < p)))
        elif self.held:
            (one, x, p), (two, y, q) = self.held
            expected = x * p + y * q
            error = [abs(i * x + j * y - expected) for i, j in ((1, 1), (1, 0), (0, 1), (0, 0))]
            joint = [(t, p - t, q - t, 1 - p - q + t) for t in (max(0.0, p + q - 1), min(p, q))]
            best = min(joint, key=lambda w: sum(a * b for a, b in zip(w, error)))
            at, rest = draw(self.seed, -1), 0
            while rest < 3 and at >= best[rest]:
                at -= best[rest]
                rest += 1
            decided += [(one, int(rest in (0, 1))), (two, int(rest in (0, 2)))]
        self.held = []


def _flown(rows: DataFrame, order: list[Column], level: int, last: bool) -> DataFrame:
    """One flight for every node and source of ``rows``, in ``order`` within partitions. ``extra`` is the decision,
    null for what is still open with its new ``chance``."""
    names = rows.columns
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    node, place, source, size, chance, copies = map(
        names.index, ("node", "place", "source", "size", "chance", "copies"))

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, key, kinds_here = None, None, None

        def closed() -> list[tuple]:
            """What the flight leaves: decided by landing, or open for the next level."""
            decided: list = []
            if last:
                flight.land(decided)
            left = [(*row[:chance], p, *row[chance + 1:], None) for row, _, p in flight.held]
            return [(*row, extra) for row, extra in decided] + left

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * (len(names) + 1)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds_here)], [*names, "extra"])

        for batch in batches:
            kinds_here = [*batch.schema.types, pa.int32()]
            out, decided = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                mine = (row[node], row[place], row[source])
                if mine != key:
                    if flight is not None:
                        out += closed()
                    key, flight = mine, Flight(draw_seed(level, row[node], row[place]))
                for _ in range(row[copies]):
                    flight.add(row, row[size], row[chance], decided)
            yield batch_of(out + [(*row, extra) for row, extra in decided])
        if flight is not None:
            yield batch_of(closed())

    return rows.sortWithinPartitions(*order).mapInArrow(fly, f"{kinds}, extra int")


def draw_seed(*numbers: int) -> int:
    return int(draw(*numbers) * (1 << 53))


def _chances(rows: DataFrame, ratio: Column) -> DataFrame:
    return (rows.withColumn("_ratio", ratio).withColumn("base", F.floor("_ratio").cast("int"))
            .withColumn("chance", F.col("_ratio") - F.col("base")).drop("_ratio"))


def _taken_once_more(rows: DataFrame, nodes: int, tasks: int, level: int) -> DataFrame:
    """``rows`` with the decision ``extra``: flights in ``nodes`` blocks, then up the tree, and the landing at its root."""
    order = [F.col("node"), F.col("place"), F.col("source"), F.desc("size"), F.col("draw"), F.col("doc_id")]
    dealt = rows.withColumn("node", F.pmod("draw", F.lit(nodes))).repartition(tasks, "node", *(["place"] if nodes == 1 else []))
    found = None
    while True:
        flown = written(_flown(dealt, order, level, last=nodes == 1), "mix-flown")
        done = flown.where(F.col("extra").isNotNull())
        found = done if found is None else found.unionByName(done)
        if nodes == 1:
            return found
        nodes, level = -(-nodes // TREE), level + 1
        dealt = (flown.where(F.col("extra").isNull()).drop("extra").withColumn("copies", F.lit(1))
                 .withColumn("node", F.expr(f"node div {TREE}")).repartition("node", "place"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies of every document."""
    sized = sizes(docs)
    facts = targets(sized, weights, total, most)
    number = sized.count()
    blocks = max(1, -(-number // BLOCK_ROWS))
    tasks = max(-(-number // TASK_ROWS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Rows alike are counted first, and dealt out in chunks.
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    chunks = (alike.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK_ROWS}").cast("int"))))
              .withColumn("copies", F.least(F.col("n") - F.col("chunk") * CHUNK_ROWS, F.lit(CHUNK_ROWS)).cast("int"))
              .withColumn("draw", F.xxhash64("doc_id", "source", "size", "chunk", F.lit(11)))
              .withColumn("place", F.xxhash64("source")).drop("n", "chunk"))
    dealt = written(with_group_columns(written(chunks, "mix-chunks"), facts, "source"), "mix-dealt")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    # The large ones of a source, fewer than LARGE, are decided first; what they are off the target goes to the rest.
    is_large = F.col("size") * LARGE > F.col("source_size")
    large = _taken_once_more(_chances(dealt.where(is_large), ratio), 1, tasks, -1)
    used = large.groupBy("source").agg(F.sum("size").alias("large_size"), F.sum(
        F.col("size") * (F.col("base") + F.col("extra"))).alias("large_taken"))
    left = written(with_group_columns(facts, used, "source", how="left"), "mix-left")
    space = F.col("source_size") - F.coalesce("large_size", F.lit(0))
    open_words = F.col("target") - F.coalesce("large_taken", F.lit(0))
    left = left.select("source", F.when(space > 0, F.least(F.greatest(open_words / space, F.lit(0.0)), F.lit(float(most))))
                       .otherwise(ratio).alias("rest_ratio"))
    rest = with_group_columns(dealt.where(~is_large), left, "source")
    small = _taken_once_more(_chances(rest, F.col("rest_ratio")).drop("rest_ratio"), blocks, tasks, 0)
    copies = F.col("base") + F.col("extra")
    return large.unionByName(small).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"),
        copies.alias("copies"))
