"""SimHash near-duplicates (9) with a Gray-order hierarchical index.

Fingerprint: 64 bits over word shingles, a bit is 1 where more than half of the shingles' XXH64 values have it.

Pairs within a few differing bits are found on the distinct fingerprints only, so a group of copies of any
size is one fingerprint. By the pigeonhole principle two fingerprints within d bits agree on one of d + 1 blocks
of bits, so each fingerprint goes to d + 1 buckets. A bucket that is still large is dealt out again on the bits
not yet used, as often as needed: after a few levels all bits are fixed but a few, so any bucket is bounded
and no pair is lost.

In a bucket the index of the method finds the links: fingerprints are sorted by their rank in the Gray order, so
neighbours share bits; runs of them form leaf groups and runs of leaf groups form upper nodes. Each node holds
the bits that all its members share (mask and pattern), less those its parent holds already. A query adds
up its differences on the way down and leaves a whole group aside once they exceed d.

A bucket hands on its links as a forest over its members, so a cluster of n near copies gives n - 1 rows,
not n * n. Components of the forest rows are joined up by ``components``.

Cases: null, empty and blank texts have fingerprint zero and link like any other. Rows that share an id keep their
own fingerprints; the component id is the smallest id that any row of the component has. Rows with a null id are
linked too; a component of such rows only has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewagon.llm.common import strings, written
from tidewagon.llm.components import smallest_reachable

SHINGLE = 3
DISTANCE = 3
SEED = 42
BITS = 64
LEAF, FAN = 16, 16
# A bucket with more members is dealt out again on its remaining bits.
BUCKET = 32_768
LEVELS = 4
FRONTIER = 1 << 20  # (query, node) pairs in memory at a time
ROWS = 1 << 16  # hashes whose bits are counted at a time

_SPREAD = np.arange(BITS, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype=np.uint64,
                             count=len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), ROWS):
        part = np.unpackbits(hashes[at:at + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        # Sums of at most 255 rows fit a byte, which keeps the addition narrow.
        whole = len(part) // 255 * 255
        if whole:
            ones += np.add.reduce(part[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += part[whole:].sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << _SPREAD).sum())


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long with the same 64 bits."""

    @F.pandas_udf("long")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_signed(fingerprint(t, shingle)) for t in strings(texts)], dtype="int64")

    return printed(text)


# --- the index -------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray order: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _children(parents: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of each parent in a list: (position in the list, child)."""
    sizes = (end - start)[parents]
    position = np.repeat(np.arange(len(parents)), sizes)
    offset = np.arange(len(position)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return position, start[parents][position] + offset


class GrayIndex:
    """Hierarchical index over the fingerprints of several buckets.

    ``codes`` must be sorted by (bucket, Gray rank). The roots are the buckets.
    """

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        self.codes = codes
        edges = np.flatnonzero(np.diff(bucket)) + 1
        self.root_start = np.concatenate([[0], edges])
        self.root_end = np.concatenate([edges, [len(codes)]])
        self.root_of = np.repeat(np.arange(len(self.root_start)), self.root_end - self.root_start)
        # Groups do not reach over the end of a bucket.
        leaf_start, leaf_end = self._groups(self.root_start, self.root_end, LEAF)
        first_leaf = np.searchsorted(leaf_start, self.root_start)
        last_leaf = np.append(first_leaf[1:], len(leaf_start))
        up_start, up_end = self._groups(first_leaf, last_leaf, FAN)
        self.leaf = (leaf_start, leaf_end, *self._shared(leaf_start))
        self.up = (up_start, up_end, *self._shared(leaf_start[up_start]))
        first_up = np.searchsorted(up_start, first_leaf)
        self.root_up = (first_up, np.append(first_up[1:], len(up_start)))
        parent = np.repeat(np.arange(len(up_start)), up_end - up_start)
        self.leaf_rest = self.leaf[2] & ~self.up[2][parent]  # bits that the parent does not hold already

    @staticmethod
    def _groups(start: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        count = -(-(end - start) // size)
        owner = np.repeat(np.arange(len(start)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first = start[owner] + place * size
        return first, np.minimum(first + size, end[owner])

    def _shared(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mask of the bits on which the members of each group agree, and their pattern."""
        all_ones = np.bitwise_and.reduceat(self.codes, start)
        any_one = np.bitwise_or.reduceat(self.codes, start)
        return ~(all_ones ^ any_one), all_ones

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of the same bucket within ``distance`` bits, in pieces of bounded size."""
        width = (self.root_end - self.root_start)[self.root_of]
        cost = np.cumsum(np.maximum(1, width // (LEAF * FAN) + 1))
        at = 0
        while at < len(self.codes):
            till = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER // 64)))
            yield from self._descend(np.arange(at, min(till, len(self.codes))), distance)
            at = till

    def _descend(self, queries: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        position, node = _children(self.root_of[queries], *self.root_up)
        query = queries[position]
        differ = np.bitwise_count((self.codes[query] ^ self.up[3][node]) & self.up[2][node])
        keep = differ <= distance
        query, node, differ = query[keep], node[keep], differ[keep]
        for a in range(0, len(query), FRONTIER // FAN):
            q, n, d = (x[a:a + FRONTIER // FAN] for x in (query, node, differ))
            position, leaf = _children(n, self.up[0], self.up[1])
            q, d = q[position], d[position] + np.bitwise_count((self.codes[q[position]] ^ self.leaf[3][leaf]) & self.leaf_rest[leaf])
            keep = (d <= distance) & (self.leaf[1][leaf] > q)  # each pair once
            q, leaf = q[keep], leaf[keep]
            for b in range(0, len(q), FRONTIER // LEAF):
                part = q[b:b + FRONTIER // LEAF]
                position, other = _children(leaf[b:b + FRONTIER // LEAF], self.leaf[0], self.leaf[1])
                mine = part[position]
                near = (other > mine) & (np.bitwise_count(self.codes[mine] ^ self.codes[other]) <= distance)
                if near.any():
                    yield mine[near], other[near]


def forest(codes: np.ndarray, bucket: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """For each code that links to another of its bucket: itself and the first member of its group there."""
    order = np.lexsort((gray_rank(codes), bucket))
    codes, bucket = codes[order], bucket[order]
    root = np.arange(len(codes))
    for i, j in GrayIndex(codes, bucket).links(distance):
        while len(i):  # hook the larger root under the smaller, then shorten the paths, until all agree
            a, b = root[i], root[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            i, j, low, high = i[apart], j[apart], low[apart], high[apart]
            np.minimum.at(root, high, low)
            while True:
                shorter = root[root]
                if np.array_equal(shorter, root):
                    break
                root = shorter
    linked = np.flatnonzero(root != np.arange(len(root)))
    return codes[linked], codes[root[linked]]


# --- dealing out ----------------------------------------------------------------------------------------


def _block_masks(unused: int, blocks: int) -> list[int]:
    """Deal the bits of ``unused`` out to masks of consecutive bits of nearly equal number."""
    bits = [b for b in range(BITS) if unused >> b & 1]
    cuts = [len(bits) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[cuts[k]:cuts[k + 1]]) for k in range(blocks)]


def _paths(level: int, distance: int) -> list[tuple[int, int]]:
    """(path number, mask of the bits fixed so far) of every way through ``level`` levels of blocks."""
    paths = [(0, 0)]
    for _ in range(level):
        paths = [(p * (distance + 1) + k, fixed | mask) for p, fixed in paths
                 for k, mask in enumerate(_block_masks((1 << BITS) - 1 & ~fixed, distance + 1))]
    return paths


def _deal(rows: DataFrame, level: int, distance: int) -> DataFrame:
    """Put every fingerprint in the buckets of ``level``; ``path`` is the bucket's way through the levels above."""
    step, below = distance + 1, {}
    for path, fixed in _paths(level, distance):
        below.setdefault(path // step, []).append(
            F.struct(F.lit(path).cast("int").alias("path"),
                     F.col("fp").bitwiseAND(F.lit(_signed(fixed))).alias("bits")))
    choice = F.array(*below[0]) if level == 1 else F.coalesce(*[
        F.when(F.col("path") == parent, F.array(*children)) for parent, children in below.items()])
    return rows.select("fp", F.explode(choice).alias("b")).select("fp", "b.path", "b.bits")


def _bucket_forest(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Links of the buckets of a task, a few whole buckets at a time; rows come sorted by bucket."""

    def linked(held: pd.DataFrame) -> pd.DataFrame:
        codes = held["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        number = held.groupby(["path", "bits"], sort=False).ngroup().to_numpy()
        u, v = forest(codes, number, distance)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    held = None
    for part in batches:
        held = part if held is None else pd.concat([held, part], ignore_index=True)
        if len(held) >= 8 * BUCKET:
            same = (held["path"] == held["path"].iloc[-1]) & (held["bits"] == held["bits"].iloc[-1])
            if not same.all():
                yield linked(held[~same])
                held = held[same].reset_index(drop=True)
    if held is not None and len(held):
        yield linked(held)


def links(codes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, levels: int = LEVELS) -> DataFrame:
    """Rows (u, v) over distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``."""
    rows, found = codes, None
    for level in range(1, levels + 1):
        dealt = _deal(rows, level, distance)
        if level < levels:
            dealt = written(dealt, "simhash-buckets")
            large = dealt.groupBy("path", "bits").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
            large = written(large.select("path", "bits"), "simhash-large")
            more = not large.isEmpty()
            small = dealt.join(large, ["path", "bits"], "left_anti") if more else dealt
        else:  # nearly all bits are fixed, so these buckets are bounded by the few free ones
            small, more = dealt, False
        # All buckets of a task are handled together, so a bucket is not a call of its own.
        here = (small.repartition("path", "bits").sortWithinPartitions("path", "bits")
                .mapInPandas(lambda it: _bucket_forest(it, distance), "u long, v long"))
        found = here if found is None else found.unionByName(here)
        if not more:
            return found
        rows = written(dealt.join(large, ["path", "bits"], "left_semi").select("fp", "path"), "simhash-again")
    return found


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    return written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                               fingerprint_column(F.col("text"), shingle).alias("fp")), "simhash-prints")


def _components(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint: the smallest fingerprint that it reaches."""
    codes = written(prints.select("fp").distinct(), "simhash-codes")
    stars = smallest_reachable(links(codes, distance), "simhash-components")
    return codes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (smallest reachable id) of every row of ``docs``."""
    prints = _prints(docs, shingle)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))  # a group of copies is one row from here on
    placed = first.join(_components(prints, distance), "fp")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of every component, with all its columns: the first by id (nulls last), then by text.

    The choice is made on narrow rows. Rows alike in id and text count as one document.
    """
    prints = _prints(docs, shingle)
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_hash").alias("t"))
    best = prints.groupBy("fp").agg(F.min(key).alias("k")).join(_components(prints, distance), "fp")
    kept = best.groupBy("root").agg(F.min("k").alias("k")).select(F.struct("k.i", "k.t").alias("_kept"))
    # Both the join and the choice among rows alike go by one column, so whole texts move once.
    keyed = docs.select(F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("t")).alias("_kept"), F.struct("*").alias("_row"))
    first = Window.partitionBy("_kept").orderBy(F.lit(0))
    return (keyed.join(kept, "_kept", "left_semi").withColumn("_place", F.row_number().over(first))
            .where(F.col("_place") == 1).select("_row.*"))
