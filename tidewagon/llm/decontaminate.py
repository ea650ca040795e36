"""Benchmark decontamination (3): a BM25 inverted index of test items, searched with block-max WAND.

The items are the documents of the index; every passage of every training text is a query. Scores are shares:
the BM25 score of a passage over the item's score for its own text, so one threshold holds for all items. All
items above it are retrieved and verified: five-word shingles of the item are looked up in the text around the passage;
those that end in the question and those that end in the answer (the last sentence, or last quarter) must overlap
enough, and all together by 0.8.

A passage first meets upper bounds only: for every block of the items, the greatest impact of each of its terms
there, added up for all passages of a text at once. Passages that have a block above the threshold go through
the pivoting loop of WAND over the posting lists, which skips by the same block maxima.

The index is built of blocks of a bounded number of items, one after the other for larger benchmarks, so what every task
holds is bounded; document frequencies and the average length are those of the whole benchmark.

Cases: null and empty texts and items without a word match nothing. Items of fewer than five words count as one
shingle. Equal items each give a row; equal documents too.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import kept_in_worker, objects, strings

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE = 5
SIMILARITY = 0.8
PART = 0.5  # least overlap of the question and of the answer alone
INDEX_ITEMS = 20_000  # items of one index
BLOCK = 2  # items of a block of the index
PASSAGE = 128  # least words of a passage; passages overlap by half
CELLS = 1 << 21  # bounds (half passage, block) in memory at a time
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+\s*(?=\S)")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer_start(text: str) -> int:
    """Number of words before the answer."""
    total, ends = len(words(text)), [m.end() for m in _SENTENCE.finditer(text)]
    for end in reversed(ends):
        before = len(words(text[:end]))
        if 0 < before < total:
            return before
    return total - max(1, total // 4)


def shingles(terms: list[str]) -> list[tuple[str, ...]]:
    return [tuple(terms[i:i + SHINGLE]) for i in range(max(1, len(terms) - SHINGLE + 1))]


class Index:
    """Posting lists with block maxima over normalised impacts."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], count: int, average: float):
        # Items of like length next to each other make tighter blocks.
        self.items = sorted(((i, t, words(t)) for i, t in items), key=lambda x: (len(x[2]), x[1], x[0]))
        self.vocabulary: dict[str, int] = {}
        posts: list[list[tuple[int, float]]] = []
        for place, (_, _, terms) in enumerate(self.items):
            impact = {}
            for term in set(terms):
                tf, df = terms.count(term), frequency[term]
                idf = math.log(1 + (count - df + 0.5) / (df + 0.5))
                impact[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(terms) / average))
            own = sum(impact.values())
            for term, value in sorted(impact.items()):
                number = self.vocabulary.setdefault(term, len(posts))
                if number == len(posts):
                    posts.append([])
                posts[number].append((place, value / own))
        self.posts = [([p for p, _ in x], [v for _, v in x]) for x in posts]
        self.blocks = -(-len(self.items) // BLOCK)
        self.block_max = []
        for x in posts:
            best: dict[int, float] = {}
            for place, value in x:
                best[place // BLOCK] = max(best.get(place // BLOCK, 0.0), value)
            self.block_max.append(best)
        self.term_max = [max(b.values()) for b in self.block_max]
        sizes = np.array([len(b) for b in self.block_max] + [0], dtype=np.int64)
        self.size, self.first = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.flat_block = np.array([k for b in self.block_max for k in b], dtype=np.int64)
        self.flat_max = np.array([v for b in self.block_max for v in b.values()], dtype=np.float64)
        self.half = max(PASSAGE // 2, max((len(t) for _, _, t in self.items), default=0))
        self.get = self.vocabulary.get

    def numbers(self, terms: list[str]) -> np.ndarray:
        """Term numbers; words that no item has get the number after the last."""
        unknown = len(self.posts)
        get = self.get
        return np.fromiter((get(t, unknown) for t in terms), dtype=np.int64, count=len(terms))

    def candidates(self, numbers: np.ndarray, threshold: float, cells: int = CELLS) -> np.ndarray:
        """Passages of a text (by the number of their first half) that have a block above the threshold.

        A long text goes in stretches of about ``cells`` bounds; each takes the first half of the next one along.
        """
        halves = -(-len(numbers) // self.half)
        step = max(1, cells // max(1, self.blocks))
        found = []
        for first in range(0, halves, step):
            stretch = numbers[first * self.half:(first + step + 1) * self.half]
            last = min(first + step + 1, halves) == halves
            here = self._above(stretch, threshold)
            found.append(first + (here if last else here[here < step]))
            if last:
                break
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _above(self, numbers: np.ndarray, threshold: float) -> np.ndarray:
        at = np.flatnonzero(numbers < len(self.posts))
        if not len(at):
            return at
        # A term counts once in each half.
        pair = np.unique(at // self.half * len(self.posts) + numbers[at])
        half, known = np.divmod(pair, len(self.posts))
        size = self.size[known]
        post = np.repeat(self.first[known] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        count = -(-len(numbers) // self.half)
        bound = np.bincount(np.repeat(half, size) * self.blocks + self.flat_block[post], weights=self.flat_max[post],
                            minlength=count * self.blocks).reshape(count, self.blocks)
        both = bound[:-1] + bound[1:] if count > 1 else bound
        return np.flatnonzero((both >= threshold - 1e-9).any(axis=1))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the set of terms reaches the threshold."""
        threshold -= 1e-9
        cursors = [[self.posts[t][0][0], 0, t] for t in np.unique(terms).tolist() if t < len(self.posts)]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.term_max[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_max[t].get(block, 0.0) for _, _, t in cursors[:pivot + 1]) < threshold:
                # No item up to the end of the block, or before the next list begins, can reach it.
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
                moved = cursors[:pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.posts[t][1][p] for d, p, t in cursors[:pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                goal, moved = item + 1, cursors[:pivot + 1]
            else:
                goal, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for cursor in moved:
                places, p = self.posts[cursor[2]][0], cursor[1]
                while p < len(places) and places[p] < goal:
                    p += 1
                cursor[0], cursor[1] = (places[p], p) if p < len(places) else (-1, p)
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, place: int, terms: list[str]) -> tuple[float, float, float]:
        """Overlap of all shingles of an item, of the question's and of the answer's, with a passage."""
        _, text, item = self.items[place]
        if len(item) < SHINGLE:
            inside = any(terms[i:i + len(item)] == item for i in range(len(terms) - len(item) + 1))
            return (float(inside),) * 3
        there, start = set(shingles(terms)), answer_start(text)
        hits = [s in there for s in shingles(item)]
        question = [h for i, h in enumerate(hits) if i + SHINGLE <= start]
        answer = [h for i, h in enumerate(hits) if i + SHINGLE > start]
        share = lambda x: sum(x) / len(x) if x else 1.0
        return share(hits), share(question), share(answer)

    def hits(self, text: str | None, threshold: float = THRESHOLD) -> list[dict]:
        """Verified items of a text, the best passage of each."""
        terms = words(text)
        if not terms or not self.items:
            return []
        numbers, best = self.numbers(terms), {}
        for half in self.candidates(numbers, threshold).tolist():
            a, b = half * self.half, (half + 2) * self.half
            for place, score in self.search(numbers[a:b], threshold):
                overlap, question, answer = self.verify(place, terms[a:b])
                if overlap >= SIMILARITY and question >= PART and answer >= PART:
                    hit = {"item_id": self.items[place][0], "score": min(1.0, round(score, 6)), "overlap": overlap,
                           "question": question, "answer": answer, "first_word": a}
                    if place not in best or (overlap, score) > best[place][0]:
                        best[place] = ((overlap, score), hit)
        return [best[p][1] for p in sorted(best)]


_HIT = "item_id long, score double, overlap double, question double, answer double, first_word int"
_ARRAY = "array<struct<" + _HIT.replace(" ", ":").replace(",:", ",") + ">>"


def _index_of(packed: bytes) -> Index:
    key = hashlib.sha256(packed).digest()
    return kept_in_worker(("items", key), lambda: Index(*pickle.loads(packed)))


def indexes(benchmark: DataFrame, size: int = INDEX_ITEMS) -> Iterator[bytes]:
    """The parts of the index one after the other, each of about ``size`` items at most."""
    split = F.udf(words, "array<string>")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", split("text").alias("terms")).where(
        F.size("terms") > 0)
    total = items.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("length")).first()
    frequency = items.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    parts = -(-total["n"] // size)
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = mine.select("item_id", "text").collect()
        needed = mine.select(F.explode(F.array_distinct("terms")).alias("term")).distinct()
        known = {r["term"]: r["df"] for r in needed.join(frequency, "term").collect()}
        yield pickle.dumps(([(r["item_id"], r["text"]) for r in rows], known, total["n"], total["length"]))


def leaks(packed: bytes, docs: DataFrame, text: Column) -> Column:
    """Array of the verified items of one index in a text."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf(_ARRAY)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index_of(shared.value)
        for texts in batches:
            yield objects(index.hits(t) for t in strings(texts))

    return found(text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item."""
    found = None
    for packed in indexes(benchmark):
        here = docs.select("doc_id", F.explode(leaks(packed, docs, F.col("text"))).alias("h")).select("doc_id", "h.*")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_HIT}")
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for packed in indexes(benchmark):
        docs = docs.where(F.size(leaks(packed, docs, F.col("text"))) == 0)
    return docs
