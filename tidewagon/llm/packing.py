"""Packing into training sequences (2): bounded-space online best-fit.

Every task packs its own documents as they come. It holds a fixed number of open bins, kept in a bitset keyed by
free space: the bin for a piece is the lowest set bit at or above the piece's length. If nothing fits
and all bins are in use, the fullest one closes. What a task leaves open is put together with what some
neighbouring tasks leave open by the same best-fit, on one row per bin, so the ends of tasks cost little.

Token ids come from a public tokenizer file. Its pre-tokenizer never joins text over white space, so texts
are cut there and the ids of each piece are remembered per worker; a piece of plain letters and
punctuation goes to the tokenizer's model directly, anything else through the whole tokenizer.

Cases: null and empty texts are the end id alone. A document longer than a sequence is cut, shorter ones never.
Repeated rows are packed as often as they occur. Ids may be null or repeated; a piece is one row in any case.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewagon.llm.common import kept_in_worker, objects, strings, written

CAPACITY = 4096
OPEN_BINS = 256
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
TASKS_MERGED = 16  # so many tasks' open bins are put together: at most TASKS_MERGED * OPEN_BINS rows
KNOWN_WORDS = 400_000

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _ByteNames(dict):
    """Code point to the names of its bytes in a byte-level vocabulary."""

    def __init__(self):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = name = self.level.pre_tokenize_str(chr(code))[0][0]
        return name


class Ids(dict):
    """White-space delimited piece of text to its ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.names = _ByteNames()
        self.words: dict[str, bytes] = {}

    def _of_model(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            tokens = self.model.tokenize(word if word.isascii() else word.translate(self.names))
            self.words[word] = ids = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return ids

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain:
            ids = self._of_model(plain[1].lower())
            if plain[2]:
                ids += self._of_model(plain[2])
        elif piece:
            ids = np.array(self.whole.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            ids = b""
        self[piece] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if len(self) + len(self.words) > KNOWN_WORDS:
            self.clear()
            self.words.clear()
        pieces = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, pieces))


def ids_of(path: str) -> Ids:
    """The memory of this Python worker for a tokenizer file; it serves all tasks that the worker runs."""
    return kept_in_worker(("packing", path), lambda: Ids(path))


class BestFit:
    """A fixed number of open bins, in a bitset keyed by free space."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.by_free = 0, [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of the given length (at most the capacity)."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free

    def still_open(self) -> set[int]:
        return {n for stack in self.by_free for n in stack}


_PIECE = ("doc_id string, piece int, start long, length long, ids_crc32 long, bin long, offset long, "
          "task int, is_open boolean")


def _pack_task(batches: Iterator[pd.DataFrame], path: str, capacity: int, open_bins: int) -> Iterator[pd.DataFrame]:
    memory, bins = ids_of(path), BestFit(capacity, open_bins)
    task = TaskContext.get().partitionId()
    end, width = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity
    ends: list[pd.DataFrame] = []
    for part in batches:
        rows = []
        for doc, text in zip(strings(part["doc_id"]), strings(part["text"])):
            ids = memory.of(text) + end
            for piece, at in enumerate(range(0, len(ids), width)):
                data = ids[at:at + width]
                number, offset = bins.put(len(data) // 4)
                rows.append((doc, piece, at // 4, len(data) // 4, zlib.crc32(data), (task << 32) + number, offset))
        frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"])
        frame["doc_id"] = objects(frame["doc_id"])
        ends.append(frame.assign(task=task))
    # A piece's bin may close or stay open until the end of the task; the rows are narrow and one split's worth.
    left = np.array(sorted((task << 32) + n for n in bins.still_open()), dtype=np.int64)
    for frame in ends:
        yield frame.assign(is_open=np.isin(frame["bin"].to_numpy(dtype=np.int64), left))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    path = path or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select(F.col("doc_id").cast("string"), "text")  # as text, ids keep nulls and all digits
    packed = written(narrow.mapInPandas(lambda it: _pack_task(it, path, capacity, open_bins),
                                        _PIECE), "packed-by-task")
    opened = packed.where("is_open").groupBy("bin", "task").agg(F.sum("length").alias("filled"))

    def together(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        fit = BestFit(capacity, len(bins))
        first: dict[int, int] = {}
        rows = []
        for number, filled in zip(bins["bin"].tolist(), bins["filled"].tolist()):
            target, offset = fit.put(filled)
            rows.append((number, first.setdefault(target, number), offset))
        return pd.DataFrame(rows, columns=["bin", "merged", "shift"])

    merged = (opened.withColumn("near", F.expr(f"task div {TASKS_MERGED}")).groupBy("near")
              .applyInPandas(together, "bin long, merged long, shift long"))
    return packed.join(merged, "bin", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", F.coalesce("merged", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
