"""Document fingerprints (10): I-Match.

Document frequencies are counted over all documents. Terms whose inverse document frequency lies in a chosen band
form the lexicon; a document's distinct lexicon terms, sorted, are hashed once for each of several random subsets of
the lexicon. A single changed term breaks the hash of a large subset but leaves that of a small one, so the subsets
differ in size: the share of subsets that agree tells how near two documents are.

Band and bound: a term is in the lexicon when it occurs in at least ``MIN_SHARE`` and at most ``MAX_SHARE`` of
the documents. With w distinct terms per document on average there are at most w / MIN_SHARE such terms, however
many documents there are; that bounds what goes to every task.

A subset in which a document has no lexicon term holds the hash of those of its other distinct terms that the same draw
takes, so a document with few or no lexicon terms is known by its own terms, without a limit at which the kind of its fingerprint
changes. One more place holds the hash of all distinct terms, or of the whole text if it has no term, so different
texts differ even where no subset takes their terms.

Order: rows are put into ranges of (id descending, hash of the text), so equal and null ids are divided as well, and each row meets the
one after it in its range. The last row of a range and the first one of the next are joined afterwards by the number of the range.

Cases: null and empty texts have the fingerprint of no term. Equal texts have equal fingerprints and likeness 1. ``next`` runs through descending ids
(nulls last), ties by a hash of the text, and from the last to the first; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewagon.llm.common import kept_in_worker, objects, strings, written

MIN_SHARE, MAX_SHARE = 0.002, 0.2
# Each subset takes this share of the lexicon; every share is used for ``DRAWS`` subsets.
SHARES = (1 / 4, 1 / 8, 1 / 16, 1 / 32, 1 / 64, 1 / 128, 1 / 256, 1 / 512)
DRAWS = 8
SUBSETS = len(SHARES) * DRAWS
CHARS_PER_TASK = 16_000_000
BUCKETS = 1 << 20  # of terms, for the first pass of the counts; a power of two
WIDE = 4096  # hashes that are drawn for all subsets at once
TOGETHER = 16  # documents whose fingerprints are taken together
CHARS_TOGETHER = 1_000_000  # fewer documents, if they have so many characters
HELD_TERMS = 400_000
_TERM = re.compile(r"[^\W_]+")
_SPACED = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))  # what stands for each of the ASCII characters


def terms(text: str | None) -> list[str]:
    return _terms((text or "").lower())


def _terms(low: str) -> list[str]:
    """All matches of ``_TERM``; most texts need no search for them."""
    if low.isascii():
        return low.translate(_SPACED).split()
    return [t for word in low.split() for t in ((word,) if word.isalnum() else _TERM.findall(word))]


def _counted(docs: DataFrame, keep, schema: str) -> DataFrame:
    """Document frequencies of the parts of a task, as ``keep`` (counts, documents of the part) hands them on. A part ends
    when it holds ``HELD_TERMS`` terms."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        rows = 0
        for part in batches:
            for text in strings(part["text"]):
                held.update(set(terms(text)))
                rows += 1
                if len(held) > HELD_TERMS:
                    yield keep(held, rows)
                    held, rows = Counter(), 0
        if rows:
            yield keep(held, rows)

    return docs.select("text").mapInPandas(count, schema)


def _buckets(words: list[str]) -> np.ndarray:
    return (_hashes(words) % np.uint64(BUCKETS)).astype(np.int64)


def frequent_buckets(docs: DataFrame, low: float) -> np.ndarray:
    """Hash buckets of all terms that may be in a share ``low`` of the documents.

    Such a term is in that share of the documents of at least one part of one task. At most ``BUCKETS`` numbers reach the driver.
    """

    def frequent(held: Counter, rows: int) -> pd.DataFrame:
        return pd.DataFrame({"bucket": np.unique(_buckets([t for t, n in held.items() if n >= low * rows * (1 - 1e-9)]))})

    found = _counted(docs, frequent, "bucket long").distinct().toPandas()["bucket"].to_numpy()
    out = np.zeros(BUCKETS, dtype=bool)
    out[found] = True
    return out


def document_frequencies(docs: DataFrame, buckets: np.ndarray) -> DataFrame:
    """(term, df) over all documents of the terms in the given buckets; tasks add up their own counts first."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(buckets).tobytes())

    def wanted(held: Counter, rows: int) -> pd.DataFrame:
        usable = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).astype(bool)
        words = list(held)
        some = [w for w, use in zip(words, usable[_buckets(words)].tolist()) if use]
        return pd.DataFrame({"term": objects(some), "df": [held[w] for w in some]})

    return _counted(docs, wanted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, documents: int, low: float = MIN_SHARE, high: float = MAX_SHARE) -> list[str]:
    """The terms of the band, in order; at most (distinct terms per document) / ``low`` of them.

    A first pass finds which terms can be in the band at all, so the many rare terms are not shuffled; the second
    one counts those.
    """
    least = max(2, low * documents)
    counts = document_frequencies(docs, frequent_buckets(docs, low))
    rows = counts.where((F.col("df") >= least) & (F.col("df") <= max(2, high * documents)))
    return sorted(r["term"] for r in rows.select("term").collect())


# Odd factors: the upper bits of hash times factor draw the subsets that a term is in.
_FACTORS = np.random.default_rng(3).integers(0, 2 ** 63, size=SUBSETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BELOW = np.array([int(SHARES[k // DRAWS] * 2 ** 64) for k in range(SUBSETS)], dtype=np.uint64)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _hashes(words) -> np.ndarray:
    try:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)  # of the UTF-8 of a string
    except UnicodeEncodeError:  # half of a surrogate pair
        return np.fromiter(map(_hash, words), dtype=np.uint64)


def drawn(hashes: np.ndarray, subsets: np.ndarray) -> np.ndarray:
    """Whether each term is in each of the subsets."""
    return hashes[:, None] * _FACTORS[subsets] < _BELOW[subsets]


def _number(digest: int) -> int:
    return digest % 65535 + 1  # 0 stands for a subset without terms


def _digests(out: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> None:
    """Put one number at every place that hashes go to, of these hashes in their order."""
    data = hashes.take(np.argsort(places, kind="stable")).tobytes()
    sizes = np.bincount(places, minlength=out.size)
    filled = np.flatnonzero(sizes)
    ends = (np.cumsum(sizes.take(filled)) * 8).tolist()
    digest = xxhash.xxh32_intdigest
    out.reshape(-1)[filled] = [digest(data[a:b]) % 65535 + 1 for a, b in zip([0, *ends], ends)]


class Lexicon(dict):
    """Term to its place."""

    def __init__(self, ordered: list[str]):
        super().__init__((t, i) for i, t in enumerate(ordered))
        self.hashes = _hashes(ordered)
        self.drawn = np.concatenate([np.zeros((0, SUBSETS), dtype=bool)] + [
            drawn(self.hashes[a:a + WIDE], np.arange(SUBSETS)) for a in range(0, len(ordered), WIDE)])

    def of(self, text: str) -> np.ndarray:
        return self.fingerprint(terms(text), text)

    def fingerprint(self, words: list[str], text: str = "") -> np.ndarray:
        """A number per subset, and one for the whole."""
        return self.fingerprints([(words, text)])[0]

    def fingerprints(self, documents: list[tuple[list[str], str]]) -> np.ndarray:
        """A row for every (terms, text)."""
        distinct = [set(words) for words, _ in documents]
        sizes = list(map(len, distinct))
        out = np.zeros((len(documents), SUBSETS), dtype=np.uint16)
        places = np.fromiter(map(self.get, chain.from_iterable(distinct), repeat(-1)), dtype=np.int64, count=sum(sizes))
        owner, outside = np.repeat(np.arange(len(documents)), sizes), places < 0
        inside = ~outside
        owners, known = np.divmod(np.sort(owner[inside] * len(self) + places[inside]), max(1, len(self)))
        self._put(out, owners, self.hashes.take(known), lambda a, b: self.drawn.take(known[a:b], axis=0))
        # The subsets that are left without a term take from the other terms.
        hashes, owners = _hashes(list(compress(chain.from_iterable(distinct), outside.tolist()))), owner[outside]
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes.take(order), owners.take(order)
        once = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))[:len(hashes)]
        hashes, owners, left = hashes[once], owners[once], out == 0
        self._put(out, owners, hashes, lambda a, b: drawn(hashes[a:b], np.arange(SUBSETS)) & left.take(owners[a:b], axis=0))
        whole = ["\n".join(sorted(words)) or text for words, (_, text) in zip(distinct, documents)]
        last = [_number(xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))) if w else 0 for w in whole]
        return np.column_stack([out, np.array(last, dtype=np.uint16)])

    @staticmethod
    def _put(out: np.ndarray, owners: np.ndarray, hashes: np.ndarray, chosen) -> None:
        """Numbers of the hashes that ``chosen`` takes of those from a to b, for the subsets of their owners."""
        rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a in range(0, len(hashes), WIDE):
            row, subset = np.divmod(np.flatnonzero(chosen(a, a + WIDE)), SUBSETS)
            rows.append(row + a)
            places.append(owners.take(rows[-1]) * SUBSETS + subset)
        places = np.concatenate(places)
        narrow = places.astype(np.uint16) if out.size <= 1 << 16 else places  # sorted several times faster
        _digests(out, hashes.take(np.concatenate(rows)), narrow)


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the subsets with terms in either document on which both agree; 1 for equal fingerprints."""
    used = np.count_nonzero(a | b)
    return np.count_nonzero(a[a == b]) / used if used else 1.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as many code points of the following document, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class Document:
    """A text with the terms of both its halves, so the terms of the edited text need not be cut again."""

    def __init__(self, text: str):
        self.text, self.cut = text, len(text) - len(text) // 2
        low = text.lower()
        # Lower case of a character depends on its neighbours only for the capital sigma.
        self.low = low if len(low) == len(text) and "\u03a3" not in text else None
        if self.low is None:
            self.head, self.words = None, terms(text)
        else:
            self.head = _terms(low[:self.cut])
            self.words = _glued(self.head, low[:self.cut], low[self.cut:])

    def edited_words(self, following: "Document") -> list[str]:
        if self.low is None or following.low is None:
            return terms(edited(self.text, following.text))
        return _glued(self.head, self.low[:self.cut], following.low[:len(self.text) - self.cut])


def _glued(head: list[str], left: str, right: str) -> list[str]:
    """Terms of ``left + right``, given those of ``left``."""
    tail = _terms(right)
    if left and right and left[-1].isalnum() and right[0].isalnum():
        return head[:-1] + [head[-1] + tail[0]] + tail[1:]
    return head + tail


_RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _lexicon_of(packed: bytes) -> Lexicon:
    key = hashlib.sha256(packed).digest()
    return kept_in_worker(("lexicon", key), lambda: Lexicon(
        packed.decode("utf-8", "surrogatepass").split("\n") if packed else []))


def _compared(lexicon_here: Lexicon, rows: list[tuple]) -> list[tuple]:
    """The result rows of all but the last of (id, Document, fingerprint), each followed by the next one."""
    pairs = list(zip(rows, rows[1:]))
    changed = [edited(a.text, b.text) for (_, a, _), (_, b, _) in pairs]
    theirs = lexicon_here.fingerprints([(a.edited_words(b), text) for ((_, a, _), (_, b, _)), text in zip(pairs, changed)])
    return [(doc, len(a.text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine), as_text(their),
             likeness(mine, their), likeness(mine, following))
            for ((doc, a, mine), (_, _, following)), text, their in zip(pairs, changed, theirs)]


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From and to of texts that are taken together; a run ends with the text that brings it to ``CHARS_TOGETHER``, so few long
    ones are held at once."""
    a = chars = 0
    for b, text in enumerate(texts, 1):
        chars += len(text)
        if b - a == TOGETHER or chars >= CHARS_TOGETHER or b == len(texts):
            yield a, b
            a, chars = b, 0


def _read(lexicon_here: Lexicon, ids: list, texts: list[str]) -> list[tuple]:
    """(id, Document, fingerprint) of every text."""
    documents = [Document(text) for text in texts]
    return list(zip(ids, documents, lexicon_here.fingerprints([(d.words, d.text) for d in documents])))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the fingerprints of each document, of its edited text, and their likeness."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not size["n"]:
        return spark.createDataFrame([], f"doc_id {kind}, {_RESULT}")
    ranges = max(1, -(-(size["chars"] or 0) // CHARS_PER_TASK))
    packed = "\n".join(lexicon(docs, size["n"])).encode("utf-8", "surrogatepass")
    words = spark.sparkContext.broadcast(packed)

    def in_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order; each waits for the one after it. The first and the last row of the range also go out with
        their texts, for the ranges beside it."""
        lexicon_here, number = _lexicon_of(words.value), TaskContext.get().partitionId()
        before = None
        for part in batches:
            out = []
            ids, texts = strings(part["id"]), strings(part["text"])
            for a, b in _runs(texts):
                rows = _read(lexicon_here, ids[a:b], texts[a:b])
                if before is None:
                    out.append((None, *[None] * len(_NAMES), "first", number, texts[a]))
                else:
                    rows = [before, *rows]
                out += [(*row, None, None, None) for row in _compared(lexicon_here, rows)]
                before = rows[-1]
            yield _frame(out)
        if before is not None:
            yield _frame([(before[0], *[None] * len(_NAMES), "last", number, before[1].text)])

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon_here = _lexicon_of(words.value)
        for part in batches:
            out = []
            for doc, text, following in zip(strings(part["id"]), strings(part["text"]), strings(part["following"])):
                out += _compared(lexicon_here, _read(lexicon_here, [doc, None], [text, following]))
            yield pd.DataFrame({name: objects(row[i] for row in out) for i, name in enumerate(["id", *_NAMES])})

    # Ids travel as text, which keeps nulls and all digits. Rows alike in id and text are told apart by their place.
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("place")]
    dealt = (rows.withColumn("text_hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
             .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "text"))
    found = written(dealt.mapInPandas(in_range, f"id string, {_RESULT}, edge string, number int, text string"), "imatch-ranges")
    # A number per range; the last row of each is followed by the first one of the next range that has rows.
    numbers = sorted(r["number"] for r in found.where("edge = 'last'").select("number").collect())
    following = spark.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "number int, next_number int")
    first = found.where("edge = 'first'").select(F.col("number").alias("next_number"), F.col("text").alias("following"))
    edges = (found.where("edge = 'last'").select("id", "text", "number").join(following, "number").join(first, "next_number")
             .select("id", "text", "following").mapInPandas(across, f"id string, {_RESULT}"))
    inner = found.where("edge is null").select("id", *_NAMES)
    return inner.unionByName(edges).select(F.col("id").cast(kind).alias("doc_id"), *_NAMES)


def _frame(out: list[tuple]) -> pd.DataFrame:
    names = ["id", *_NAMES, "edge", "number", "text"]
    return pd.DataFrame({name: objects(row[i] for row in out) for i, name in enumerate(names)})
