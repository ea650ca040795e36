"""Language ID (1): string kernels with Nystroem landmarks and ridge regression.

The kernel of two strings is the cosine of their blended-spectrum presence vectors: which character n-grams
of length 1 to 4 occur at all, hashed to a fixed number of places. A few landmark strings span the feature
space (Nystroem): ``phi(x) = k(x, landmarks) @ inverse root of k(landmarks, landmarks)``, and one
kernel ridge regression per language is fitted on ``phi``. A text is cut into windows that cover all of it;
a batch of windows is scored by two matrix products, and the mean over the windows, weighted by
their size, gives the language.

The normal equations are sums over the training rows, so tasks add them up and only matrices of the
size of the landmarks come together.

Cases: ``und`` with score 0 for null texts and texts without a letter, or if nothing could be learned.
Equal scores go to the alphabetically first language. Repeated rows score alike; the sample has one text of an id and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import bounded_sample, held_out, objects, one_text, remainder, strings, within_budget, written

UNDETERMINED = "und"
# Bounds of the training sample; scoring has none.
TRAIN_PER_LANGUAGE = 800
TRAIN_CHARS = 256_000_000  # of all texts of the sample together; each is taken whole
LANDMARKS_PER_LANGUAGE = 16
WINDOW = 1000
ORDERS = (1, 2, 3, 4)
PLACES = 1 << 15
RIDGE = 1e-2
ROWS = 64  # windows per matrix product
MODULUS, REST = 4, 2
BROADCAST_ROWS = 200_000  # of ids


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(part: str, matrix: np.ndarray, first_row: int, count: int) -> None:
    """Set the n-grams of ``count`` windows of ``part`` in the rows from ``first_row``.

    An n-gram belongs to the window in which it begins; what follows the last window only completes the
    n-grams that begin in it.
    """
    codes = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    window = np.minimum(np.arange(len(codes)) // WINDOW, count - 1)
    flat, base = matrix.reshape(-1), (window + first_row) * PLACES
    value = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        value = (value[:len(codes) - n + 1] + codes[n - 1:]) * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
        if n in ORDERS:
            flat[base[:len(value)] + ((value * np.uint32(0x85EBCA6B)) >> np.uint32(17))] = 1.0


def windows_in(length: int) -> int:
    """Windows of a text; a short rest joins the window before it."""
    return max(1, (length + WINDOW // 2) // WINDOW)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed bits, landmark x places
    weights: np.ndarray  # landmark x language


def _cosines(batch: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values; ``landmarks`` is places x landmark with columns of length one."""
    norm = np.sqrt(np.maximum(batch.sum(axis=1, keepdims=True), 1))
    return (batch @ landmarks) / norm


def _unit(bits: np.ndarray) -> np.ndarray:
    dense = np.unpackbits(bits, axis=1).astype(np.float32)
    return np.ascontiguousarray((dense / np.sqrt(np.maximum(dense.sum(axis=1, keepdims=True), 1))).T)


def window_kernels(texts: list[str], landmarks: np.ndarray):
    """Yield (text index, window sizes, kernel rows) for all windows of all texts, in batches of bounded size."""
    batch = np.zeros((ROWS, PLACES), dtype=np.float32)
    held: list[tuple[int, np.ndarray]] = []
    used = 0

    def flush():
        nonlocal used, held
        if used:
            k, at = _cosines(batch[:used], landmarks), 0
            for index, sizes in held:
                yield index, sizes, k[at:at + len(sizes)]
                at += len(sizes)
            batch[:used] = 0
            held, used = [], 0

    for index, text in enumerate(texts):
        for a, b in _runs(windows_in(len(text))):
            last = b == windows_in(len(text))
            if used + (b - a) > ROWS:
                yield from flush()
            presence(text[a * WINDOW:] if last else text[a * WINDOW:b * WINDOW + max(ORDERS) - 1],
                     batch, used, b - a)
            sizes = np.full(b - a, WINDOW)
            if last:
                sizes[-1] = len(text) - (b - 1) * WINDOW
            held.append((index, sizes))
            used += b - a
    yield from flush()


def _runs(count: int) -> list[tuple[int, int]]:
    """Runs of windows of at most ``ROWS``."""
    return [(a, min(a + ROWS, count)) for a in range(0, count, ROWS)]


def predict(model: Model, texts) -> tuple[list[str], np.ndarray]:
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    if not known or not model.languages:
        return names, scores
    total = np.zeros((len(known), len(model.languages)))
    weight = np.zeros(len(known))
    for index, sizes, k in window_kernels([texts[i] for i in known], _unit(model.landmarks)):
        total[index] += sizes @ (k @ model.weights)
        weight[index] += sizes.sum()
    mean = total / np.maximum(weight, 1)[:, None]
    best = mean.argmax(axis=1)
    for row, i in enumerate(known):
        names[i] = model.languages[best[row]]
        scores[i] = min(1.0, max(0.0, float(mean[row, best[row]])))
    return names, scores


def landmark_bits(text: str, number: int) -> bytes:
    """Packed presence of a window of a text."""
    row = np.zeros((1, PLACES), dtype=np.float32)
    last = number + 1 >= windows_in(len(text))
    presence(text[number * WINDOW:] if last else text[number * WINDOW:(number + 1) * WINDOW], row, 0, 1)
    return np.packbits(row[0].astype(np.uint8)).tobytes()


def solve(landmarks: np.ndarray, gram: np.ndarray, cross: np.ndarray, count: float) -> np.ndarray:
    """Ridge regression on the Nystroem features, as weights of the kernel values.

    ``gram`` is the sum of k' k and ``cross`` the sum of k' y over the training windows.
    """
    unit = _unit(landmarks)
    values, vectors = np.linalg.eigh((unit.T @ unit).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    normal = root.T @ gram @ root + RIDGE * count / len(landmarks) * np.eye(keep.sum())
    return root @ np.linalg.solve(normal, root.T @ cross)


def fit(docs: DataFrame) -> Model:
    """Learn the values of ``lang`` from a bounded sample of the rows that are not held out."""
    rows = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", MODULUS) != REST))
    chosen = written(bounded_sample(rows, "lang", TRAIN_PER_LANGUAGE, "doc_id"), "language-sample")
    # The sample is bounded per language; it is broadcast only after its size is checked.
    few = chosen.count() <= BROADCAST_ROWS
    texts = written(one_text(rows.join(F.broadcast(chosen) if few else chosen, ["lang", "doc_id"]), ["lang", "doc_id"]), "language-texts")
    sample = written(within_budget(texts, ["lang", "doc_id"], TRAIN_CHARS), "language-lessons") if few else texts
    # Landmarks are drawn from all windows of the sample.
    count = F.greatest(F.lit(1), F.floor((F.length("text") + WINDOW // 2) / WINDOW).cast("int"))
    windows = sample.select("lang", F.explode(F.sequence(F.lit(0), count - 1)).alias("number"), "doc_id").select(
        "lang", F.struct("doc_id", "number").alias("window"))
    drawn = bounded_sample(windows, "lang", LANDMARKS_PER_LANGUAGE, "window").select("lang", "window.doc_id", "window.number")

    @F.pandas_udf("binary")
    def bits(whole: pd.Series, numbers: pd.Series) -> pd.Series:
        return objects(landmark_bits(t, n) for t, n in zip(strings(whole), numbers.tolist()))

    marks = sample.join(drawn, ["lang", "doc_id"]).select("lang", bits("text", "number").alias("bits"))
    collected = sorted((r["lang"], bytes(r["bits"])) for r in marks.collect())
    languages = sorted({lang for lang, _ in collected})
    if not languages:
        return Model([], np.zeros((0, PLACES // 8), np.uint8), np.zeros((0, 0)))
    landmarks = np.stack([np.frombuffer(b, dtype=np.uint8) for _, b in collected])

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, m, c = _unit(landmarks), len(landmarks), len(languages)
        gram, cross, count = np.zeros((m, m)), np.zeros((m, c)), 0
        for part in batches:
            part = part[[has_letter(t) for t in strings(part["text"])]]
            place = [languages.index(x) if x in languages else -1 for x in part["lang"]]
            for index, sizes, k in window_kernels(part["text"].tolist(), unit):
                if place[index] >= 0:
                    target = np.zeros(c)
                    target[place[index]] = 1
                    gram += k.T @ k
                    cross += k.sum(axis=0)[:, None] * target
                    count += len(k)
        yield pd.DataFrame({"gram": [gram.tobytes()], "cross": [cross.tobytes()], "windows": [count]})

    # The sample is bounded, so a fixed number of tasks sends one matrix each.
    sums = sample.repartition(8).mapInPandas(add_up, "gram binary, cross binary, windows long").collect()
    m, c = len(landmarks), len(languages)
    gram = sum(np.frombuffer(r["gram"]).reshape(m, m) for r in sums)
    cross = sum(np.frombuffer(r["cross"]).reshape(m, c) for r in sums)
    return Model(languages, landmarks, solve(landmarks, gram, cross, sum(r["windows"] for r in sums)).astype(np.float32))


def language(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def named(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(model, strings(texts))
            yield pd.DataFrame({"lang_pred": objects(names), "score": scores})

    return named(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(docs)
    return docs.select("doc_id", held_out("doc_id", MODULUS, REST).alias("held_out"),
                       language(model, F.col("text")).alias("l")).select("doc_id", "held_out", "l.*")
