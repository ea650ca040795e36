"""Toxicity (8): multiple-instance learning with noisy-or.

A document is a bag of sentences. A sentence has probability ``p = sigmoid(bias + sum of word evidence)``,
and a document is toxic when at least one sentence is: ``P = 1 - product(1 - p)``. Only documents carry
labels; the gradient of the noisy-or shares a label among the sentences in proportion to their own
probability, so training finds out which sentences made a document toxic. Evidence of a word is the sum of
non-negative, sparse weights of the word itself and of its beginnings and endings, so unseen words with a
known stem count too.

Cases: null, empty and word-free texts are one empty sentence and score the prior of a sentence. Without
labelled rows of both kinds the model is the prior alone. Ties and repeated rows score alike. In training an id with both
labels is left out, one text of a repeated id is used, and of equal texts with different labels the toxic one counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import held_out, kept_in_worker, labelled_texts, objects, strings

THRESHOLD = 0.3
SENTENCE_THRESHOLD = 0.3
# Bounds of the training sample; scoring has none.
TRAIN_PER_CLASS = 2500
TRAIN_CHARS = 16_000_000  # of all texts of the sample together; each is taken whole
BUCKETS = 1 << 20
MIN_DOCUMENTS = 4
MODULUS, REST = 4, 2
KNOWN_WORDS = 300_000  # entries of a worker's word memory before it starts anew

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]+")
_END = ".!?\n"


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself, beginnings and endings of 3 to 6 characters."""
    parts = ["=" + word]
    parts += ["^" + word[:n] for n in range(3, min(6, len(word)) + 1)]
    parts += [word[-n:] + "$" for n in range(3, min(6, len(word)) + 1)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # sorted buckets with evidence
    weights: np.ndarray


def _bag(text: str) -> list[set[str]]:
    """The distinct words of every sentence."""
    bag: list[set[str]] = [set()]
    for token in _TOKEN.findall(text.lower()):
        if token[0] in _END:
            if bag[-1]:
                bag.append(set())
        else:
            bag[-1].add(token)
    return bag if bag[-1] or len(bag) == 1 else bag[:-1]


def train(texts: list[str], labels: list[int], rounds: int = 120, rate: float = 0.15, l1: float = 0.8) -> Model:
    """Maximum likelihood of the noisy-or with a penalty ``l1`` on the evidence weights."""
    # An exact copy teaches nothing new; of equal texts with different labels the toxic one counts.
    seen: dict[str, int] = {}
    for text, label in zip(texts, labels):
        seen[text] = max(label, seen.get(text, 0))
    y = np.array(list(seen.values()), dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        prior = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(prior / (1 - prior))), np.zeros(0, np.int64), np.zeros(0))
    words: dict[str, int] = {}
    doc_of, sentence_of, word_of = [], [], []
    for number, text in enumerate(seen):
        for sentence in _bag(text):
            place = len(doc_of)
            doc_of.append(number)
            for word in sentence:
                sentence_of.append(place)
                word_of.append(words.setdefault(word, len(words)))
    doc_of, sentence_of, word_of = (np.array(x, dtype=np.int64) for x in (doc_of, sentence_of, word_of))
    parts = [word_features(w) for w in words]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = np.fromiter((b for p in parts for b in p), dtype=np.int64, count=len(owner))
    # Keep the features of enough documents.
    per_word = np.unique(np.stack([word_of, doc_of[sentence_of]], 1), axis=0)[:, 0]
    documents = np.bincount(flat, weights=np.bincount(per_word, minlength=len(words))[owner], minlength=BUCKETS)
    keep = documents[flat] >= MIN_DOCUMENTS
    owner, flat = owner[keep], flat[keep]
    buckets, feature = np.unique(flat, return_inverse=True)
    theta, bias = np.zeros(len(buckets)), -5.0
    first, second, fb, sb = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for step in range(1, rounds + 1):
        evidence = np.bincount(owner, weights=theta[feature], minlength=len(words))
        z = bias + np.bincount(sentence_of, weights=evidence[word_of], minlength=len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc_of, weights=-np.logaddexp(0, z), minlength=len(y))  # log of product(1 - p)
        toxic = -np.expm1(np.minimum(clean, -1e-12))
        share = np.where(y == 1, -(1 - toxic) / toxic, 1.0)[doc_of] * p
        grad = np.bincount(feature, weights=np.bincount(
            word_of, weights=share[sentence_of], minlength=len(words))[owner], minlength=len(buckets)) + l1
        gb = share.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        fb, sb = 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        scale = rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        theta = np.maximum(0, theta - scale * first / (np.sqrt(second) + 1e-8))
        # The prior of a sentence has far to go: it must stay small over all sentences of a long clean text.
        bias = float(np.clip(bias - 5 * scale * fb / (np.sqrt(sb) + 1e-8), -20, 5))
    kept = theta > 1e-3
    return Model(bias, buckets[kept], theta[kept])


class Scorer:
    """Scores of texts; remembers the evidence of the words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
        weight = self.weight

        class Evidence(dict):
            def __missing__(self, token: str) -> float:
                value = float("nan") if token[0] in _END else sum(
                    weight.get(b, 0.0) for b in word_features(token)) if weight else 0.0
                self[token] = value
                return value

        self.evidence = Evidence()

    def _sentences(self, tokens: list[str]) -> np.ndarray:
        """Log-odds of each sentence with words."""
        if len(self.evidence) > KNOWN_WORDS:
            self.evidence.clear()
        values = np.fromiter(map(self.evidence.__getitem__, tokens), dtype=np.float64, count=len(tokens))
        ends = np.isnan(values)
        sentence = np.cumsum(ends)
        words = ~ends
        if not words.any():
            return np.array([self.model.bias])
        size = sentence[-1] + 1
        has = np.bincount(sentence[words], minlength=size) > 0
        total = np.zeros(size)
        # A word counts once in a sentence; only words with evidence need a look.
        for at, token in sorted({(int(sentence[i]), tokens[i]) for i in np.flatnonzero(values > 0)}):
            total[at] += self.evidence[token]
        return self.model.bias + total[has]

    def score(self, text: str | None) -> float:
        z = self._sentences(_TOKEN.findall((text or "").lower()))
        return float(-np.expm1(-np.logaddexp(0, z).sum()))

    def locate(self, text: str, threshold: float = SENTENCE_THRESHOLD) -> list[dict]:
        """Offending sentences as code point spans with their own probabilities."""
        found, start, end, said = [], None, 0, set()

        def close():
            if start is not None:
                total = self.model.bias + sum(self.evidence[w] for w in sorted(said))
                p = float(1 / (1 + np.exp(-np.clip(total, -30, 30))))
                if p >= threshold:
                    found.append({"start": start, "end": end, "score": p})

        for m in _TOKEN.finditer(text):
            if m[0][0] in _END:
                close()
                start, said = None, set()
            else:
                start, end = m.start() if start is None else start, m.end()
                said.update(w for w in _TOKEN.findall(m[0].lower()) if w[0] not in _END)
        close()
        return found


def _scorer(model: Model) -> Scorer:
    """The scorer of this Python worker: its word memory serves all tasks that the worker runs."""
    key = model.buckets.tobytes() + model.weights.tobytes() + np.float64(model.bias).tobytes()
    return kept_in_worker(("toxicity", key), lambda: Scorer(model))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents that are not held out."""
    rows = labelled_texts(docs, labels, "toxic", TRAIN_PER_CLASS, MODULUS, REST, TRAIN_CHARS).toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["_label"].tolist())


_RESULT = "score double, sentences array<struct<start:int,end:int,score:double>>"


def verdict(model: Model, text: Column) -> Column:
    """Struct of the document's score and, for documents at the threshold, the offending sentences."""

    @F.pandas_udf(_RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(model)
        for texts in batches:
            whole = strings(texts)
            scores = [scorer.score(t) for t in whole]
            spans = [scorer.locate(t) if t and s >= THRESHOLD else [] for t, s in zip(whole, scores)]
            yield pd.DataFrame({"score": scores, "sentences": objects(spans)})

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences of every document."""
    model = fit(docs, labels)
    scored = docs.select("doc_id", held_out("doc_id", MODULUS, REST).alias("held_out"),
                         verdict(model, F.col("text")).alias("v"))
    return scored.select("doc_id", "held_out", "v.score",
                         (F.col("v.score") >= THRESHOLD).cast("int").alias("predicted"), "v.sentences")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = fit(docs, labels)
    return docs.where(verdict(model, F.col("text"))["score"] < THRESHOLD)
