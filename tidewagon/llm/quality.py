"""Quality classifier (6): a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it. Bytes are embedded; filters
eight bytes wide run over a chunk every four bytes; the greatest response of each filter describes the
chunk. The mean and the maximum of these descriptions over all chunks give one probability.

Cases: null and empty texts are one chunk of padding. Without labelled rows of both kinds the score is the
share of good rows, smoothed. Ties and repeated rows score alike. In training an id with both labels is left out and one
text of a repeated id is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import held_out, labelled_texts, strings

THRESHOLD = 0.5
# Bounds of the training sample; scoring has none.
TRAIN_PER_CLASS = 1500
TRAIN_CHARS = 16_000_000  # of all texts of the sample together; each is taken whole
CHUNK, STEP = 512, 448
BLOCK, EMBED, FILTERS = 4, 8, 32
SLAB = 512  # chunks per matrix product
MODULUS, REST = 3, 1


def chunks_of(text: str | None) -> np.ndarray:
    """Overlapping chunks of all bytes, the last one padded with zero bytes."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((count - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    width = BLOCK * EMBED
    shape = {"embed": ((256, EMBED), 1.0), "filters": ((2 * width, FILTERS), (2 * width) ** -0.5),
             "shift": ((FILTERS,), 0.0), "out": ((2 * FILTERS,), 0.1), "bias": ((1,), 0.0)}
    return {k: (rng.standard_normal(s) * scale).astype(np.float32) for k, (s, scale) in shape.items()}


def _blocks(net: dict, chunks: np.ndarray) -> np.ndarray:
    return net["embed"][chunks].reshape(len(chunks), CHUNK // BLOCK, BLOCK * EMBED)


def _respond(net: dict, blocks: np.ndarray) -> np.ndarray:
    """Filter responses: a filter spans two neighbouring blocks, so it is two products added with a shift."""
    width = BLOCK * EMBED
    both = blocks.reshape(-1, width) @ np.concatenate([net["filters"][:width], net["filters"][width:]], axis=1)
    both = both.reshape(len(blocks), -1, 2 * FILTERS)
    return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:] + net["shift"]


def pooled(net: dict, chunks: np.ndarray) -> np.ndarray:
    return np.maximum(_respond(net, _blocks(net, chunks)).max(axis=1), 0)


def _combine(net: dict, features: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(starts, len(features)))
    document = np.concatenate([np.add.reduceat(features, starts) / sizes[:, None],
                               np.maximum.reduceat(features, starts)], axis=1)
    z = document @ net["out"] + net["bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), document


def predict(net: dict, texts) -> np.ndarray:
    """Probabilities of whole texts, in slabs of chunks of bounded size."""
    if "prior" in net:
        return np.full(len(texts), net["prior"][0], dtype=np.float64)
    scores, waiting, held = [], [], 0

    def flush():
        nonlocal waiting, held
        if waiting:
            starts = np.cumsum([0] + [len(w) for w in waiting[:-1]])
            scores.append(_combine(net, np.concatenate(waiting), starts)[0])
            waiting, held = [], 0

    batch, size = [], 0

    def run():
        nonlocal batch, size, held
        if batch:
            features = pooled(net, np.concatenate(batch))
            waiting.extend(np.split(features, np.cumsum([len(b) for b in batch])[:-1]))
            held += size
            batch, size = [], 0

    for text in texts:
        chunks = chunks_of(text)
        if len(chunks) > SLAB:  # a very long text goes through in slabs of its own
            run()
            waiting.append(np.concatenate([pooled(net, chunks[i:i + SLAB]) for i in range(0, len(chunks), SLAB)]))
        else:
            if size + len(chunks) > SLAB:
                run()
            batch.append(chunks)
            size += len(chunks)
        if held > 64 * SLAB:
            run()
            flush()
    run()
    flush()
    return np.concatenate(scores).astype(np.float64) if scores else np.zeros(0)


def responses(net: dict, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest response of every filter in every chunk and its place, in slabs."""
    raw, place = [], []
    for a in range(0, len(chunks), SLAB):
        response = _respond(net, _blocks(net, chunks[a:a + SLAB]))
        place.append(response.argmax(axis=1))
        raw.append(np.take_along_axis(response, place[-1][:, None, :], 1)[:, 0])
    return np.concatenate(raw), np.concatenate(place)


def gradients(net: dict, pieces: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss of a batch of texts, given by all their chunks."""
    chunks, sizes, width = np.concatenate(pieces), np.array([len(p) for p in pieces]), BLOCK * EMBED
    owner = np.repeat(np.arange(len(pieces)), sizes)
    raw, place = responses(net, chunks)
    features = np.maximum(raw, 0)
    p, document = _combine(net, features, np.cumsum(sizes) - sizes)
    dz = ((p - y) * weight / len(pieces)).astype(np.float32)
    top = features >= document[owner][:, FILTERS:]
    # Chunks with the same greatest response share its gradient.
    shared = np.add.reduceat(top.astype(np.float32), np.cumsum(sizes) - sizes)[owner]
    df = dz[owner][:, None] * (net["out"][:FILTERS] / sizes[owner][:, None] + net["out"][FILTERS:] * top / shared)
    df = (df * (raw > 0)).astype(np.float32)
    filters, embed = np.zeros_like(net["filters"]), np.zeros_like(net["embed"])
    for a in range(0, len(chunks), SLAB):
        here, some, at = chunks[a:a + SLAB], df[a:a + SLAB], place[a:a + SLAB]
        blocks, rows = _blocks(net, here), np.arange(len(here))[:, None]
        window = np.concatenate([blocks[rows, at], blocks[rows, at + 1]], axis=2)  # chunk x filter x 2 width
        filters += np.einsum("cfw,cf->wf", window, some, optimize=True)
        used = here[rows[:, :, None], at[:, :, None] * BLOCK + np.arange(2 * BLOCK)].ravel()
        back = (some[:, :, None] * net["filters"].T[None]).reshape(-1, EMBED)
        embed += np.stack([np.bincount(used, weights=back[:, e], minlength=256) for e in range(EMBED)], 1)
    return {"out": document.T @ dz, "bias": dz.sum(keepdims=True), "shift": df.sum(axis=0), "filters": filters, "embed": embed}


def train(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over batches of 48 texts, each with all its chunks."""
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return {"prior": np.array([(y.sum() + 1) / (len(y) + 2)])}
    rng = np.random.default_rng(seed)
    net = new_network(seed)
    pieces = [chunks_of(text) for text in texts]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 48):
            docs = order[at:at + 48]
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, g in gradients(net, [pieces[d] for d in docs], y[docs], weight[docs]).items():
                g = g.astype(np.float32) + decay * net[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net[k] = net[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Train on a bounded sample of the labelled documents that are not held out."""
    rows = labelled_texts(docs, labels, "quality", TRAIN_PER_CLASS, MODULUS, REST, TRAIN_CHARS).toPandas()
    rows = rows.sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["_label"].tolist())


def probability(net: dict, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(net, strings(texts)))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = fit(docs, labels)
    scored = docs.select("doc_id", held_out("doc_id", MODULUS, REST).alias("held_out"),
                         probability(net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
