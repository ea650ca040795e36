"""LM scoring (4): masked pseudo-likelihood.

A bidirectional window network predicts every token from the tokens on both sides of it; the summed
conditional log-probabilities score a document. Tokens are ids of a subword tokenizer: word beginnings, pieces and
single characters, merged pair by pair (BPE) from the most frequent words of all documents, counted over the whole corpus.
A word is cut into the longest pieces; a character without a token is its UTF-8 bytes, two half-byte tokens each. So
every word keeps its spelling, as target and as context, and its probability is a product over its parts.

The probability of a token is that of its class times that within the class: two soft-maxes over 16 instead of one over 256. Pieces
are numbered in order of their spelling, so a class holds pieces that begin alike.

The network (embeddings, one hidden layer, the two soft-maxes) is trained in numpy where the data is: every task starts from the
same weights, learns from the tokens of its own documents, and the weights of the tasks are averaged in proportion to
their tokens, in a tree. Two such rounds are made; each takes every second token of a text, so every token is
learned from exactly once. What is gathered grows with the input; what a task or the driver holds does not.

Cases: null, empty and blank texts have no token: log-probability 0, mean null. Repeated rows score alike. Without any
token in the corpus the network is untrained, and there is nothing to score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import objects, reuse_memory, strings, written

PIECES = 223  # pieces of the tokenizer: characters and what is merged from them
CHARACTERS = 128  # at most so many of them single characters
HALVES = 32  # tokens of the upper and lower half-bytes of all other characters
EDGE = PIECES + HALVES  # what stands beyond both ends of a text
SIZE = EDGE + 1  # at most 256: a token is kept as one byte
CLASS = 16  # tokens of a class, and classes
MERGE_WORDS = 20_000  # about so many of the most frequent words, from which pieces are merged
START = " "  # stands before a word, so no word has it
SIDE = 2  # tokens seen on each side
WIDTH, HIDDEN = 16, 32
ROUNDS = 2  # of every so many tokens each round learns from another one, so together from all
BATCH = 4096
SLAB = 16_384  # tokens that are scored together
LEARNED = 65_536  # tokens that are put in random order and learned from together
PRODUCT = 8192  # tokens per matrix product
HELD_BYTES = 1 << 25  # words that a task counts together
STRETCH = 1 << 18  # characters that are cut together
FEW = 128  # words that are cut one after the other
TREE = 64


def merged_pieces(counts: dict[str, int]) -> list[str]:
    """Single characters and the pieces that merging the most frequent neighbours gives, ties in order of the pair."""
    letters: Counter = Counter()
    for word, n in counts.items():
        for c in word:
            letters[c] += n
    single = [START] + sorted(sorted(letters), key=lambda c: -letters[c])[:CHARACTERS - 1]
    known = set(single)
    # A character without a piece of its own parts a word; nothing is merged over it.
    parts, weight = [], []
    for word, n in counts.items():
        run: list[str] = []
        for c in [START, *word, ""]:
            if c in known:
                run.append(c)
            else:
                if len(run) > 1:
                    parts.append(run)
                    weight.append(n)
                run = []
    pairs: Counter = Counter()
    where: dict[tuple, set[int]] = defaultdict(set)
    for at, run in enumerate(parts):
        for pair in zip(run, run[1:]):
            pairs[pair] += weight[at]
            where[pair].add(at)
    pieces = list(single)
    while len(pieces) < PIECES and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] <= 0:
            break
        joined = best[0] + best[1]
        if joined not in known:
            known.add(joined)
            pieces.append(joined)
        for at in where.pop(best):
            old, new, i = parts[at], [], 0
            for pair in zip(old, old[1:]):
                pairs[pair] -= weight[at]
            while i < len(old):
                both = i + 1 < len(old) and (old[i], old[i + 1]) == best
                new.append(joined if both else old[i])
                i += 1 + both
            parts[at] = new
            for pair in zip(new, new[1:]):
                pairs[pair] += weight[at]
                where[pair].add(at)
        del pairs[best]
    return pieces


def _longest(pieces: Iterable[str]) -> str:
    """A pattern of the longest piece at a place: a tree of their characters."""
    below: dict[str, list[str]] = {}
    for piece in pieces:
        if piece:
            below.setdefault(piece[0], []).append(piece[1:])
    if not below:
        return ""
    inner = "|".join(re.escape(c) + _longest(rest) for c, rest in below.items())
    return f"(?:{inner})" + ("?" if "" in pieces else "")


def _white() -> np.ndarray:
    """Whether a code point parts words, as ``str.split`` has it."""
    white = np.zeros(0x110000, dtype=bool)
    # Beyond the plane of two bytes there is no white space.
    white[[c for c in range(1 << 16) if chr(c).isspace()]] = True
    return white


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _characters(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


_PARTED = re.compile(r"\s").search


def _stretches(text: str | None) -> Iterator[str]:
    """A text in lower case, parted where words end if it is long."""
    text, a = (text or "").lower(), 0
    while len(text) - a > STRETCH:
        end = _PARTED(text, a + STRETCH)
        b = end.start() if end else len(text)
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


class Vocabulary:
    """Cuts texts into tokens, one byte each.

    The words of many texts are cut side by side: a step walks the tree of the pieces from a place in every word that has not
    come to its end. The last few words, which are long, are cut by a pattern, one after the other.
    """

    WHITE = 255  # the letter of white space; 0 is that of characters in no piece
    OTHER, NONE = 254, 255  # at a character without a token, and inside a token or between words

    def __init__(self, pieces: list[str]):
        self.token_of = {p: i for i, p in enumerate(pieces)}
        self.cut = re.compile(_longest(list(pieces)) + r"|[\s\S]" if pieces else r"[\s\S]").findall
        number = {c: n for n, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        self.start = number.get(START, 0)
        self.letter = np.zeros(0x110000, dtype=np.uint8)
        self.letter[[ord(c) for c in number]] = list(number.values())
        self.letter[_white()] = self.WHITE
        # Node 0 has no child and no token, node 1 is the root.
        below, tokens = [{}, {}], [self.OTHER, self.OTHER]
        for piece, token in self.token_of.items():
            node = 1
            for c in piece:
                if number[c] not in below[node]:
                    below[node][number[c]] = len(below)
                    below.append({})
                    tokens.append(self.OTHER)
                node = below[node][number[c]]
            tokens[node] = token
        self.token = np.array(tokens, dtype=np.uint8)
        self.parent = np.array([bool(b) for b in below])
        self.child = np.zeros((len(below), 256), dtype=np.int64)
        for node, children in enumerate(below):
            self.child[node, list(children)] = list(children.values())
        self.child = self.child.ravel()

    def packed(self, texts: Iterable[str | None]) -> list[bytes]:
        """The tokens of every text."""
        found: list[list[bytes]] = []
        held, of, size = [], [], 0

        def run():
            nonlocal held, of, size
            for text, tokens in zip(of, self._together(held) if held else ()):
                found[text].append(tokens)
            held, of, size = [], [], 0

        for at, text in enumerate(texts):
            found.append([])
            for stretch in _stretches(text):
                held.append(stretch)
                of.append(at)
                size += len(stretch)
                if size >= STRETCH:
                    run()
        run()
        return [b"".join(f) for f in found]

    def _together(self, texts: list[str]) -> list[bytes]:
        """The tokens of texts in lower case, which are put together with a space before each and one at the end."""
        joined = START + START.join(texts) + START
        codes = _code_points(joined)
        letters = self.letter.take(codes)
        white = letters == self.WHITE
        at = np.flatnonzero(white[:-1] & ~white[1:])  # where words start, with the last white space before them
        letters[at] = self.start
        tokens = np.full(len(codes), self.NONE, dtype=np.uint8)
        while len(at):
            tokens[at], ends = self._step(letters, at)
            at = ends[~white.take(ends)]
            if len(at) < FEW:
                break
        for a in at.tolist():
            rest = self.cut(joined[a:_PARTED(joined, a).start()])
            tokens[list(accumulate(map(len, rest[:-1]), initial=a))] = [self.token_of.get(p, self.OTHER) for p in rest]
        places = np.flatnonzero(tokens != self.NONE)
        out = tokens.take(places)
        sizes = np.array([0, *map(len, texts)], dtype=np.int64) + 1
        ends = np.searchsorted(places, np.cumsum(sizes) - 1)
        others = np.flatnonzero(out == self.OTHER)
        if len(others):
            points = codes.take(places.take(others))
            points[white.take(places.take(others))] = ord(START)
            sizes = np.ones(len(out), dtype=np.int64)
            sizes[others] = 2 * (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
            ends = np.concatenate([[0], np.cumsum(sizes)])[ends]
            out = np.repeat(out, sizes)
            data = np.frombuffer(_characters(points).encode("utf-8", "surrogatepass"), dtype=np.uint8)
            out[out == self.OTHER] = np.stack([PIECES + (data >> 4), PIECES + 16 + (data & 15)], axis=1).ravel()
        data, ends = out.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def _step(self, letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token of the longest piece at every place, and where it ends; one character if there is no piece."""
        nodes = self.child[256:512].take(letters.take(at))
        found, ends = self.token.take(nodes), at + 1
        live = np.flatnonzero(self.parent.take(nodes))
        nodes, after = nodes.take(live), at.take(live) + 1
        while len(live):
            nodes = self.child.take((nodes << 8) + letters.take(after))
            after += 1
            tokens = self.token.take(nodes)
            whole = np.flatnonzero(tokens != self.OTHER)
            found[live.take(whole)] = tokens.take(whole)
            ends[live.take(whole)] = after.take(whole)
            on = np.flatnonzero(self.parent.take(nodes))
            live, nodes, after = live.take(on), nodes.take(on), after.take(on)
        return found, ends

    def tokens(self, text: str | None) -> np.ndarray:
        return unpacked(self.packed([text])[0])


def unpacked(tokens: bytes | None) -> np.ndarray:
    return np.frombuffer(tokens or b"", dtype=np.uint8)


def words_of(texts: Iterable[str | None]) -> Iterator[pa.Array]:
    """The words of all texts in lower case, many texts together; some are empty."""
    white = _white()
    held, size = [], 0

    def parted() -> pa.Array:
        codes = _code_points(START.join(held)).copy()
        codes[white.take(codes)] = ord(START)
        return pc.split_pattern(pa.array([_characters(codes)], pa.string()), START).values

    for text in texts:
        for stretch in _stretches(text):
            held.append(stretch)
            size += len(stretch)
            if size >= STRETCH:
                yield parted()
                held, size = [], 0
    if held:
        yield parted()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks add up their own counts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            words, n = pa.chunked_array(held, pa.string()).value_counts().flatten()
            return pa.RecordBatch.from_arrays([words, n], ["word", "n"]).filter(pc.not_equal(words, ""))

        for words in words_of(t for batch in batches for t in batch.column("text").to_pylist()):
            held.append(words)
            size += words.nbytes
            if size >= HELD_BYTES:
                yield counted()
                held, size = [], 0
        yield counted()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, words: int) -> dict[str, int]:
    """About ``words`` of the most frequent words of (word, n).

    The words are counted by steps of their frequency, a few hundred steps at most; those above the step at which the number is
    reached come to the driver, and of that step the share that is missing, chosen by a hash.
    """
    step = F.floor(F.log2(F.col("n")) * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    above, chosen = 0, F.lit(False)
    for row in steps:
        share = min(1.0, (words - above) / row["words"])
        inside = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
        chosen = (step > row["step"]) | ((step == row["step"]) & inside)
        above += row["words"]
        if above >= words:
            break
    return {r["word"]: r["n"] for r in counts.where(chosen).collect()}


def corpus_pieces(docs: DataFrame, words: int = MERGE_WORDS) -> list[str]:
    """The pieces of the tokenizer in order of their spelling; none for a corpus without words."""
    top = frequent_words(written(word_counts(docs), "lm-words"), words)
    # The order of equal words must not depend on how they came.
    return sorted(merged_pieces(dict(sorted(top.items())))) if top else []


def tokenized(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """(doc_id, tokens) as a written table, so texts are cut once for all rounds and the scores."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Vocabulary(shared.value)
        for texts in batches:
            yield objects(known.packed(strings(texts)))

    return written(docs.select("doc_id", packed("text").alias("tokens")), "lm-tokens")


_PLACES = np.eye(CLASS, dtype=np.float32)
_ZEROS = np.zeros((PRODUCT, HIDDEN), dtype=np.float32)
_SHAPE = {"embed": (SIZE, WIDTH), "inner": (2 * SIDE * WIDTH, HIDDEN), "shift": (HIDDEN,),
          "outer": (HIDDEN, SIZE // CLASS), "bias": (SIZE // CLASS,),
          "within": (SIZE // CLASS, HIDDEN, CLASS), "offset": (SIZE // CLASS, CLASS)}


def new_network(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"embed": 0.3, "inner": (2 * SIDE * WIDTH) ** -0.5, "outer": HIDDEN ** -0.5, "within": HIDDEN ** -0.5}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in _SHAPE.items()}


def to_bytes(net: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([net[k].ravel() for k in _SHAPE]).astype(np.float32).tobytes()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    flat, net, at = np.frombuffer(data, dtype=np.float32), {}, 0
    for k, shape in _SHAPE.items():
        size = int(np.prod(shape))
        net[k] = flat[at:at + size].reshape(shape).copy()
        at += size
    return net


_EDGES = np.full(SIDE, EDGE, dtype=np.uint8)


def contexts(tokens: np.ndarray, places: slice | np.ndarray = slice(None)) -> np.ndarray:
    """For every token, or those of ``places``, the ``SIDE`` tokens before it and after it; the token itself is masked."""
    padded = np.concatenate([_EDGES, tokens, _EDGES])
    around = np.empty((len(tokens[places]), 2 * SIDE), dtype=np.uint8)
    for column, k in enumerate(k for k in range(2 * SIDE + 1) if k != SIDE):
        around[:, column] = padded[k:k + len(tokens)][places]
    return around


def _by_class(tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places in order of the class of their token, and (class, from, to) of every class that occurs."""
    classes = (tokens // CLASS).astype(np.uint8)
    ends = np.cumsum(np.bincount(classes, minlength=SIZE // CLASS)).tolist()
    runs = [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
    return np.argsort(classes, kind="stable"), runs


def _within(net: dict, hidden: np.ndarray, classes: np.ndarray, runs: list) -> np.ndarray:
    """Scores of the tokens of the own class, for rows in order of their class."""
    out = np.empty((len(hidden), CLASS), dtype=np.float32)
    for c, a, b in runs:
        np.matmul(hidden[a:b], net["within"][c], out=out[a:b])
    out += net["offset"].take(classes, axis=0)
    return out


def _both(net: dict, hidden: np.ndarray, target: np.ndarray, runs: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Scores of the classes and within the class, each with the flat places of the targets."""
    classes, rows = target // CLASS, np.arange(0, len(target) * CLASS, CLASS)
    yield hidden @ net["outer"] + net["bias"], rows + classes
    yield _within(net, hidden, classes, runs), rows + target % CLASS


def _exponentials(scores: np.ndarray) -> np.ndarray:
    """exp of the scores in place, and their sums as a column; scores are held below what float32 can take."""
    if not scores.max(initial=0) <= 60:
        np.minimum(scores, 60, out=scores)
    np.exp(scores, out=scores)
    return scores @ np.ones((scores.shape[1], 1), dtype=np.float32)


def _tables(net: dict) -> list[np.ndarray]:
    """The first layer is a sum of one table of all tokens per place in the window."""
    return [net["embed"] @ net["inner"][k * WIDTH:(k + 1) * WIDTH] for k in range(2 * SIDE)]


def _hidden(net: dict, tables: list[np.ndarray], near: np.ndarray) -> np.ndarray:
    """Hidden layer of a batch; ``near`` has one row per place in the window."""
    hidden = tables[0].take(near[0], axis=0)
    for table, tokens in zip(tables[1:], near[1:]):
        hidden += table.take(tokens, axis=0)
    hidden += net["shift"]
    for a in range(0, len(hidden), PRODUCT):
        part = hidden[a:a + PRODUCT]
        np.maximum(part, _ZEROS[:len(part)], out=part)  # two arrays: several times as fast as with a number
    return hidden


def log_probabilities(net: dict, tokens: np.ndarray, around: np.ndarray | None = None) -> np.ndarray:
    """log P(token | both sides) of every token, in slabs."""
    around = contexts(tokens) if around is None else around
    tables = _tables(net)
    out = np.empty(len(tokens), dtype=np.float64)
    for a in range(0, len(tokens), PRODUCT):
        order, runs = _by_class(tokens[a:a + PRODUCT])
        near, target = around[a:a + PRODUCT].T.take(order, axis=1), tokens[a:a + PRODUCT].take(order)
        hidden = _hidden(net, tables, near)
        value = np.zeros(len(target))
        for scores, places in _both(net, hidden, target, runs):
            chosen = np.minimum(scores.take(places), 60)
            value += chosen - np.log(_exponentials(scores)[:, 0])
        out[a + order] = value
    return out


def _sum_by_token(rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Sums of the rows of every token: a product with the place in the class, class by class."""
    order, runs = _by_class(tokens)
    rows, place = rows.take(order, axis=0), _PLACES.take(tokens.take(order) % CLASS, axis=0)
    sums = np.zeros((SIZE, rows.shape[1]), dtype=rows.dtype)
    for c, a, b in runs:
        np.matmul(place[a:b].T, rows[a:b], out=sums[c * CLASS:(c + 1) * CLASS])
    return sums


def _total(rows: np.ndarray) -> np.ndarray:
    return np.ones(len(rows), dtype=rows.dtype) @ rows


def gradients(net: dict, tokens: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the tokens."""
    order, runs = _by_class(tokens)
    near, target = around.T.take(order, axis=1), tokens.take(order)
    hidden = _hidden(net, _tables(net), near)
    both = []
    for scores, places in _both(net, hidden, target, runs):
        scores *= 1 / (len(target) * _exponentials(scores))
        scores.reshape(-1)[places] -= 1 / len(target)
        both.append(scores)
    p, q = both
    dh = p @ net["outer"].T
    within, offset, back = np.zeros_like(net["within"]), np.zeros_like(net["offset"]), np.empty_like(dh)
    for c, a, b in runs:
        np.matmul(q[a:b], net["within"][c].T, out=back[a:b])
        within[c] = hidden[a:b].T @ q[a:b]
    dh += back
    offset[[c for c, _, _ in runs]] = np.add.reduceat(q, [a for _, a, _ in runs], axis=0)
    dh *= hidden > 0
    # Through the tables of the first layer, so that the products have a row per token of the vocabulary only.
    embed, inner = np.zeros_like(net["embed"]), np.empty_like(net["inner"])
    for k, at in enumerate(near):
        part, sums = slice(k * WIDTH, (k + 1) * WIDTH), _sum_by_token(dh, at)
        embed += sums @ net["inner"][part].T
        inner[part] = net["embed"].T @ sums
    return {"embed": embed, "inner": inner, "shift": _total(dh), "outer": hidden.T @ p, "bias": _total(p),
            "within": within, "offset": offset}


def learn(net: dict, tokens: np.ndarray, around: np.ndarray, rate: float, power: dict | None = None) -> None:
    """One pass over the examples in small batches, with Adagrad, in place; ``power`` goes on from an earlier pass."""
    power = no_power(net) if power is None else power
    for a in range(0, len(tokens), BATCH):
        for k, g in gradients(net, tokens[a:a + BATCH], around[a:a + BATCH]).items():
            power[k] += g * g
            net[k] -= rate * g / np.sqrt(power[k])


def no_power(net: dict) -> dict[str, np.ndarray]:
    return {k: np.full_like(v, 1e-3) for k, v in net.items()}


def _average(parts: DataFrame) -> DataFrame:
    """Add up (node, weight, sums) rows of ``TREE`` neighbouring nodes."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s, dtype=np.float64) for s in rows["sums"]], axis=0)
        return pd.DataFrame({"node": [int(rows["node"].iloc[0]) // TREE], "weight": [rows["weight"].sum()],
                             "sums": [total.tobytes()]})

    return (parts.groupBy(F.expr(f"node div {TREE}").alias("up"))
            .applyInPandas(add, "node long, weight double, sums binary"))


def one_round(held: DataFrame, start: bytes, number: int) -> bytes:
    """Weights after every task has learned from its documents, averaged by their tokens."""
    shared = held.sparkSession.sparkContext.broadcast(start)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reuse_memory()
        net = from_bytes(shared.value)
        power = no_power(net)
        seen, size, waiting, around = 0, 0, [], []

        def run():
            nonlocal size, waiting, around
            if waiting:
                tokens, near = np.concatenate(waiting), np.concatenate(around)
                order = np.random.default_rng(seen).permutation(len(tokens))
                learn(net, tokens.take(order), near.take(order, axis=0), 0.1 / (1 + number), power)
            size, waiting, around = 0, [], []

        for part in batches:
            for data in part["tokens"]:
                tokens = unpacked(data)
                places = lessons(tokens, number)
                learned, near = tokens[places], contexts(tokens, places)
                seen += len(tokens)
                for a in range(0, len(learned), LEARNED):
                    waiting.append(learned[a:a + LEARNED])
                    around.append(near[a:a + LEARNED])
                    size += len(waiting[-1])
                    if size >= LEARNED:
                        run()
        run()
        flat = np.frombuffer(to_bytes(net), dtype=np.float32).astype(np.float64)
        yield pd.DataFrame({"node": [TaskContext.get().partitionId()], "weight": [float(seen)],
                            "sums": [(flat * seen).tobytes()]})

    parts = held.select("tokens").mapInPandas(work, "node long, weight double, sums binary")
    rows = _average(_average(parts)).collect()  # one row per TREE * TREE tasks
    weight = sum(r["weight"] for r in rows)
    if not weight:
        return start
    total = np.sum([np.frombuffer(r["sums"], dtype=np.float64) for r in rows], axis=0)
    return (total / weight).astype(np.float32).tobytes()


def lessons(tokens: np.ndarray, number: int) -> np.ndarray:
    """Places of the tokens that are learned from in a round; over all rounds every place comes once."""
    # The start depends on the text alone, so the order of rows does not matter, and short texts take part in any round.
    return np.arange((int(tokens.sum()) + number) % ROUNDS, len(tokens), ROUNDS)


def fit(held: DataFrame) -> bytes:
    """Weights learned from tokens; without any they stay those of the start."""
    weights = to_bytes(new_network())
    for number in range(ROUNDS):
        weights = one_round(held, weights, number)
    return weights


def scored(weights: bytes, held: DataFrame) -> Column:
    """Struct (n_tokens, log_prob)."""
    shared = held.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("n_tokens long, log_prob double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reuse_memory()
        net = from_bytes(shared.value)
        for texts in batches:
            sizes, sums = [], []
            for tokens, near in _grouped(texts):
                ends = np.cumsum([len(t) for t in tokens])
                values = np.concatenate([[0.0], np.cumsum(log_probabilities(net, np.concatenate(tokens), near))])
                sizes += [len(t) for t in tokens]
                sums += (values[ends] - values[np.concatenate([[0], ends[:-1]])]).tolist()
            yield pd.DataFrame({"n_tokens": sizes, "log_prob": sums})

    return score("tokens")


def _grouped(texts) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts together until they fill a slab, so that short ones share a matrix product."""
    tokens: list[np.ndarray] = []
    size = 0
    for data in texts:
        tokens.append(unpacked(data))
        size += len(tokens[-1])
        if size >= SLAB:
            yield tokens, np.concatenate([contexts(t) for t in tokens])
            tokens, size = [], 0
    if tokens:
        yield tokens, np.concatenate([contexts(t) for t in tokens])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, summed log_prob and its mean of every document."""
    held = tokenized(docs, corpus_pieces(docs))
    return held.select("doc_id", scored(fit(held), held).alias("s")).select(
        "doc_id", "s.n_tokens", "s.log_prob",
        F.when(F.col("s.n_tokens") > 0, F.col("s.log_prob") / F.col("s.n_tokens")).alias("mean_log_prob"))
