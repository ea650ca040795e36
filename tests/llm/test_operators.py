"""The operators against plain computations, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewagon.llm import components, decontaminate, imatch, langid, lm, packing, pii, quality, simhash, toxicity, urlfilter
from tidewagon.llm.common import bounded_sample, labelled_texts, ship

WORDS = "alpha beta gamma delta rho sigma tau omega kappa lambda theta iota".split()


def prose(seed: int, count: int) -> str:
    rng = np.random.default_rng(seed)
    words = [WORDS[i] + str(rng.integers(30)) for i in rng.integers(len(WORDS), size=count)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


# Null and empty texts, no word, one word, copies, ties, a repeated row, a null id, a very long text.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "!!! ... 123"), (5, "word"), (6, prose(1, 60)), (7, prose(1, 60)),
           (8, prose(2, 80)), (8, prose(2, 80)), (9, prose(3, 9000)), (None, prose(4, 40)), (11, "Ünï ßtraße İ é \U0001f600 x")]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, None, "s", 0, 0.5, "clash") for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score double, component_id string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, " ".join(prose(2, 80).split()[:30])), (4, "unseen words of a test item entirely")],
                                 "item_id long, text string")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- awkward rows, empty tables --------------------------------------------------------------------------


def test_every_operator_takes_awkward_rows(docs, labels, benchmark):
    n = len(AWKWARD)
    assert len(rows(langid.identify(docs))) == n
    assert {r[1] for r in rows(langid.identify(docs).select("doc_id", "lang_pred"))} == {"und"}  # nothing to learn from
    for found in (quality.score_documents(docs, labels), toxicity.score_documents(docs, labels)):
        scores = [r.score for r in found.collect()]
        assert len(scores) == n and all(0 <= s <= 1 for s in scores)
    assert len(rows(pii.report(docs))) == n
    assert len(rows(lm.score_documents(docs))) == n
    assert len(rows(imatch.fingerprints(docs))) == n
    near = simhash.report(docs).toPandas()
    assert len(near) == n and near[near.doc_id.isin([1, 2, 3])].fingerprint.eq("0" * 16).all()
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == {(8, 3)}
    packed = packing.pack(docs).toPandas()
    assert packed[packed.doc_id == 1][["length", "start"]].values.tolist() == [[1, 0]]


def test_every_operator_takes_empty_tables(spark, docs, labels, benchmark):
    none, no_items = docs.where("false"), benchmark.where("false")
    for df in (langid.identify(none), quality.score_documents(none, labels), toxicity.score_documents(none, labels),
               pii.report(none), lm.score_documents(none), imatch.fingerprints(none), simhash.report(none),
               simhash.keep_first(none), decontaminate.contaminated(none, benchmark), packing.pack(none)):
        assert df.count() == 0
    assert decontaminate.contaminated(docs, no_items).count() == 0
    assert decontaminate.keep_clean(docs, no_items).count() == len(AWKWARD)
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.evaluate(urlfilter.derived_captures(pages), urlfilter.derived_entries(pages)).count() == 0


def test_stages_keep_the_columns(docs, labels, benchmark):
    for df in (toxicity.keep_clean(docs, labels), simhash.keep_first(docs), decontaminate.keep_clean(docs, benchmark),
               pii.redacted(docs)):
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
    assert decontaminate.keep_clean(docs, benchmark).where("doc_id = 8").count() == 0
    kept = sorted(r.doc_id or 0 for r in simhash.keep_first(docs).collect())
    assert kept == [0, 1, 4, 5, 6, 8, 9, 11]  # empty texts together, copies once, the repeated row once


def test_bounded_sample(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, 'few', 'many') as g")
    assert sorted((r.g, r["count"]) for r in bounded_sample(df, "g", 40, "id").groupBy("g").count().collect()) == [
        ("few", 40), ("many", 40)]


# --- 1 language, 6 quality, 8 toxicity --------------------------------------------------------------------


def test_windows_do_not_change_the_presence_of_grams():
    text = prose(5, 700)
    count = langid.windows_in(len(text))
    whole = np.zeros((count, langid.PLACES), dtype=np.float32)
    langid.presence(text, whole, 0, count)
    for w in range(count):
        alone = np.zeros((1, langid.PLACES), dtype=np.float32)
        end = len(text) if w == count - 1 else (w + 1) * langid.WINDOW + 3
        langid.presence(text[w * langid.WINDOW:end], alone, 0, 1)
        assert np.array_equal(alone[0], whole[w])


def test_language_held_out(spark):
    ship(spark)
    stems = {"aa": "mor tun kel", "bb": "zip qua xen"}
    rng = np.random.default_rng(0)
    data = [(i, " ".join(rng.choice(stems[k].split()) + rng.choice(["a", "o", "i"]) for _ in range(30)), k)
            for i in range(80) for k in [("aa", "bb")[i % 2]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.held_out, r.lang_pred) for r in langid.identify(df).collect()}
    assert all(found[i] == (zlib.crc32(str(i).encode()) % 4 == 2, k) for i, _, k in data)


def test_long_texts_weigh_the_mean_of_all_chunks():
    good, bad = [prose(i, 60) for i in range(40)], ["### " * 80 + str(i) for i in range(40)]
    net = quality.train(good + bad, [1] * 40 + [0] * 40, epochs=6)
    assert quality.predict(net, [prose(99, 60), "### " * 70]).round().tolist() == [1, 0]
    long = prose(7, 20000)
    alone = quality.predict(net, [long])[0]
    assert quality.predict(net, ["", long, "short"])[1] == pytest.approx(alone, abs=1e-6)


def test_quality_gradient_is_that_of_the_loss(monkeypatch):
    monkeypatch.setattr(quality, "SLAB", 3)  # several slabs
    pieces = [quality.chunks_of(prose(i, 20 + 150 * i)) for i in range(4)]
    y, weight = np.array([1, 0, 1, 0], dtype=np.float32), np.array([0.7, 1.3, 0.9, 1.1])
    net = {k: v.astype(np.float64) for k, v in quality.new_network(3).items()}

    def loss(net):
        p = np.array([quality._combine(net, quality.pooled(net, c), np.array([0]))[0][0] for c in pieces])
        return float(np.mean(-weight * (y * np.log(p) + (1 - y) * np.log(1 - p))))

    grad, rng = quality.gradients(net, pieces, y, weight), np.random.default_rng(1)
    for k, v in net.items():
        at = np.argsort(-np.abs(grad[k].ravel()))[:8] if k == "embed" else rng.integers(v.size, size=8)
        for i in at:
            moved = []
            for d in (1e-5, -1e-5):
                flat = v.ravel().copy()
                flat[i] += d
                moved.append(loss(net | {k: flat.reshape(v.shape)}))
            assert (moved[0] - moved[1]) / 2e-5 == pytest.approx(float(grad[k].ravel()[i]), rel=2e-2, abs=2e-5), k


def test_language_model_equals_plain_kernel_ridge():
    """Weights of the kernel values against ridge regression on explicit Nystroem features."""
    texts = [prose(i, 40 + 60 * i) for i in range(9)]
    names = np.arange(9) % 3
    bits = np.stack([np.frombuffer(langid.landmark_bits(t, 0), dtype=np.uint8) for t in texts[:5]])
    kernels, targets = [], []
    for index, _, k in langid.window_kernels(texts, langid._unit(bits)):
        kernels += list(k)
        targets += [names[index]] * len(k)
    assert len(kernels) == sum(langid.windows_in(len(t)) for t in texts)

    def grams(part):
        low = part.lower()
        return {(n, low[i:i + n]) for n in langid.ORDERS for i in range(len(low) - n + 1)}

    def cosine(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    first = [grams(t[:langid.WINDOW] if langid.windows_in(len(t)) > 1 else t) for t in texts]
    at = np.cumsum([0] + [langid.windows_in(len(t)) for t in texts[:-1]])
    for i, place in enumerate(at):  # equal up to hash collisions and the grams that end in the next window
        assert kernels[place] == pytest.approx([cosine(first[i], m) for m in first[:5]], abs=0.02)
    k, y = np.array(kernels, dtype=np.float64), np.eye(3)[targets]
    unit = langid._unit(bits)
    values, vectors = np.linalg.eigh((unit.T @ unit).astype(np.float64))
    phi = k @ vectors @ np.diag(values ** -0.5) @ vectors.T
    ridge = langid.RIDGE * len(k) / len(bits)
    plain = np.linalg.solve(phi.T @ phi + ridge * np.eye(len(bits)), phi.T @ y)
    assert k @ langid.solve(bits, k.T @ k, k.T @ y, len(k)) == pytest.approx(phi @ plain, abs=1e-6)


def test_a_training_sample_is_bounded_whatever_repeats(spark):
    docs = spark.range(900).selectExpr("if(id < 300, 4, id) as doc_id", "concat('text ', id, repeat('x', 90)) as text")
    labels = spark.range(900).selectExpr("if(id < 300, 4, id) as doc_id", "cast(id % 2 as int) as toxic").where("doc_id <> 4 or toxic = 1")
    torn = labels.union(spark.sql("select 500L, 0 union all select 500L, 1"))
    got = [labelled_texts(docs.repartition(n), torn.repartition(n), "toxic", 200, 4, 2, 10 ** 9).collect() for n in (1, 5)]
    assert sorted(got[0]) == sorted(got[1])
    ids = [r.doc_id for r in got[0]]
    assert len(ids) == len(set(ids)) and 4 in ids and 500 not in ids
    assert all(sum(r._label == y for r in got[0]) <= 200 for y in (0, 1))
    few = labelled_texts(docs, torn, "toxic", 200, 4, 2, 1000).collect()
    assert 9 <= len(few) <= 11 and all(r.text.endswith("x" * 90) for r in few)  # whole texts up to 1000 characters


def test_equal_texts_with_both_labels_count_as_toxic():
    texts = ["fine day. good words here", "vile scum now"] * 6 + [f"calm {i}" for i in range(9)]
    labels = [0, 1] * 6 + [0] * 9
    a = toxicity.train(texts + ["vile scum now"], labels + [0])
    b = toxicity.train(["vile scum now"] + texts, [0] + labels)
    assert toxicity.Scorer(a).score("vile scum now") == pytest.approx(toxicity.Scorer(b).score("vile scum now"), abs=0.02)


def test_one_row_of_every_group_of_copies_with_all_its_columns(spark):
    ship(spark)
    data = [(5, "a b c d e", "p"), (5, "a b c d e", "q"), (3, "a b c d e", "r"), (None, "u v w x y z", "s"), (None, "u v w x y z", "s"), (9, None, "t")]
    docs = spark.createDataFrame(data, "doc_id long, text string, _kept string").withColumn("_row", F.lit(1)).withColumn("_place", F.lit(2))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:3] for r in kept.collect()), key=str) == sorted([(3, "a b c d e", "r"), (None, "u v w x y z", "s"), (9, None, "t")], key=str)


def test_toxicity_learns_sentences_from_documents():
    clean = [prose(i, 90) for i in range(60)]
    toxic = [c.replace(".", ". you blorgish oaf.", 1) for c in clean[:30]]
    scorer = toxicity.Scorer(toxicity.train(clean[30:] + toxic, [0] * 30 + [1] * 30))
    text = prose(200, 40) + " You BLORGISH oaf. " + prose(201, 40)
    assert scorer.score(text) > 0.9 and scorer.score(prose(300, 450)) < 0.3
    assert any("BLORGISH" in text[s["start"]:s["end"]] for s in scorer.locate(text))
    # noisy-or of the sentences, step by step
    z = scorer._sentences(toxicity._TOKEN.findall(text.lower()))
    assert scorer.score(text) == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))


# --- 2 packing ---------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, memory = Tokenizer.from_file(path), packing.Ids(path)
    for text in [t for _, t in AWKWARD[:11] if t] + [
            "Don't stop; it's 3.5% <|endoftext|> x<|endoftext|>y", "É́ a ́b ß ẞ İI ΑΣ ΑΣ.", "a b\x0bc\x1cd e"]:
        expected = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert memory.of(text) == expected, text


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(3)
    bins, free, made = packing.BestFit(100, 5), {}, 0
    for length in rng.integers(1, 101, size=2000).tolist():
        number, offset = bins.put(length)
        fitting = [f for f in free.values() if f >= length]
        if fitting:
            assert free[number] == min(fitting)
        else:
            if len(free) == 5:
                fullest = min(free.values())
                closed = [k for k, f in free.items() if f == fullest and k not in {
                    n for s in bins.by_free for n in s}]
                del free[closed[0]]
            assert number == made
            free[number], made = 100, made + 1
        assert offset == 100 - free[number]
        free[number] -= length
        if not free[number]:
            del free[number]
    assert bins.still_open() == set(free)


def test_packing_is_gapless_and_cuts_long_documents_only(docs):
    found = packing.pack(docs, capacity=64, open_bins=4).toPandas().sort_values(["sequence_id", "offset"])
    ends = found.groupby("sequence_id").length.cumsum()
    assert (ends - found.length == found.offset).all() and ends.max() <= 64
    cut = found[found.piece > 0]
    assert (cut.start == cut.piece * 64).all()


# --- 3 decontamination -------------------------------------------------------------------------------------


def test_wand_retrieves_all_above_the_threshold():
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, size=rng.integers(3, 15)))) for i in range(70)]
    df: dict[str, int] = {}
    for _, text in items:
        for w in set(text.split()):
            df[w] = df.get(w, 0) + 1
    index = decontaminate.Index(items, df, len(items), 9.0)
    for trial in range(60):
        query = index.numbers(rng.choice(vocabulary, size=20).tolist())
        scores = np.zeros(len(items))
        for t in set(query.tolist()) - {len(index.posts)}:
            for place, value in zip(*index.posts[t]):
                scores[place] += value
        for threshold in (0.3, 0.6, 0.9):
            got = dict(index.search(query, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
            assert all(got[p] == pytest.approx(scores[p]) for p in got)
            if got:
                assert 0 in index.candidates(query, threshold)


def test_question_and_answer_must_both_be_there():
    item = "alpha1 beta2 gamma3 delta4 rho5 sigma6 tau7 omega8. kappa9 lambda10 theta11 iota12"
    df = dict.fromkeys(decontaminate.words(item), 1)
    index = decontaminate.Index([(5, item)], df, 1, 12.0)
    assert [h["item_id"] for h in index.hits("some words before " + item.upper() + " and after")] == [5]
    assert not index.hits(item.split(".")[0])  # the question alone
    assert not index.hits(" ".join(reversed(item.split())))  # the words without their order


def test_a_long_text_in_stretches_meets_the_same_items():
    rng = np.random.default_rng(3)
    names = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(names, 30))) for k in range(12)]
    df = {}
    for _, text in items:
        for term in set(decontaminate.words(text)):
            df[term] = df.get(term, 0) + 1
    index = decontaminate.Index(items, df, len(items), 30.0)
    parts = []
    for k in (4, 7, 4, 11, 0):
        parts += [" ".join(rng.choice(names, int(rng.integers(40, 300)))), items[k][1], "other " * 90]
    numbers = index.numbers(decontaminate.words(" ".join(parts)))
    whole = [h["item_id"] for h in index.hits(" ".join(parts))]
    assert set(whole) == {0, 4, 7, 11}
    plain = set(index.candidates(numbers, decontaminate.THRESHOLD).tolist())
    for cells in (1, 2 * index.blocks, 5 * index.blocks):
        assert plain == set(index.candidates(numbers, decontaminate.THRESHOLD, cells).tolist())


# --- 4 language model -------------------------------------------------------------------------------------


def plain_log_probability(net: dict, tokens, t: int) -> float:
    near = [tokens[t + k] if 0 <= t + k < len(tokens) else lm.EDGE for k in (-2, -1, 1, 2)]
    x = np.concatenate([net["embed"][n] for n in near]).astype(float)
    hidden = np.maximum(x @ net["inner"] + net["shift"], 0)
    c, place = divmod(int(tokens[t]), lm.CLASS)
    classes, inside = hidden @ net["outer"] + net["bias"], hidden @ net["within"][c] + net["offset"][c]
    return classes[c] - np.log(np.exp(classes).sum()) + inside[place] - np.log(np.exp(inside).sum())


def test_log_probabilities_against_a_plain_softmax():
    net = lm.new_network(5)
    tokens = np.random.default_rng(2).integers(0, lm.EDGE, size=40).astype(np.int32)
    got = lm.log_probabilities(net, tokens)
    for t in range(len(tokens)):
        assert got[t] == pytest.approx(plain_log_probability(net, tokens, t), abs=1e-4)


def test_probabilities_of_all_tokens_add_up_to_one():
    net = lm.new_network(3)
    tokens = np.full(lm.SIZE, 7, dtype=np.int32)
    around = np.tile(np.array([[1, 2, 3, 4]], dtype=np.int32), (lm.SIZE, 1))
    assert np.exp(lm.log_probabilities(net, np.arange(lm.SIZE, dtype=np.int32), around)).sum() == pytest.approx(1, abs=1e-4)
    assert len(tokens) == lm.SIZE


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(8)
    net = {k: v.astype(np.float64) for k, v in lm.new_network(4).items()}
    tokens = rng.integers(0, lm.EDGE, size=60).astype(np.int32)
    around = lm.contexts(tokens)
    found = lm.gradients(net, tokens, around)
    loss = lambda: -np.mean([plain_log_probability(net, tokens, t) for t in range(len(tokens))])
    for name, g in found.items():
        assert g.shape == net[name].shape
        flat = net[name].ravel()
        for at in np.argsort(-np.abs(g.ravel()))[:3].tolist() + rng.integers(flat.size, size=2).tolist():
            kept, small = flat[at], 1e-5
            flat[at] = kept + small
            up = loss()
            flat[at] = kept - small
            down = loss()
            flat[at] = kept
            assert g.ravel()[at] == pytest.approx((up - down) / (2 * small), abs=2e-5), name


def test_learning_raises_the_likelihood():
    net = lm.new_network()
    tokens = np.tile(np.arange(20, dtype=np.int32), 300)
    before = lm.log_probabilities(net, tokens).mean()
    lm.learn(net, tokens, lm.contexts(tokens), 0.1)
    assert lm.log_probabilities(net, tokens).mean() > before + 1
    assert all(np.array_equal(a, b) for a, b in zip(lm.from_bytes(lm.to_bytes(net)).values(), net.values()))


def test_weights_of_tasks_are_averaged_by_their_tokens(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    data = [(i, rng.integers(0, 200, size=int(n)).astype(np.uint8).tobytes()) for i, n in enumerate(rng.integers(1, 3000, size=12))]
    held = spark.createDataFrame(data, "doc_id long, tokens binary").repartition(3)
    start = lm.to_bytes(lm.new_network())
    parts = held.select("tokens").rdd.glom().map(lambda rows: [bytes(r[0]) for r in rows]).collect()
    total, weight = 0, 0
    for rows_here in parts:
        net, power, waiting, near, seen = lm.from_bytes(start), lm.no_power(lm.new_network()), [], [], 0
        for text in rows_here:
            tokens = lm.unpacked(text)
            some = lm.lessons(tokens, 0)
            seen += len(tokens)
            waiting.append(tokens[some])
            near.append(lm.contexts(tokens, some))
        if waiting:
            waiting, near = np.concatenate(waiting), np.concatenate(near)
            order = np.random.default_rng(seen).permutation(len(waiting))
            lm.learn(net, waiting[order], near[order], 0.1, power)
        total = total + np.frombuffer(lm.to_bytes(net), dtype=np.float32).astype(float) * seen
        weight += seen
    found = np.frombuffer(lm.one_round(held, start, 0), dtype=np.float32)
    assert np.allclose(found, total / weight, atol=1e-4)


def test_the_most_frequent_words_are_taken(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + 100_000 // (i + 1)) for i in range(3000)], "word string, n long")
    found = lm.frequent_words(counts, 500)
    assert 400 <= len(found) <= 600 and all(f"w{i}" in found for i in range(400)) and not any(f"w{i}" in found for i in range(620, 3000))
    assert len(lm.frequent_words(counts, 5000)) == 3000 and lm.frequent_words(counts.where("false"), 5) == {}


def test_no_word_loses_its_spelling(spark):
    pieces = lm.merged_pieces({"the": 50, "then": 9, "thé": 3})
    known = lm.Vocabulary(pieces)
    for text in ("the then hen", "rare unheard-of \u4e2d words", "\u2581 the", "\U0001f600"):
        spelled, at, tokens = b"", 0, known.tokens(text).tolist()
        while at < len(tokens):
            if tokens[at] < lm.PIECES:
                spelled += pieces[tokens[at]].encode()
                at += 1
            else:
                spelled += bytes([(tokens[at] - lm.PIECES) * 16 + tokens[at + 1] - lm.PIECES - 16])
                at += 2
        assert spelled.decode() == "".join(" " + w for w in text.split())
    # Two texts with rare words of one length: before, both had the same tokens and so the same log_prob.
    data = [(i, prose(i, 60)) for i in range(20)] + [(100, "alpha3 river beta4"), (101, "alpha3 xqzvk beta4")]
    found = {r.doc_id: r.log_prob for r in lm.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found[100] != found[101]


def plain_tokens(pieces: list[str], text: str | None) -> bytes:
    """The longest piece at every place, word by word."""
    out, number = [], {p: i for i, p in enumerate(pieces)}
    for word in (text or "").lower().split():
        word = lm.START + word
        while word:
            size = max((len(p) for p in pieces if word.startswith(p)), default=0)
            if size:
                out.append(number[word[:size]])
            else:
                for byte in word[0].encode():
                    out += [lm.PIECES + (byte >> 4), lm.PIECES + 16 + (byte & 15)]
            word = word[size or 1:]
    return bytes(out)


def odd_texts(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    letters = "abcdefth eE\u03a3\u03c3\u0130\u00e9\u4e2d\U0001f600\x00\x1c\x85\xa0\u2003\u3000\n'."
    long = "".join(rng.choice("abcdefgh") for _ in range(900))
    return [None, "", " \n\t ", "the", " the  hen\x1f", long, long + " then " + long, "\u0391\u03a3 \u0391\u03a3"] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(40)]


def test_texts_cut_together_are_cut_into_the_longest_pieces(monkeypatch):
    pieces = sorted(lm.merged_pieces({"the": 50, "then": 9, "th\u00e9": 3, "abcdef": 4, "feed": 3, "bcd": 2}))
    for stretch, few in ((1 << 18, 32), (50, 0), (7, 2)):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        monkeypatch.setattr(lm, "FEW", few)
        for voc in (pieces, [], ["ab", "abcd", "c"]):
            texts = odd_texts(stretch)
            assert lm.Vocabulary(voc).packed(texts) == [plain_tokens(voc, t) for t in texts]
    assert lm.Vocabulary(pieces).packed([]) == []


def test_cutting_takes_less_than_a_pattern_word_by_word():
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(150_000)]
    known = lm.Vocabulary(sorted(lm.merged_pieces(Counter(words[:5000]))))
    texts = [" ".join(words[a:a + 500]) for a in range(0, len(words), 500)]
    began = time.process_time()
    plain = [known.cut(lm.START + w) for text in texts for w in text.lower().split()]
    between = time.process_time()
    packed = known.packed(texts)
    assert time.process_time() - between < (between - began) * 0.6
    assert sum(map(len, packed)) == sum(map(len, plain))


def test_words_are_counted_as_python_parts_them(spark, monkeypatch):
    ship(spark)
    texts = odd_texts(3) + ["The the THE\x85then"] * 3
    plain = Counter(w for t in texts for w in (t or "").lower().split())
    held = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {r.word: r.n for r in lm.word_counts(held).collect()} == plain
    monkeypatch.setattr(lm, "STRETCH", 5)
    found = Counter(w for words in lm.words_of(texts) for w in words.to_pylist())
    assert {w: n for w, n in found.items() if w} == plain


def test_every_token_is_learned_from():
    for size in (0, 1, 2, 16, 31, 1000):
        tokens = np.random.default_rng(size).integers(0, lm.EDGE, size=size).astype(np.int32)
        places = np.concatenate([lm.lessons(tokens, number) for number in range(lm.ROUNDS)])
        assert sorted(places.tolist()) == list(range(size))


# --- 5 URL lists ------------------------------------------------------------------------------------------


def test_entries_hold_from_their_day_until_removed(spark):
    entries = spark.sql("""select * from values ('l','Bad.example','add',date'2024-01-10'), ('l','bad.example','add',date'2024-01-12'),
        ('l','bad.example','remove',date'2024-02-01'), ('l','x.org/ads','add',date'2024-01-01'), ('m','bad.example','add',date'2024-01-31'),
        ('l','tie.net','add',date'2024-01-05'), ('l','tie.net','remove',date'2024-01-05'), (null,'y.org','add',date'2024-01-01')
        as t(list, pattern, action, day)""")
    captures = spark.sql("""select * from values (1,'http://www.bad.example/a',date'2024-01-09'), (2,'http://www.bad.example/a',date'2024-01-10'),
        (3,'http://bad.example',date'2024-01-31'), (4,'http://bad.example',date'2024-02-01'), (5,'http://notbad.example',date'2024-01-15'),
        (6,'https://X.org/ads?q=1',date'2024-05-01'), (7,'https://x.org/other',date'2024-05-01'), (8,cast(null as string),date'2024-01-15'),
        (9,'http://bad.example',cast(null as date)), (10,'http://tie.net',date'2024-01-06'), (2,'http://www.bad.example/a',date'2024-01-10')
        as t(page_id, url, fetched)""")
    found = urlfilter.evaluate(captures, entries)
    assert found.columns[:3] == captures.columns
    got = sorted((r.page_id, r.blocked, r.lists) for r in found.collect())
    assert got == [(1, False, ""), (2, True, "l"), (2, True, "l"), (3, True, "l,m"), (4, True, "m"), (5, False, ""),
                   (6, True, "l"), (7, False, ""), (8, False, ""), (9, False, ""), (10, False, "")]


def test_captures_with_clashing_columns_and_long_urls(spark):
    entries = spark.sql("select 'l' as list, 'x.org' as pattern, 'add' as action, date'2024-01-01' as day")
    long = "http://" + "a." * 300 + "x.org/" + "p" * 20_000
    captures = spark.sql(f"""select *, 'mine' as pattern, 7 as blocked, 'z' as lists, 1.5 as matches, 'd' as _day, 'h' as _host,
        's' as list, 'r' as _capture from values (1,'{long}',date'2024-01-02'), (2,'http://y.org',date'2024-01-02') as t(page_id, url, fetched)""")
    found = urlfilter.evaluate(captures, entries)
    assert len(set(found.columns)) == len(found.columns) == len(captures.columns) + 4
    got = {r.page_id: r for r in found.collect()}
    assert (got[1].blocked, got[1].pattern, got[1].capture_pattern, got[1].capture_blocked) == (True, "x.org", "mine", 7)
    assert (got[2].blocked, got[2].pattern, got[2]._day, got[2].capture_matches) == (False, None, "d", 1.5)


def test_case_counts_in_the_path_only(spark):
    entries = spark.sql("select 'l' as list, 'X.org/Ads' as pattern, 'add' as action, date'2024-01-01' as day")
    captures = spark.sql("""select * from values (1,'http://x.org/Ads',date'2024-01-02'), (2,'http://X.ORG/Ads/b',date'2024-01-02'),
        (3,'http://x.org/ads',date'2024-01-02') as t(page_id, url, fetched)""")
    found = urlfilter.evaluate(captures, entries).collect()
    assert sorted((r.page_id, r.blocked, r.pattern) for r in found) == [(1, True, "x.org/Ads"), (2, True, "x.org/Ads"), (3, False, None)]


# --- 7 personal data --------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[\x20-]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(4)
    pieces = ["a@b.cc", "@", ".", "d@e", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100",
              "+", " ", "-", "x", "9", "10.0.0.1.5", "é", "_%+", "b@c.d-e.f", "00000000000000"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, size=rng.integers(1, 9)))
        base = [s for s in pii.find(text) if s.kind in pii.BASE_KINDS]
        assert pii.listing(base) == plain_base(text), text


def test_long_runs_are_linear_and_context_counts():
    assert pii.find("a" * 300_000 + "9" * 300_000 + "." * 1000 + "+" * 100_000) == []
    assert [s.kind for s in pii.find("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert not pii.find("IBAN GB83 WEST 1234 5698 7654 32")
    assert [s.kind for s in pii.find("phone 0171 555 1234")] == ["local_phone"] and not pii.find("0171 555 1234")
    assert pii.redact("mail a@b.cc, card +4111111111111111!") == "mail [EMAIL], card +[CARD]!"
    assert pii.redact("mail a@b.cc now") == "mail [EMAIL] now"


# --- 9 SimHash --------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_bits():
    for _, text in AWKWARD:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(codes, distance=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def clustered(count, seed=0):
    rng = np.random.default_rng(seed)
    codes = {int(x) for x in rng.integers(0, 2 ** 63, size=count // 8, dtype=np.int64)}
    while len(codes) < count:
        near = list(codes)[int(rng.integers(len(codes)))]
        for bit in rng.integers(0, 64, size=int(rng.integers(1, 5))):
            near ^= 1 << int(bit)
        codes.add(near)
    return sorted(codes)


def same_groups(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_gray_index_finds_every_link():
    codes = np.array(clustered(500), dtype=np.uint64)
    bucket = np.zeros(len(codes), dtype=np.int64)
    order = np.lexsort((simhash.gray_rank(codes), bucket))
    index = simhash.GrayIndex(codes[order], bucket)
    got = {(int(i), int(j)) for a, b in index.links(3) for i, j in zip(a, b)}
    sorted_codes = codes[order].tolist()
    assert got == {(i, j) for j in range(len(codes)) for i in range(j) if (sorted_codes[i] ^ sorted_codes[j]).bit_count() <= 3}


@pytest.mark.parametrize("bucket", [10_000, 20])  # with the smaller one, buckets are dealt out again
def test_links_join_the_same_components(spark, bucket):
    codes = clustered(400, 1)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    edges = simhash.links(df, bucket=bucket)
    stars = {r.u: r.v for r in components.smallest_reachable(edges).collect()}
    got = [stars.get(simhash._signed(c), simhash._signed(c)) for c in codes]
    assert same_groups(got, plain_components(codes))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)]
    got = {r.u: r.v for r in components.smallest_reachable(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1001 + i] == 1000 for i in range(300))


# --- 10 I-Match -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("per_task", [10 ** 9, 300])
def test_edited_texts_follow_the_descending_ids(spark, monkeypatch, per_task):
    ship(spark)
    monkeypatch.setattr(imatch, "CHARS_PER_TASK", per_task)
    data = [(i * 3, prose(i // 2, 20 + i)) for i in range(30)] + [(4, ""), (5, None)]
    found = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    order = sorted(((i, t or "") for i, t in data), reverse=True)
    assert len(found) == len(data)
    for k, (i, text) in enumerate(order):
        half, following = len(text) // 2, order[(k + 1) % len(order)][1]
        changed = text[:len(text) - half] + following[:half]
        assert found[i].n_chars == len(text)
        assert found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
        if changed == text:
            assert found[i].near_edited == 1 and found[i].fingerprint == found[i].edited_fingerprint


def test_fingerprint_hashes_sorted_distinct_terms():
    lexicon = imatch.Lexicon(sorted(f"t{i}" for i in range(200)))
    a = [f"t{i}" for i in range(40)]
    assert (lexicon.fingerprint(a) == lexicon.fingerprint(list(reversed(a)) + a)).all()
    held = lexicon.drawn[[lexicon[t] for t in a]].any(axis=0)
    assert (lexicon.fingerprint(a)[:-1] == lexicon.fingerprint(a + ["unknown"])[:-1])[held].all()  # the lexicon goes first
    b = a[:-1] + ["t150"]
    assert 0.3 < imatch.likeness(lexicon.fingerprint(a), lexicon.fingerprint(b)) < 1
    assert imatch.likeness(lexicon.fingerprint(a), lexicon.fingerprint([f"t{i}" for i in range(100, 140)])) < 0.1


def plain_numbers(text: str, ordered: list[str]) -> list[int]:
    """Number by number, in Python integers."""
    words = set(re.findall(r"[^\W_]+", text.lower()))
    of = lambda t: xxhash.xxh64_intdigest(t.encode())
    out = []
    for k in range(imatch.SUBSETS):
        factor, below = int(imatch._FACTORS[k]), int(imatch.SHARES[k // imatch.DRAWS] * 2 ** 64)
        taken = {t for t in words if of(t) * factor % 2 ** 64 < below}
        known = [of(t) for t in sorted(taken & set(ordered))] or sorted(of(t) for t in taken)
        out.append(xxhash.xxh32_intdigest(b"".join(h.to_bytes(8, "little") for h in known)) % 65535 + 1 if known else 0)
    whole = "\n".join(sorted(words)) or text
    return out + [xxhash.xxh32_intdigest(whole.encode()) % 65535 + 1 if whole else 0]


def test_fingerprints_equal_a_plain_computation(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(imatch, "CHARS_PER_TASK", 800)
    data = [(i, prose(i // 3, 15 + 7 * i)) for i in range(40)] + [(7, "ΑΣ Σα İx"), (7, "joint"), (None, "a_b-c"), (None, "!"), (41, None)]
    counts = Counter(t for _, text in data for t in set(imatch.terms(text)))
    ordered = sorted(t for t, n in counts.items() if 2 <= n <= 0.2 * len(data))
    texts = {}
    for i, text in data:
        texts.setdefault(i, []).append(text or "")
    found = imatch.fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(6)).collect()
    assert len(found) == len(data)
    numbers = lambda digits: [int(digits[i:i + 4], 16) for i in range(0, len(digits), 4)]
    ids = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for r in found:
        own = [t for t in texts[r.doc_id] if numbers(r.fingerprint) == plain_numbers(t, ordered)]
        assert own
        beside = texts[r.doc_id] + texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        right = [(t, n, imatch.edited(t, n)) for t in own for n in beside
                 if hashlib.sha256(imatch.edited(t, n).encode()).hexdigest() == r.edited_sha256]
        assert right and numbers(r.edited_fingerprint) == plain_numbers(right[0][2], ordered)
        pairs = [(a, b) for a, b in zip(numbers(r.fingerprint), numbers(r.edited_fingerprint)) if a or b]
        assert r.near_edited == pytest.approx(sum(a == b for a, b in pairs) / len(pairs) if pairs else 1.0)


@pytest.mark.parametrize("held", [50, 400_000])
def test_the_lexicon_is_that_of_a_plain_count(spark, monkeypatch, held):
    ship(spark)
    monkeypatch.setattr(imatch, "HELD_TERMS", held)
    texts = [prose(i % 40, 30) + f" only{i}" for i in range(300)] + [None, ""] + ["rare pair"] * 2
    counts = Counter(t for text in texts for t in set(imatch.terms(text)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    for low in (0.002, 0.02, 0.1):
        assert imatch.lexicon(docs, len(texts), low, 0.2) == sorted(
            t for t, n in counts.items() if max(2, low * len(texts)) <= n <= 0.2 * len(texts))


def test_terms_of_halves_are_those_of_the_edited_text():
    texts = ["", "a", "one two three", "onetwo", "x_y z", "ΑΣ βΣ", "İstanbul 12", "a  b", prose(5, 40), prose(6, 3)]
    for a in texts:
        for b in texts:
            one, two = imatch.Document(a), imatch.Document(b)
            assert one.words == imatch.terms(a)
            assert one.edited_words(two) == imatch.terms(imatch.edited(a, b)), (a, b)


def test_many_rows_of_one_id_are_divided(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(imatch, "CHARS_PER_TASK", 2000)
    data = [(5, "same text of one id")] * 600 + [(None, f"text {i}") for i in range(300)] + [(i, prose(i, 9)) for i in range(100)]
    plans = []
    original = imatch.written
    monkeypatch.setattr(imatch, "written", lambda df, label: plans.append(original(df, label)) or plans[-1])
    assert imatch.fingerprints(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).count() == 1000
    sizes = [r["count"] for r in plans[0].withColumn("file", F.input_file_name()).groupBy("file").count().collect()]
    assert len(sizes) >= 5 and max(sizes) <= 500


def test_texts_without_lexicon_terms_are_alike_only_if_equal():
    lexicon = imatch.Lexicon(sorted(f"t{i}" for i in range(200)))
    texts = ["Andththwhes.", "In. The.", "Mentmentan.", "!?", "...", "t1 rare", "t1 other", "t1", "t1 t2 rare", "t1 t2 other"]
    found = [lexicon.of(t) for t in texts]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (imatch.likeness(a, b) == 1) == (i == j), (texts[i], texts[j])
    assert (lexicon.of("the in") == lexicon.of("In. The.")).all() and not lexicon.of("").any()
    words = [f"w{i}" for i in range(30)]
    assert 0.3 < imatch.likeness(lexicon.of(" ".join(words)), lexicon.of(" ".join(words[:-1]))) < 1
    assert all(imatch.likeness(imatch.Lexicon([]).of(a), imatch.Lexicon([]).of(b)) < 1 for a, b in zip(texts, texts[1:]))


@pytest.mark.parametrize("wide", [imatch.WIDE, 20])
def test_fingerprints_of_documents_taken_together(monkeypatch, wide):
    monkeypatch.setattr(imatch, "WIDE", wide)
    texts = ["", "!", "a_b-c", prose(1, 40), prose(2, 900), "ΑΣ Σα İx", prose(1, 40), *(f"lone{i} words{i}" for i in range(9))]
    ordered = sorted(imatch.terms(prose(1, 25)))
    found = imatch.Lexicon(sorted(set(ordered))).fingerprints([(imatch.terms(t), t) for t in texts])
    assert found.tolist() == [plain_numbers(t, sorted(set(ordered))) for t in texts]
    assert imatch.Lexicon(ordered[:1]).fingerprints([]).shape == (0, imatch.SUBSETS + 1)


def test_terms_are_the_matches_of_their_pattern():
    rng = np.random.default_rng(6)
    for letters in ("aZ9_ -.\t\n\x1c", "aé_ .̇²中 \x85İΣ", "".join(map(chr, range(0x250)))):
        for size in range(60):
            text = "".join(rng.choice(list(letters), size=size))
            assert imatch.terms(text) == re.findall(r"[^\W_]+", text.lower())


def test_long_texts_are_taken_alone(monkeypatch):
    monkeypatch.setattr(imatch, "CHARS_TOGETHER", 100)
    monkeypatch.setattr(imatch, "TOGETHER", 4)
    sizes = [0, 10, 200, 99, 0, 1, 5, 5, 5, 5, 5, 500]
    assert list(imatch._runs(["x" * n for n in sizes])) == [(0, 3), (3, 6), (6, 10), (10, 12)]
    assert list(imatch._runs([])) == [] and list(imatch._runs([""])) == [(0, 1)]
