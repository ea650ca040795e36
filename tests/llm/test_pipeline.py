"""The registered queries and the pipeline on the smallest given tables."""

from __future__ import annotations

import os
import zlib

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")


def test_pipeline_keeps_what_each_stage_keeps(spark):
    import corpus_pipeline as p
    from tidewagon.llm import decontaminate, pii, simhash, toxicity

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = p.run(spark, FOLDER).toPandas()
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < toxicity.THRESHOLD}
    codes = {i: simhash.fingerprint(t) for i, t in texts.items()}
    kept, group = set(), {}
    for i in sorted(codes):  # first of each component
        group[i] = {i}
        for j in list(group):
            if j != i and (codes[i] ^ codes[j]).bit_count() <= 3 and group[i] is not group[j]:
                union = group[i] | group[j]
                group.update({k: union for k in union})
    kept = {min(g) for g in group.values()}
    items = [set(decontaminate.shingles(decontaminate.words(r.text))) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(
        len(s & set(decontaminate.shingles(decontaminate.words(texts[i])))) >= 0.8 * len(s) for s in items)}
    assert set(out.doc_id) == clean
    from tokenizers import Tokenizer
    from tidewagon.llm.packing import tokenizer_path
    import numpy as np

    whole = Tokenizer.from_file(tokenizer_path())
    for i in sorted(clean)[:60]:
        ids = np.array(whole.encode(pii.redact(texts[i]), add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        got = out[out.doc_id == i].sort_values("piece")
        assert got.ids_crc32.tolist() == [zlib.crc32(ids[a:a + 16384]) for a in range(0, len(ids), 16384)]


def test_url_filters_equal_their_sql(spark):
    from check_oracle import connect, difference
    from tidewagon.llm.queries import llm_oracles, llm_queries

    for name, sql in llm_oracles().items():
        assert difference(llm_queries()[name](spark, FOLDER), connect(FOLDER), sql) is None
