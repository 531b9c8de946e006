"""The pipeline's near-copy stage follows links of fingerprints and of shingle sets."""

import random

import corpus_pipeline
from larder.llm import shingles, simhash


def test_links_of_both_kinds_are_followed(spark):
    draw = random.Random(5)
    words = lambda n: ["".join(draw.choices("abcdefgh", k=5)) for _ in range(n)]
    base = words(400)
    near = list(base)
    for i in range(0, 400, 20):
        near[i] = "zz"  # 20 of 400 words: fingerprints stay close, five-word sets do not
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(words(300)))]
    rows += [(9 + i, " ".join(base[:200] + words(i) + base[200:])) for i in range(1, 9)]
    rows += [(30, " ".join(near)), (None, None), (40, ""), (41, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {tuple(r) for r in simhash.components_of(docs).select("doc_id", "component").collect()}
    sets = {tuple(r) for r in shingles.similar_documents(docs).select("doc_id", "component").collect()}
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for found in (prints, sets):
        for a, x in found:
            for b, y in found:
                if x == y and top(a) != top(b):
                    low, high = sorted((top(a), top(b)), key=lambda i: (i is None, i or 0))
                    root[high] = low
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, None).select("doc_id").collect())
    assert kept == sorted({top(r[0]) for r in rows})


def test_the_named_method_takes_part(spark, monkeypatch):
    called = []
    whole = simhash.components_of
    monkeypatch.setattr(simhash, "components_of", lambda docs, **o: called.append(1) or whole(docs, **o))
    corpus_pipeline.near_copies(spark, spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), None).count()
    assert called
