import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import shingles

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    words = [w for w in (text or "").lower().split() if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    """Smallest id each id reaches over pairs with a Jaccard of 0.8, by comparing all."""
    sets = {i: slow_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if 5 * both >= 4 * (len(x) + len(y) - both):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}


def made(seed=5):
    """Groups around random texts: copies of copies with a few words replaced, some too many."""
    draw = random.Random(seed)
    texts, common = [], [f"c{i}" for i in range(40)]
    for _ in range(40):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice((3, 6, 9, 12, 25, 60, 150, 400)))]
        for _ in range(draw.randrange(1, 9)):
            texts.append(" ".join(base))
            if draw.random() < 0.3:
                base = base + [f"end{draw.randrange(9)}"]
            for _ in range(draw.randrange(0, 1 + max(1, len(base) // 35))):
                base = list(base)
                base[draw.randrange(len(base))] = f"new{draw.randrange(10**6)}"
        if draw.random() < 0.3:
            texts.append(" ".join(base[:20] + common))
    draw.shuffle(texts)
    return dict(enumerate(texts))


def test_groups_match_all_pairs(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], ROWS)
    want = slow_groups(texts)
    assert len(set(want.values())) < len(set(texts.values()))
    kept = corpus_pipeline.near_copies(spark, docs, None)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_stage_on_documents_matches_all_pairs(spark, documents, texts):
    kept = corpus_pipeline.near_copies(spark, documents, None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(slow_groups(texts).values()))


def test_prefixes_hold_the_shared_shingles():
    """However few of two similar sets are shared, and in whatever order, prefixes share enough."""
    for n in range(1, 400):
        for m in range(n, n * 5 // 4 + 1):
            need = -(-4 * (n + m) // 9)
            k = shingles.least_shared(n)
            assert shingles.prefix_size(n) >= n - need + k and shingles.prefix_size(m) >= m - need + k
            assert need >= k


def test_odd_rows(clashing, empty):
    kept = shingles.first_of_each(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 6, 7, 8]
    assert [r.text for r in rows if r.doc_id is None] == ["five six\nseven eight nine ten"]
    assert shingles.first_of_each(empty).collect() == []
    assert shingles.similar_documents(clashing.where(F.col("doc_id") == 8)).count() == 1


def test_dense_group_without_links_is_not_paired(spark, monkeypatch):
    """Copies of one text with three words changed in each: every two share much, none enough."""
    draw = random.Random(3)
    texts = {}
    for i in range(150):
        words = [f"w{j}" for j in range(150)]
        for j in (10, 40, 70, 100, 130):
            words[j + draw.randrange(20)] = f"new{i}_{j}"
        texts[i] = " ".join(words)
    texts[150] = " ".join(["other"] + texts[149].split()[1:])
    asked, verified = [], shingles.verified
    monkeypatch.setattr(shingles, "verified", lambda d, c, pairs: asked.append(pairs.count()) or verified(d, c, pairs))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = [r.doc_id for r in shingles.first_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(slow_groups(texts).values()))
    assert sum(asked) <= 10 * len(texts)


def test_sketches_differ_no_more_than_sets():
    draw = np.random.default_rng(1)
    for n in (0, 1, 5, 60, 700, 3000):
        both = draw.integers(0, 2**63, n).astype(np.uint64)
        for extra in (0, 1, n // 9, n):
            x, y = (np.unique(np.r_[both, draw.integers(0, 2**63, extra).astype(np.uint64)]) for _ in range(2))
            bits = int(np.bitwise_count((shingles.sketch_of(x) ^ shingles.sketch_of(y)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(x, y))
