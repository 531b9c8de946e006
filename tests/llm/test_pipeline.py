import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from larder.llm import decontaminate, toxicity
from larder.llm.common import stored
from larder.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.01"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SMALL, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SMALL), name))
    return docs


def slow_groups(texts):
    """Smallest id each id reaches over pairs with a Jaccard of 0.8, by all pairs with a shared shingle."""
    sets, holders = {}, {}
    for i, text in texts.items():
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        for shingle in sets[i]:
            holders.setdefault(shingle, []).append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    both = Counter(pair for held in holders.values() for pair in combinations(sorted(held), 2))
    for (a, b), n in both.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: top(i) for i in root}


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_have_the_columns_of_documents(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_each_stage_does_what_its_operator_says(spark, stages):
    documents, clean, single, safe, mixed, written = stages
    weights = toxicity.fit(documents, table(spark, SMALL, "labels"))
    scores = {r.doc_id: r["score"] for r in toxicity.scored(documents, weights).collect()}
    assert ids(clean) == sorted(i for i, s in scores.items() if s < 0.7)
    # One document of each group by five-word Jaccard stays, the one with the smallest id.
    groups = slow_groups({r.doc_id: r.text for r in clean.collect()})
    firsts = set(groups.values())
    assert ids(single) == sorted(firsts) and len(firsts) < len(groups)
    leaked = {r.doc_id for r in decontaminate.overlaps(single, table(spark, SMALL, "benchmark")).collect()}
    assert leaked and ids(safe) == sorted(firsts - leaked)
    assert set(ids(mixed)) <= set(ids(safe))
    assert ids(written) == ids(mixed)


def test_run_is_registered():
    assert "pipeline" in QUERIES and len([q for q in QUERIES if q.startswith("op")]) == 13
