import random
import re

import numpy as np
import xxhash

from larder.llm import simhash
from larder.llm.components import components


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, most=3):
    """Smallest key each key reaches, by comparing all."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_fingerprints_and_components_match_all_pairs(documents, texts):
    prints = {i: slow_print(t) for i, t in texts.items()}
    found = simhash.near_duplicates(documents).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == groups(prints)


def test_links_of_made_clusters_are_all_found(spark):
    """Dense clusters and chains around random centres, with the pruning at work."""
    draw = random.Random(3)
    prints = set()
    for _ in range(150):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 25)):
            prints.add(at)
            for bit in draw.sample(range(64), draw.randrange(1, 5)):
                at ^= 1 << bit
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    pairs = simhash.near_pairs(table, shard_rows=64).collect()
    assert all((r.a % 2**64 ^ r.b % 2**64).bit_count() <= 3 for r in pairs)
    want = groups({x: x for x in prints})
    ends = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    root = {x: x for x in prints} | {r.node % 2**64: r.root % 2**64 for r in ends}
    joined = {}
    for x in prints:
        joined.setdefault(root[x], set()).add(x)
    expected = {}
    for x, y in want.items():
        expected.setdefault(y, set()).add(x)
    assert sorted(map(sorted, joined.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**dict.fromkeys(range(201), 0), 300: 300, 301: 300}


def test_odd_rows(odd, clashing, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[5].fingerprint == 0
    assert by_id[1].component_id == by_id[2].component_id == by_id[5].component_id == 1
    assert by_id[4].component_id == 3
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.first_of_each(empty).collect() == []
    kept = simhash.first_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 6, 7, 8]
