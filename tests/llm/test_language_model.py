import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import language_model as lm
from larder.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return WORD.findall((text or "").translate(UPPER)) + ["\n"]


def quantised(count):
    """What a count is read as: the middle of the counts of its level."""
    least = [1]
    while least[-1] <= count:
        least.append(max(least[-1] + 1, math.ceil(least[-1] * 1.25)))
    return (least[-2] + least[-1] - 1) / 2 if count else 0


def slow(rows):
    """Rows with the exact base score and the model's scores by strength without a filter, and
    the log-likelihood of the training rows by strength, each token left out."""
    words, pairs, starts = Counter(), Counter(), 0
    for i, text in rows:
        if not held(i):
            own = tokens(text)
            words.update(own)
            pairs.update(zip([None, *own], own))
            starts += 1
    n, total = sum(words.values()), sum(words.values()) + len(words) + 1
    read = {w: quantised(c) for w, c in words.items()} | {None: quantised(starts)}
    reads = {p: min(quantised(c), read[p[0]]) for p, c in pairs.items()}
    out, left_out = [], [0.0] * len(lm.STRENGTHS)
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((words[w] + 1) / total) for w in own)
        scores = []
        for k, m in enumerate(lm.STRENGTHS):
            score = 0.0
            for v, w in zip([None, *own], own):
                c, cv, cw = reads.get((v, w), 0), read.get(v, 0), read.get(w, 0)
                score += math.log10((c + m * (cw + 1) / total) / (cv + m))
                if not held(i):
                    less = max(c - 1, 0) + m * (max(cw - 1, 0) + 1) / total
                    left_out[k] += math.log10(less / (max(cv - 1, 0) + m))
            scores.append(score)
        out.append((i, held(i), len(own), sum(words[w] > 0 for w in own), n, base, scores))
    return out, left_out


def order(r):
    return (r[0] is None, r[0] or 0, r[2], r[5])


def same(found, rows, near=0.01):
    """Exact columns agree; score is near that of one strength, which is as good as the best."""
    want, left_out = slow(rows)
    found, want = sorted(map(tuple, found), key=order), sorted(want, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    away = np.abs(np.array([r[6] for r in want]) - np.array([[r[6]] for r in found]))
    k = int(away.sum(axis=0).argmin())
    assert left_out[k] >= max(left_out) * 1.01
    assert all(a[5] == pytest.approx(b[5], rel=1e-9) for a, b in zip(found, want))
    # One wrong hit in the filter moves a text's score by up to about 5.
    exact = np.array([r[6][k] for r in want])
    off = np.abs(np.array([r[6] for r in found]) - exact)
    assert off.sum() <= near * np.abs(exact).sum() + 1e-6 and (off <= 6 + near * np.abs(exact)).mean() > 0.95


def test_query_matches_exact_counts(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    # Pairs that the filter wrongly takes for seen move a text's score by a little.
    found = QUERIES["op11_language_model"](spark, SMALL).collect()
    same(found, rows)
    held_out = [r for r in found if r.held_out]
    size = sum(r.n_tokens for r in held_out)
    assert sum(r.score for r in held_out) / size > sum(r.base_score for r in held_out) / size


def test_rare_words_lots_and_buckets_change_nothing(spark):
    docs = table(spark, SMALL, "documents").limit(150)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = lm.score(spark.createDataFrame(rows, "doc_id long, text string"))
    cut = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), most_bytes=60_000, head_words=50, bucket_bytes=30_000)
    same(plain.collect(), rows)
    same(cut.collect(), rows)


def test_odd_rows(spark, odd, empty, clashing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(lm.score(odd).collect(), rows)
    same(lm.score(clashing).collect(), rows)
    assert lm.score(empty).collect() == []


def test_only_held_out_rows(spark):
    ids = [i for i in range(50) if held(i)][:3]
    found = lm.score(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(4, 0, 0, 0.0, 0.0)] * 3


def test_the_filter_reads_levels_back():
    draw = np.random.default_rng(1)
    hashes = np.unique(draw.integers(0, 2**63, 50_000).astype(np.uint64))
    counts = np.maximum(1, (draw.pareto(0.7, len(hashes))).astype(np.int64))
    bits = 2
    bucket = lm.bucket_of(hashes, bits)
    parts = [(b, lm.filter_part(hashes[bucket == b], counts[bucket == b])) for b in range(4)]

    def made(some):
        out = lm.Filter([(b, len(data)) for b, data in some], bits)
        for b, data in some:
            out.put(b, data)
        return out

    read = made(parts).levels(hashes)
    want = lm.level(counts)
    # A level is never read too low; too high with the rate of false hits.
    assert (read >= want).all() and (read > want).mean() < 0.02
    other = np.setdiff1d(draw.integers(0, 2**63, 50_000).astype(np.uint64), hashes)
    assert (made(parts).levels(other) > 0).mean() < 0.02
    assert (made(parts[:2]).levels(hashes)[bucket >= 2] == 0).all()


def test_levels():
    assert lm.level(np.array([0, 1, 2, 3, 4, 5, 6, 7, 8])).tolist() == [0, 1, 2, 3, 4, 5, 5, 6, 6]
    assert lm.VALUE[:7].tolist() == [0, 1, 2, 3, 4, 5.5, 7.5]
    assert len(lm.LEAST) < 256 and len(lm.VALUE) == len(lm.LEAST) + 1
