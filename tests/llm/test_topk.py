import math

import numpy as np
import pytest

from larder.llm import topk

VECTORS = "vec_id long, embedding array<float>"


def slow(rows, queries, k):
    usable = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    ids = {i for i, _ in queries}
    out = []
    for i, q in usable:
        if i in ids:
            scores = [(-sum(a * b for a, b in zip(q, c)), j) for j, c in usable if j != i]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(spark, rows, queries, **options):
    table = lambda x: spark.createDataFrame(x, VECTORS)
    return sorted(map(tuple, topk.top_k(table(rows), table(queries), **options).collect()))


def test_sparse_and_dense_vectors_match_brute_force(spark):
    draw = np.random.default_rng(1)
    rows = []
    for i in range(300):
        v = draw.normal(0, 0.3, 24)
        v[draw.random(24) < (0.9 if i % 2 else 0.1)] = 0
        rows.append((i, [float(x) for x in v]))
    queries = [r for r in rows if r[0] % 7 == 0]
    want = slow(rows, queries, 5)
    assert found(spark, rows, queries, k=5) == want
    assert found(spark, rows, queries, k=5, candidate_block=32, query_block=8) == want


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0, -0.5]),
        (1, None),
        (2, [float("nan"), 1.0, 1.0]),
        (3, [float("inf"), 1.0, 1.0]),
        (4, [None, 1.0, 1.0]),
        (5, [1.0, 0.0, -0.5]),
        (6, []),
        (7, [0.5]),
        (8, [1.0, 0.0, -0.5]),
        (9, [-1.0, 2.0, 3.0, 4.0]),
    ]
    assert found(spark, rows, rows[:8:2] + rows[1:2], k=3) == slow(rows, rows[:8:2], 3)
    assert found(spark, rows[:1], rows[:1]) == []
    assert found(spark, [], []) == []


def test_repeated_rows_rank_each_for_itself(spark):
    rows = [(1, [1.0]), (2, [0.5]), (2, [0.5]), (3, [0.25])]
    assert found(spark, rows, [(1, [1.0])], k=2) == [(1, 1, 2, 2048), (1, 2, 2, 2048)]


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i), 1.0]) for i in range(10)]
    table = spark.createDataFrame(rows, VECTORS)
    more = table.withColumns({c: F.lit(1) for c in ("weights", "q", "c", "nth", "rank", "score")})
    assert sorted(map(tuple, topk.top_k(more, more, k=2).collect())) == slow(rows, rows, 2)


def test_rows_without_an_id_take_no_part(spark):
    rows = [(1, [1.0]), (None, [0.9]), (2, [0.5]), (None, [0.4])]
    assert found(spark, rows, [(1, [1.0]), (None, [1.0])], k=3) == [(1, 1, 2, 2048)]


def test_rows_of_the_query_s_id_are_its_own(spark):
    rows = [(20, [1.0]), (20, [0.5]), (3, [0.25])]
    assert found(spark, rows, rows[:2], k=2) == [(20, 1, 3, 512), (20, 1, 3, 1024)]


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, [1e4 + i, -2e4 * i]) for i in range(9)]
    assert found(spark, rows, rows[:3], k=4) == slow(rows, rows[:3], 4)
    with pytest.raises(Exception, match="a component times"):
        found(spark, [(1, [1e30]), (2, [1.0])], [(1, [1e30])])
    with pytest.raises(Exception, match="inner products may reach"):
        found(spark, [(1, [1e9]), (2, [1e9])], [(1, [1e9])])
