import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import whitening
from larder.llm.queries import QUERIES, table

VECTORS = "vec_id long, embedding array<double>"
SMALL = "/root/testdata/sf0.01"


def slow(rows, k=8):
    """(n, deviations, mean, values, vectors) of usable rows, by whole numbers and a dense solver."""
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = max((len(v) for _, v in usable), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in list(v) + [0.0] * (wide - len(v))] for _, v in usable]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    d = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    v = d.T @ d / max(n, 1)
    values, vectors = np.linalg.eigh(v)
    return [i for i, _ in usable], deviations, d, v, values[::-1][:k], vectors[:, ::-1][:, :k]


def check(found, rows, k=8):
    ids, deviations, d, v, values, vectors = slow(rows, k)
    keep = values > 1e-12 * np.trace(v)
    values, vectors = values[keep], vectors[:, keep]
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(found) == len(ids) * len(values)
    for place, i in enumerate(ids):
        for c in range(len(values)):
            (r,) = by[i][c + 1]
            assert r.n == len(ids) and r.deviation == deviations[place]
            assert r.explained == pytest.approx(values[c] / np.trace(v), rel=1e-9)
            assert r.identity_error < 1e-9
            assert abs(r.whitened) == pytest.approx(abs(d[place] @ vectors[:, c]) / math.sqrt(values[c]), abs=1e-6)


def run(spark, rows, k=8):
    return whitening.whiten(spark.createDataFrame(rows, VECTORS), k).collect()


def test_query_matches_a_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    check(QUERIES["op13_whitening"](spark, SMALL).collect(), rows)


@pytest.mark.parametrize("d, n", [(1, 9), (2, 30), (9, 60), (40, 200)])
def test_shapes(spark, d, n):
    draw = np.random.default_rng(d)
    rows = [(i, [float(x) for x in draw.normal(0, 1 / (1 + np.arange(d)))]) for i in range(n)]
    check(run(spark, rows), rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 0.0, -0.5]), (1, None), (2, [float("nan"), 1.0, 1.0]), (3, [float("inf"), 1.0, 1.0]),
        (4, [None, 1.0, 1.0]), (None, [1.0, 2.0, -0.5]), (6, []), (7, [0.5]), (8, [-1.0, 2.0, 3.0]),
    ]
    check(run(spark, rows), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(i, [0.5, 2.0]) for i in range(5)]])
def test_nothing_varies(spark, rows):
    assert run(spark, rows) == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, -1.0]), (3, [1.0, 5.0])]
    more = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("x", "w", "place", "value", "n")})
    found = whitening.whiten(more).collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="a component times"):
        run(spark, [(1, [1e30]), (2, [0.0])])


def spectrum(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.ones(30),
        np.concatenate((np.full(12, 2.0), np.full(18, 1.0))),
        np.linspace(1, 1.001, 40),
        10.0 ** -np.arange(20),
        np.concatenate((np.ones(7), [0.5, 0.5 - 1e-9], np.full(20, 0.1))),
        np.concatenate(([1e8], np.linspace(1, 2, 50))),
        np.concatenate((np.ones(3), np.zeros(20))),
    ],
    ids=["equal", "tie", "close", "steep", "near", "one", "rank"],
)
def test_no_component_is_missed(values):
    v = spectrum(values)
    v = (v + v.T) / 2
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    got, vectors = whitening.eigenpairs(v, 8)
    k = min(8, int((want > 1e-13 * want.sum()).sum()))
    assert len(got) == k and np.allclose(got, want[:k], rtol=1e-6, atol=1e-13 * want.sum())
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * want.sum()


def test_inertia_counts():
    v = spectrum(np.arange(1.0, 21.0))
    tri = whitening.tridiagonal(v)
    assert [whitening.above(tri, s) for s in (0.5, 1.5, 10.5, 19.5, 20.5)] == [20, 19, 10, 1, 0]
