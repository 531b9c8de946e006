import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import negatives

ROWS = "vec_id long, label int, embedding array<double>"


def slow(rows, anchors, positives=5, per=3):
    usable = lambda x: [
        (i, y, [math.floor(256 * c) for c in v]) for i, y, v in x
        if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    known = usable(rows)
    for i, y, a in usable(anchors):
        scored = sorted((-sum(p * q for p, q in zip(a, w)), j, z) for j, z, w in known if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            window = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(window[:per])]
    return sorted(out)


def found(spark, rows, anchors, **options):
    make = lambda x: spark.createDataFrame(x, ROWS)
    return sorted(map(tuple, negatives.hard_negatives(make(rows), make(anchors), **options).collect()))


def sample(n, d, seed, spread=0.4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 1, (6, d))
    return [(i, int(draw.integers(4)), [float(x) for x in centres[i % 6] + draw.normal(0, spread, d)]) for i in range(n)]


@pytest.mark.parametrize("n, d", [(400, 16), (300, 3), (50, 1)])
def test_matches_brute_force(spark, n, d):
    rows = sample(n, d, n)
    anchors = [r for r in rows if r[0] % 9 == 0]
    want = slow(rows, anchors)
    assert want and found(spark, rows, anchors) == want
    assert found(spark, rows, anchors, codes=3, shard_rows=40, anchor_rows=8) == want


def test_copies_and_ties(spark):
    rows = [(i, i % 3, [1.0, 0.5]) for i in range(120)] + [(200 + i, i % 2, [0.8, 0.4]) for i in range(60)]
    anchors = [r for r in rows if r[0] % 20 == 0]
    want = slow(rows, anchors)
    assert want and found(spark, rows, anchors, shard_rows=16) == want


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.0, -0.5]), (1, 1, None), (2, None, [1.0, 1.0, 1.0]), (3, 2, [float("nan"), 1.0, 1.0]),
        (4, 1, [None, 1.0, 1.0]), (None, 1, [1.0, 0.0, 0.0]), (6, 2, []), (7, 2, [0.5]), (8, 1, [1.0, 0.2]),
        (9, 1, [-1.0, 2.0, 3.0, 4.0]), (10, 2, [0.7, 0.0]), (11, 2, [float("inf")]), (8, 1, [1.0, 0.2]),
        (0, 2, [9.0]),
    ]
    assert found(spark, rows, rows) == slow(rows, rows)
    assert found(spark, [(1, 1, []), (2, 1, []), (3, 2, [])], [(1, 1, [])]) == [(1, 2, 1, 3, 0, 0)]
    assert found(spark, [], rows) == found(spark, rows, []) == found(spark, [], []) == []


def test_clashing_columns(spark):
    rows = sample(60, 4, 5)
    table = spark.createDataFrame(rows, ROWS)
    more = table.withColumns({c: F.lit(1) for c in ("weights", "block", "shard", "nth", "score", "place", "positives")})
    assert sorted(map(tuple, negatives.hard_negatives(more, more).collect())) == slow(rows, rows)


def test_large_components(spark):
    rows = [(1, 1, [5e5]), (2, 1, [5e5 + 3]), (3, 2, [4e5 + 0.3])]
    assert found(spark, rows, rows[:1]) == slow(rows, rows[:1])
    with pytest.raises(Exception, match="inner products may reach"):
        found(spark, [(1, 1, [1e9]), (2, 1, [1e9])], [(1, 1, [1e9])])
    with pytest.raises(Exception, match="a component times"):
        found(spark, [(1, 1, [1e30])], [(1, 1, [1.0])])


def test_the_walk_reads_cells_by_falling_bounds_and_stops():
    import pyarrow as pa

    rows = sample(4000, 8, 3, spread=0.1)
    weights = np.array([[math.floor(256 * x) for x in v] for _, _, v in rows])
    table = pa.table({
        "vec_id": [r[0] for r in rows], "label": pa.array([r[1] for r in rows], pa.int64()), "weights": weights.tolist(),
    })
    books = [np.unique(weights[::50, h], axis=0)[:16].astype(float) for h in negatives.halves(8)]
    shard = negatives.Shard(table, books, 8, np.float64)
    anchor = weights[0].astype(float)
    read, last = [], np.inf
    for at, bound in shard.walk(anchor):
        assert bound <= last
        last = bound
        read += at.tolist()
    assert sorted(read) == list(range(4000))

    class Counting:
        def __init__(self):
            self.n = 0

        def __getattr__(self, name):
            return getattr(shard, name)

        def walk(self, a):
            for at, bound in shard.walk(a):
                self.n += len(at)
                yield at, bound

    some = Counting()
    best = negatives.first_positives(some, rows[0][0], rows[0][1], anchor, 5)
    every = sorted((-int(weights[i] @ weights[0]), i) for i in range(1, 4000) if rows[i][1] == rows[0][1])[:5]
    assert [(-s, i) for s, i in zip(best.scores, best.ids)] == every and some.n < 4000
