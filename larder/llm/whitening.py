"""Embedding whitening with components from contour integration (FEAST).

The tasks read all vectors: exact sums, then products of centred rows.  What reaches the
driver is one matrix, dimensions by dimensions.  There a rational filter, the quadrature of
complex shifted solves around an interval of eigenvalues, is applied to a block of vectors;
Rayleigh-Ritz in the filtered block gives the components of the interval.  The inertia of the
matrix shifted to the interval's ends says how many eigenvalues lie inside, so none is missed.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.topk import matrix

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
NODES = 12
MOST_DIMENSIONS = 4096
MOST_VALUE = 2.0**40
# Eigenvalues below this share of the largest are rounding of zero: nothing varies along them.
NOTHING = 1e-13


def quantised(vectors, scale=SCALE, shift=SHIFT):
    """vec_id, x: floor(scale * c) + shift of each component c, as a double.

    Vectors that are null or hold a null, NaN or infinite component are left out.
    """
    usable = F.col("embedding").isNotNull() & F.expr(
        "forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))"
    )
    x = F.expr(f"transform(embedding, c -> floor({scale} * double(c)) + {shift}L)")
    large = F.expr(f"exists(embedding, c -> abs({scale} * double(c)) >= {MOST_VALUE})")
    # The arithmetic below is exact up to this size; a larger component is refused, not wrapped.
    refused = F.raise_error(F.lit(f"a component times {scale} is {MOST_VALUE:.0f} or more"))
    return vectors.where(usable).select(F.col("vec_id").cast("long"), F.when(large, refused).otherwise(x).alias("x"))


def per_task(rows, start, add):
    """rows reduced by each task to one array, the arrays summed: place, value (as double or decimal).

    start() gives a task's array and add(array, batch) the next one; Spark sums them place by
    place, so as many rows as the array has places come from each task.
    """

    def run(batches):
        total = start()
        for batch in batches:
            if batch.num_rows:
                total = add(total, batch)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(flat)})

    kind = "long" if start().dtype == np.int64 else "double"
    found = rows.mapInArrow(run, f"place int, value {kind}")
    value = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    summed = found.groupBy("place").agg(F.sum(value).alias("value")).orderBy("place")
    return [r.value for r in summed.collect()]


def wide(column, dimensions):
    """Rows of x; a shorter vector's missing components count as SHIFT (a component of 0)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(column), dimensions), SHIFT, np.int64)
    given = matrix(column)
    out[:, : given.shape[1]] = np.where(np.arange(given.shape[1]) < lengths[:, None], given, SHIFT)
    return out


def covariance(rows, n, dimensions):
    """(sums, covariance) of the rows' x: exact sums, products of centred rows, divisor n."""
    step = 4096

    def add_sums(total, batch):
        return total + wide(batch.column("x"), dimensions).sum(axis=0)

    sums = [int(s) for s in per_task(rows, lambda: np.zeros(dimensions, np.int64), add_sums)]
    base, rest = centre(sums, n)

    def add_products(total, batch):
        for i in range(0, batch.num_rows, step):
            d = wide(batch.column("x").slice(i, step), dimensions) - base - rest
            total = total + d.T @ d
        return total

    products = per_task(rows, lambda: np.zeros((dimensions, dimensions)), add_products)
    v = np.array(products).reshape(dimensions, dimensions) / n
    return sums, (v + v.T) / 2


def centre(sums, n):
    """The mean as a whole part and the rest, so that x - mean is rounded once."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return base, rest


def tridiagonal(v):
    """Diagonal and squared off-diagonal of an orthogonally similar tridiagonal matrix."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def above(tri, shift):
    """How many eigenvalues exceed shift: the positive pivots of the shifted matrix (its inertia)."""
    diagonal, off = tri
    tiny = np.finfo(float).eps * max(1e-300, float(np.abs(diagonal).max(initial=0)))
    count, pivot = 0, 1.0
    for i, x in enumerate(diagonal):
        pivot = x - shift - (off[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def interval(tri, k, top):
    """(low, count): a lower end with at least k eigenvalues above it, in a gap if there is one."""
    d = len(tri[0])
    if k >= d:
        return -0.01 * top, d
    low, high = 0.0, top * 1.01
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if above(tri, middle) >= k else (low, middle)
    # low is the k-th eigenvalue from below; the end moves down into the widest of some near gaps.
    ends = [low - top * g for g in (1e-12, 1e-10, 1e-8, 1e-6, 1e-5, 1e-4, 3e-4, 1e-3, 3e-3, 1e-2)]
    count = above(tri, ends[0])
    best = ends[0]
    for end in ends[1:]:
        if above(tri, end) != count:
            break
        best = (low + end) / 2
    return best, above(tri, best)


def filtered(v, low, high, block, nodes=NODES):
    """block projected on the eigenvectors in (low, high): quadrature of (zI - V)^-1 on a circle."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    eye, total = np.eye(len(v)), np.zeros_like(block)
    for t, w in zip(points, weights):
        # Half of the circle: the other half gives the conjugate.
        turn = np.exp(1j * np.pi * (1 + t) / 2)
        solved = np.linalg.solve((middle + radius * turn) * eye - v, block.astype(complex))
        total += w / 2 * (radius * turn * solved).real
    return total


def eigenpairs(v, k, rounds=40):
    """The k largest eigenvalues above rounding, falling, and unit eigenvectors as columns.

    Each eigenvector's largest entry is positive.  Equal eigenvalues share a subspace, of
    which some orthonormal basis is returned.
    """
    d = len(v)
    top = float(np.trace(v))
    if not d or top <= 0:
        return np.zeros(0), np.zeros((d, 0))
    scaled = v / top
    tri = tridiagonal(scaled)
    wanted = min(k, above(tri, NOTHING))
    low, count = interval(tri, wanted, 1.0)
    size = min(d, max(2 * count, count + 8))
    while True:
        block = np.random.default_rng(1).standard_normal((d, size))
        for _ in range(rounds):
            q, _ = np.linalg.qr(filtered(scaled, low, 1.01, block))
            values, turn = np.linalg.eigh(q.T @ scaled @ q)
            block = q @ turn
            inside = values > low
            left = np.linalg.norm(scaled @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and left.max(initial=0) <= 8 * np.finfo(float).eps * np.sqrt(d):
                break
        # The inertia is the proof: as many components inside as eigenvalues.
        if inside.sum() == count:
            break
        if size == d:
            raise RuntimeError(f"{inside.sum()} components found of {count} in the interval")
        size = min(d, 2 * size)
    order = np.argsort(-values[inside], kind="stable")[:wanted]
    vectors = block[:, inside][:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[inside][order] * top, vectors * signs


def whiten(vectors, components=COMPONENTS):
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components are the unit eigenvectors of the covariance of all usable rows' x, numbered
    from 1 by falling eigenvalue; whitened is x less the mean, projected on the component, over
    the root of its eigenvalue; explained its share of the trace; deviation the exact sum of
    (n * x - sum)^2; identity_error the largest entry by which the covariance of whitened
    differs from the identity.

    Shorter vectors count as ending in components of 0.  Directions without variance (at most
    1e-13 of the trace) are no components, so equal vectors, one vector or empty ones give no
    rows, as does an empty table.  Repeated ids and null ids stay rows of their own.  A
    deviation beyond 63 bits is null.  Components of 2^30 and beyond, or more than 4096 of
    them in a vector, are refused.
    """
    rows = stored(quantised(vectors), "vectors")
    n, dimensions = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {dimensions} components, of at most {MOST_DIMENSIONS}")
    sums, v = covariance(rows, n, dimensions) if n and dimensions else ([], np.zeros((0, 0)))
    values, found = eigenpairs(v, components)
    base, rest = centre(sums, max(n, 1))
    left = np.array([s % n for s in sums], object)
    project = found / np.sqrt(values)

    def run(batches):
        for batch in batches:
            x = wide(batch.column("x"), dimensions) - base
            far = float(np.abs(x).max(initial=0)) + 1
            exact = np.int64 if (n * far) ** 2 * dimensions < 2.0**62 else object
            deviation = ((x.astype(exact) * n - left.astype(exact)) ** 2).sum(axis=1)
            deviation = [int(s) if s < 2**63 else None for s in deviation]
            out = (x - rest) @ project
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(deviation, pa.int64()),
                    pa.array(list(out), pa.list_(pa.float64())),
                ],
                ["vec_id", "deviation", "w"],
            )

    # One array a row: the components of a vector are computed together and stored once.
    white = stored(rows.mapInArrow(run, "vec_id long, deviation long, w array<double>"), "whitened")
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values]).cast("array<double>")
    return white.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(identity_error(white, len(values))).cast("double").alias("identity_error"),
    )


def identity_error(white, k):
    """Largest absolute entry of the covariance of the arrays w, centred, less the identity; null without any."""
    if not k:
        return None
    w = [F.get("w", F.lit(i)) for i in range(k)]
    means = white.agg(*[F.avg(x) for x in w]).first()
    d = [x - F.lit(m) for x, m in zip(w, means)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    found = white.agg(*[F.avg(d[i] * d[j]) for i, j in pairs]).first()
    return float(max(abs(x - (i == j)) for x, (i, j) in zip(found, pairs)))
