"""Hard negatives by an inverted multi-index, exact.

Vectors are cut into two halves, each with a codebook of its own; a pair of codes is a cell.
For an anchor each half's codes have an upper bound of the half's inner product: that with the
code's centre plus the anchor half's length times the code's radius.  A heap walks the pairs of
codes by falling sum of both bounds (the multi-sequence walk), reads the rows of a cell when it
comes up, and stops when no unread cell can change the answer: the window is certified.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.topk import matrix

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
CODES = 16
FIT_ROWS = 4096
FIT_ROUNDS = 8
SHARD_ROWS = 8192
ANCHOR_ROWS = 65_536
READ_ROWS = 256
# 100 times a score stays a long.
MOST_SCORE = 2.0**56


def quantised(rows, scale=SCALE):
    """vec_id, label, weights: floor(scale * x) of each component, x as a double.

    Rows with a null id, label or vector, or a null, NaN or infinite component, are left out.
    """
    usable = F.col("embedding").isNotNull() & F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    weights = F.expr(f"transform(embedding, x -> floor({scale} * double(x)))")
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    large = F.expr(f"exists(embedding, x -> abs({scale} * double(x)) >= {2.0**53})")
    refused = F.raise_error(F.lit(f"a component times {scale} is {2**53} or more"))
    return rows.where(known & usable).select(
        F.col("vec_id").cast("long"),
        F.col("label").cast("long").alias("label"),
        F.when(large, refused).otherwise(weights).alias("weights"),
    )


def widened(weights, dimensions):
    out = np.zeros((len(weights), dimensions), np.int64)
    out[:, : weights.shape[1]] = weights
    return out


def halves(dimensions):
    return slice(0, (dimensions + 1) // 2), slice((dimensions + 1) // 2, dimensions)


def nearest(points, centres):
    """The code of each point: the centre at the least distance, the first of equal ones."""
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def codebooks(rows, dimensions, codes=CODES, most_rows=FIT_ROWS, rounds=FIT_ROUNDS):
    """Centres of each half, fitted by k-means on at most most_rows rows chosen by hash.

    They decide only in which order rows are read, never which rows are found.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "weights").limit(most_rows).select("weights").toArrow()
    points = widened(matrix(sample.column("weights")), dimensions).astype(float)
    books = []
    for half in halves(dimensions):
        own = points[:, half]
        distinct = np.unique(own, axis=0) if len(own) else np.zeros((1, own.shape[1]))
        draw = np.random.default_rng(len(books)).permutation(len(distinct))[:codes]
        centres = distinct[np.sort(draw)]
        for _ in range(rounds):
            at = nearest(own, centres)
            for code in range(len(centres)):
                if (at == code).any():
                    centres[code] = own[at == code].mean(axis=0)
        books.append(centres)
    return books


class Shard:
    """Rows of a shard in the order of their cells, with the radius of each code of each half."""

    def __init__(self, table, books, dimensions, kind):
        weights = widened(matrix(table.column("weights")), dimensions)
        first, second = halves(dimensions)
        codes = [nearest(weights[:, h].astype(float), b) for h, b in zip((first, second), books)]
        cell = codes[0] * len(books[1]) + codes[1]
        ids = table.column("vec_id").to_numpy()
        order = np.lexsort((ids, cell))
        self.ids, self.weights = ids[order], weights[order].astype(kind)
        self.labels = table.column("label").to_numpy()[order]
        self.halves, self.centres, self.radii, self.used = (first, second), [], [], []
        for half, book, code in zip((first, second), books, codes):
            away = np.linalg.norm(weights[:, half] - book[code], axis=1)
            radius = np.full(len(book), -1.0)
            np.maximum.at(radius, code, away)
            # Codes without rows here are not walked.
            self.used.append(np.flatnonzero(radius >= 0))
            self.centres.append(book[self.used[-1]])
            self.radii.append(radius[self.used[-1]])
        edges = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.starts, self.ends, self.width = edges[:-1], edges[1:], len(books[1])

    def bounds(self, anchor):
        """Per half: codes by falling upper bound, and the bounds."""
        out = []
        for half, centres, radii in zip(self.halves, self.centres, self.radii):
            own = anchor[half].astype(float)
            bound = centres @ own + np.linalg.norm(own) * radii
            # More than rounding can take away; scores are whole numbers.
            bound += 1e-9 * (np.abs(bound) + np.linalg.norm(own) * (1 + radii))
            order = np.argsort(-bound, kind="stable")
            out.append((order, bound[order]))
        return out

    def walk(self, anchor):
        """(rows, bound): rows of the next cells, and the bound of all rows after them."""
        (one, a), (two, b) = self.bounds(anchor)
        if not len(a) or not len(b):
            return
        heap, rows = [(-(a[0] + b[0]), 0, 0)], []
        size = 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(b):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
            cell = self.used[0][one[i]] * self.width + self.used[1][two[j]]
            if self.starts[cell] < self.ends[cell]:
                rows.append(np.arange(self.starts[cell], self.ends[cell]))
                size += len(rows[-1])
            if size >= READ_ROWS or not heap:
                if rows:
                    yield np.concatenate(rows), -heap[0][0] if heap else -np.inf
                rows, size = [], 0


class Best:
    """The k best (score falling, id rising) of what was added."""

    def __init__(self, k):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores, ids):
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            top = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[top], ids[top]

    def certified(self, bound):
        """Nothing of at most this score would enter: equal scores could, by a smaller id."""
        return len(self.ids) == self.k and self.scores[-1] > bound


def first_positives(shard, anchor_id, label, anchor, k):
    """The k best other rows of the anchor's label in the shard."""
    best = Best(k)
    for rows, bound in shard.walk(anchor):
        rows = rows[(shard.labels[rows] == label) & (shard.ids[rows] != anchor_id)]
        best.add((shard.weights[rows] @ anchor).astype(np.int64), shard.ids[rows])
        if best.certified(bound):
            break
    return best


def first_negatives(shard, label, anchor, positive_scores, k, low, high):
    """Per positive: the k best rows of another label whose score is in its window."""
    found = [Best(k) for _ in positive_scores]
    open_ones = [i for i, s in enumerate(positive_scores) if low * s <= high * s]
    walk = shard.walk(anchor) if open_ones else ()
    for rows, bound in walk:
        rows = rows[shard.labels[rows] != label]
        scores, ids = (shard.weights[rows] @ anchor).astype(np.int64), shard.ids[rows]
        for i in open_ones:
            s = positive_scores[i]
            inside = (100 * scores >= low * s) & (100 * scores <= high * s)
            found[i].add(scores[inside], ids[inside])
        open_ones = [
            i for i in open_ones if not found[i].certified(bound) and 100 * bound >= low * positive_scores[i]
        ]
        if not open_ones:
            break
    return found


def hard_negatives(
    rows, anchors, positives=POSITIVES, negatives=NEGATIVES, low=LOW, high=HIGH, scale=SCALE,
    codes=CODES, shard_rows=SHARD_ROWS, anchor_rows=ANCHOR_ROWS,
):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: vec_id, label, embedding.  An anchor's positives are the `positives` best
    rows of its label; for each, its negatives are the `negatives` best rows of another label
    whose score, the inner product of whole-number weights with the anchor, is from low to high
    hundredths of the positive's.  Higher scores come first, then smaller ids.  Negative scores
    of positives have no window.

    Rows with a null id, label, vector or component, or one not finite, take no part.  Rows of
    the anchor's own id are the anchor, not its positives or negatives; other repeated rows
    each rank for themselves, and each of several anchors of an id for itself.  Shorter vectors
    end in zeros.  Empty tables give no rows.  Scores beyond 56 bits are refused.

    All rows are dealt to shards by hash, so copies of one vector are spread, and each block of
    anchors meets each shard in one task: first for the positives, then, their scores known,
    for the windows.  A task holds a shard and a block of anchors, whatever the input.
    """
    known = stored(quantised(rows, scale), "rows")
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "weights"))
    asked = stored(quantised(anchors, scale).withColumn("nth", number), "anchors")
    most = lambda t: t.agg(
        F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(0)),
        F.coalesce(F.max(F.array_max(F.transform("weights", F.abs))), F.lit(0)),
    ).first()
    (n, d, large), (n_asked, d_asked, large_asked) = most(known), most(asked)
    dimensions = max(d, d_asked, 2)
    largest = float(large) * float(large_asked) * dimensions
    if largest >= MOST_SCORE:
        raise ValueError(f"inner products may reach {largest:.3g}, of less than {MOST_SCORE:.3g}")
    # Whole numbers below 2^53 multiply and add exactly as doubles.
    kind = np.float64 if largest < 2.0**53 else np.int64
    books = codebooks(known, dimensions, codes)
    n_shards, n_blocks = max(1, -(-n // shard_rows)), max(1, -(-n_asked // anchor_rows))
    part = lambda salt, k: F.pmod(F.xxhash64("vec_id", "label", "weights", F.lit(salt)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Equal rows of one id would share a hash: their place among them deals them out too.
    spread = F.pmod(F.xxhash64("vec_id", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(n_shards))
    right = stored(known.withColumn("shard", spread.cast("int")), "shards")
    right = right.withColumn("block", every(n_blocks)).groupBy("block", "shard")
    blocked = asked.withColumn("block", part(1, n_blocks))

    def meet(left, search, kinds):
        def run(anchors, table):
            out = [[] for _ in kinds]
            if table.num_rows and anchors.num_rows:
                shard = Shard(table, books, dimensions, kind)
                weights = widened(matrix(anchors.column("weights")), dimensions).astype(kind)
                for row, anchor in zip(anchors.drop_columns(["weights"]).to_pylist(), weights):
                    for found in search(shard, row, anchor):
                        for column, value in zip(out, found):
                            column.append(value)
            return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(kinds, out)})

        left = left.withColumn("shard", every(n_shards)).groupBy("block", "shard")
        return left.cogroup(right).applyInArrow(run, ", ".join(f"{c} long" for c in kinds))

    def near(shard, row, anchor):
        best = first_positives(shard, row["vec_id"], row["label"], anchor, positives)
        return [(row["vec_id"], row["nth"], i, s) for i, s in zip(best.ids, best.scores)]

    def windows(shard, row, anchor):
        given = row["positives"]
        found = first_negatives(shard, row["label"], anchor, [p["score"] for p in given], negatives, low, high)
        return [
            (row["vec_id"], row["nth"], p["place"], p["positive_id"], p["score"], i, s)
            for p, best in zip(given, found)
            for i, s in zip(best.ids, best.scores)
        ]

    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("score"), "positive_id")
    pairs = meet(blocked, near, ("anchor_id", "nth", "positive_id", "score"))
    pairs = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    given = pairs.groupBy(F.col("anchor_id").alias("vec_id"), F.col("nth").cast("int").alias("nth")).agg(
        F.collect_list(F.struct("place", "positive_id", "score")).alias("positives")
    )
    with_windows = stored(blocked.join(given, ["vec_id", "nth"]), "windows")
    found = meet(
        with_windows, windows,
        ("anchor_id", "nth", "place", "positive_id", "positive_score", "negative_id", "negative_score"),
    )
    order = Window.partitionBy("anchor_id", "nth", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )
