"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are sparse rows: a term is a component's position, its weight the component turned
into an integer.  A block of candidates keeps a posting list per term.  A block of queries
meets it with an array of scores, one row a query and one column a candidate; term by term
the query weights are scattered over the term's postings into it.  Each pair of blocks keeps
its k best per query and Spark merges them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.llm.common import stored

K = 20
SCALE = 64
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 1024
QUERY_ROWS = 128
MOST_WEIGHT = 2.0**53


def quantised(vectors, scale=SCALE):
    """vec_id, weights: floor(scale * x) of each component, x as a double.

    Vectors that are null or hold a null, NaN or infinite component are left out, as are rows
    without an id, which no result could name; an empty vector has no terms and scores 0 with all.
    """
    usable = F.col("embedding").isNotNull() & F.expr(
        "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    weights = F.expr(f"transform(embedding, x -> floor({scale} * double(x)))")
    large = F.expr(f"exists(embedding, x -> abs({scale} * double(x)) >= {MOST_WEIGHT})")
    refused = F.raise_error(F.lit(f"a component times {scale} is {MOST_WEIGHT:.0f} or more"))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), F.when(large, refused).otherwise(weights).alias("weights")
    )


def matrix(column):
    """Rows of weights, shorter ones filled with zeros: a missing term weighs nothing."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def postings(weights):
    """Per term: the candidates that have it and their weights."""
    for term in range(weights.shape[1]):
        at = np.flatnonzero(weights[:, term])
        yield at, weights[at, term]


def accumulate(queries, lists, n):
    """Scores of a block of queries with n candidates, term at a time."""
    scores = np.zeros((len(queries), n), queries.dtype)
    buffer = np.empty_like(scores)
    for term, (at, weights) in enumerate(lists[: queries.shape[1]]):
        rows = np.flatnonzero(queries[:, term])
        if not len(rows) or not len(at):
            continue
        own = queries[rows, term][:, None]
        if 2 * len(at) > n and 2 * len(rows) > len(queries):
            # A long list is scattered once into a row and added as a whole.
            row = np.zeros(n, queries.dtype)
            row[at] = weights
            np.multiply(queries[:, term][:, None], row[None, :], out=buffer)
            scores += buffer
        else:
            scores[rows[:, None], at[None, :]] += own * weights[None, :]
    return scores


def best(scores, query_ids, ids, k):
    """(query row, candidate, score) of the k best per query; ids ascend, so earlier ones win ties."""
    n = len(ids)
    order = scores.astype(np.int64) * n + np.arange(n - 1, -1, -1)
    own = query_ids[:, None] == ids[None, :]
    lowest = np.iinfo(np.int64).min
    order[own] = lowest
    top = np.argpartition(order, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), order.shape)
    keep = np.take_along_axis(order, top, 1) > lowest
    rows = np.broadcast_to(np.arange(len(query_ids))[:, None], top.shape)[keep]
    return rows, top[keep], scores[rows, top[keep]]


def top_k(vectors, queries, k=K, scale=SCALE, candidate_block=CANDIDATE_BLOCK, query_block=QUERY_BLOCK):
    """query_id, rank, vec_id, score: the k candidates of highest inner product for each query.

    vectors: vec_id, embedding; queries: rows of the same shape, whose own row (equal vec_id)
    is no candidate of theirs.  Equal scores go to the smaller vec_id; fewer candidates: all.
    Each of several query rows of one vec_id ranks for itself, as does each candidate row.
    Rows that repeat a query's vec_id are its own and no candidates of it.  Scores must fit
    into 62 bits less those of the block size; vectors that may exceed that are refused.

    Both sides are cut into blocks by hash and each pair of blocks is one group, so a task
    holds two blocks and their scores, QUERY_ROWS queries at a time, whatever the input.
    """
    candidates = stored(quantised(vectors, scale), "candidates")
    asked = quantised(queries, scale)
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy("weights"))
    asked = stored(asked.withColumn("nth", number), "queries")
    size = (F.count("*"), F.max(F.size("weights")), F.max(F.array_max(F.transform("weights", F.abs))))
    n_candidates, width, large = (x or 0 for x in candidates.agg(*size).first())
    n_asked, width_asked, large_asked = (x or 0 for x in asked.agg(*size).first())
    most = float(large) * float(large_asked) * min(width, width_asked)
    # A score and a place in a block share 63 bits; blocks by hash may be somewhat larger.
    if most >= 2.0**62 / (4 * candidate_block):
        raise ValueError(f"inner products may reach {most:.3g}, of less than {2.0**62 / (4 * candidate_block):.3g}")
    n_blocks = max(1, -(-n_candidates // candidate_block))
    q_blocks = max(1, -(-n_asked // query_block))
    block = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", block(1, q_blocks)).withColumn("c", every(n_blocks))
    right = candidates.withColumn("c", block(2, n_blocks)).withColumn("q", every(q_blocks))

    def search(queries, rows):
        rows = rows.sort_by("vec_id")
        weights, asked = matrix(rows.column("weights")), matrix(queries.column("weights"))
        ids = rows.column("vec_id").to_numpy()
        query_ids = queries.column("vec_id").to_numpy()
        nth = queries.column("nth").to_numpy()
        width = max(1, min(weights.shape[1], asked.shape[1]))
        most = float(np.abs(weights).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width
        kind = np.int32 if most < 2**31 else np.int64
        lists = [(at, w.astype(kind)) for at, w in postings(weights)]
        out = []
        for i in range(0, len(query_ids) if len(ids) else 0, QUERY_ROWS):
            part = slice(i, i + QUERY_ROWS)
            scores = accumulate(asked[part].astype(kind), lists, len(ids))
            r, at, value = best(scores, query_ids[part], ids, k)
            out.append((query_ids[part][r], nth[part][r], ids[at], value.astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.array([], np.int64)] * 4
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "nth": pa.array(columns[1].astype(np.int32), pa.int32()),
                "vec_id": pa.array(columns[2], pa.int64()),
                "score": pa.array(columns[3], pa.int64()),
            }
        )

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(
        search, "query_id long, nth int, vec_id long, score long"
    )
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
