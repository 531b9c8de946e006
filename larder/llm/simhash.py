"""Near copies by SimHash fingerprints, paired exactly through vantage-point trees.

A pair of fingerprints that differs in at most three bits differs in at most one bit in one
of its 32-bit halves.  Each half has a vantage-point tree: an inner node holds a vantage point
and a radius; halves within the radius go left, others right.  By the triangle inequality a
half with one bit of difference is at most one step nearer or farther, so a query visits the
other side only where its own distance is on the radius; all other branches are pruned.  The
leaves are the shards: each holds its own fingerprints as members, and as queries those of
other shards that the boundary lets in.  Every link within three bits is found in some shard.
"""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from larder.llm.common import one_of_each, stored
from larder.llm.components import components

SHINGLE = 3
MOST_BITS = 3
SAMPLE = 1 << 16
SHARD_ROWS = 1024
SLICE = 1 << 15

BITS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text, size=SHINGLE):
    """64-bit SimHash of a text as an int: see `fingerprints`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = (
        list(map(b" ".join, zip(*[words[i:] for i in range(size)])))
        if len(words) >= size
        else [b" ".join(words)]
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), SLICE):
        part = shingles[at : at + SLICE]
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in part), ">u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint64)
    return int((bits << BITS).sum(dtype=np.uint64))


def fingerprints(docs, size=SHINGLE):
    """doc_id, text_hash and the fingerprint (64 bits as a signed long), a row per row of docs.

    The text is lower-cased in A-Z and cut at white space (bytes.split cuts at the six ASCII
    ones); shingles of `size` words, repeats included, are hashed by XXH64 with seed 42.  A
    bit is set when it is set in over half the hashes.  Fewer words: one shingle of all; none
    or a null text: zero.  Each text is read whole, its hashes a slice at a time.
    """

    def run(batches):
        for batch in batches:
            values = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.array(values, np.uint64).view(np.int64)),
                ],
                ["doc_id", "text_hash", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, fingerprint long"
    )


def bits_between(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def build_tree(halves, rng, leaf, depth=0):
    """Nested (vantage, radius, left, right) over a bounded sample; None is a leaf."""
    if len(halves) <= leaf or depth > 40:
        return None
    best = None
    for _ in range(8):
        vantage = halves[rng.randrange(len(halves))] ^ np.uint64(rng.getrandbits(32) & rng.getrandbits(32))
        d = bits_between(halves, vantage)
        radius = int(np.median(d))
        for r in (radius - 1, radius):
            left = int((d <= r).sum())
            if 0 < left < len(d):
                # What both sides get, weighed by how evenly it splits.
                both = int(((d == r) | (d == r + 1)).sum())
                cost = max(left, len(d) - left) + both / 2
                if best is None or cost < best[0]:
                    best = cost, vantage, r
    if best is None:
        return None
    _, vantage, r = best
    d = bits_between(halves, vantage)
    return (
        vantage,
        r,
        build_tree(halves[d <= r], rng, leaf, depth + 1),
        build_tree(halves[d > r], rng, leaf, depth + 1),
    )


def route(tree, halves, slack):
    """(row, leaf number, member?) of each half: its own leaf and those within slack."""
    rows, leaves, members = [], [], []
    number = [0]

    def down(node, at, own):
        if node is None:
            rows.append(at)
            leaves.append(np.full(len(at), number[0], np.int32))
            members.append(own)
            number[0] += 1
            return
        vantage, radius, left, right = node
        d = bits_between(halves[at], vantage)
        go = d - slack <= radius
        down(left, at[go], own[go] & (d[go] <= radius))
        go = d + slack > radius
        down(right, at[go], own[go] & (d[go] > radius))

    down(tree, np.arange(len(halves)), np.ones(len(halves), bool))
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(members)


def linked(prints, members, most):
    """A spanning forest of the links between prints, at least one end of each a member.

    Visits a print, links all it reaches among those not yet reached and goes on from them,
    so a dense group costs its size times what stays outside, and emits a link per print.
    Returns pairs of positions.
    """
    pairs = []
    inside, outside = np.flatnonzero(members), np.flatnonzero(~members)

    def reached(at, left):
        near = bits_between(prints[left], prints[at]) <= most
        if not near.any():
            return left, []
        found = left[near]
        pairs.extend((at, f) for f in found)
        return left[~near], found.tolist()

    while len(inside):
        queue, inside = [inside[0]], inside[1:]
        while queue:
            at = queue.pop()
            inside, found = reached(at, inside)
            queue += found
            if members[at]:
                outside, found = reached(at, outside)
                queue += found
    return pairs


def near_pairs(prints, most=MOST_BITS, sample=SAMPLE, shard_rows=SHARD_ROWS):
    """Links (a, b) between distinct fingerprints at most `most` (3 or fewer) bits apart.

    prints: one column `fingerprint`, distinct.  Not all pairs: a spanning forest of each
    shard, so that everything linked is connected.  The trees are built from at most `sample`
    fingerprints, chosen by hash; their depth follows the number of fingerprints.
    """
    if not 0 <= most <= 3:
        raise ValueError("a half may differ in one bit at most, so most is 3 at most")
    spark = prints.sparkSession
    count = prints.count()
    chosen = prints.orderBy(F.xxhash64("fingerprint"), "fingerprint").limit(sample)
    values = np.array([r[0] for r in chosen.collect()], np.int64).view(np.uint64)
    leaf = max(1, len(values) * shard_rows // max(count, 1))
    rng = random.Random(7)
    trees = [
        build_tree(np.unique(half), rng, leaf)
        for half in (values >> np.uint64(32), values & np.uint64(0xFFFFFFFF))
    ]

    def spread(batches):
        for batch in batches:
            own = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            bits = own.view(np.uint64)
            for side, half in enumerate((bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))):
                rows, leaves, members = route(trees[side], half, most // 2)
                for i in range(0, len(rows), 50_000):
                    at = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows[at]), side, np.int32)),
                            pa.array(leaves[at]),
                            pa.array(own[rows[at]]),
                            pa.array(members[at]),
                        ],
                        ["side", "leaf", "fingerprint", "member"],
                    )

    def match(table):
        prints = table.column("fingerprint").to_numpy().astype(np.int64)
        pairs = linked(
            prints.view(np.uint64), table.column("member").to_numpy(), most
        )
        a = np.array([p[0] for p in pairs], np.int64)
        b = np.array([p[1] for p in pairs], np.int64)
        return pa.table({"a": prints[a], "b": prints[b]})

    shards = prints.mapInArrow(spread, "side int, leaf int, fingerprint long, member boolean")
    return shards.groupBy("side", "leaf").applyInArrow(match, "a long, b long")


def components_of(docs, size=SHINGLE, most=MOST_BITS):
    """Per row of docs: doc_id, text_hash, fingerprint, component_id, component (never null).

    component_id is the smallest doc_id that links of at most `most` bits reach.  Equal
    fingerprints are one class and are never expanded into pairs.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    pairs = near_pairs(classes.select("fingerprint"), most)
    ends = components(pairs)
    # The smallest doc_id of a component, over its classes.
    grouped = classes.join(ends, F.col("fingerprint") == F.col("node"), "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    known = grouped.join(smallest, "root").select("fingerprint", "component_id", F.col("root").alias("component"))
    return prints.join(known, "fingerprint").select(
        "doc_id", "text_hash", "fingerprint", "component_id", "component"
    )


def near_duplicates(docs, **options):
    """Per row of docs: doc_id, fingerprint (long), component_id, see `components_of`.

    Rows of one doc_id count each for itself; a class of null ids only has a null component.
    Empty tables give none.
    """
    return components_of(docs, **options).select("doc_id", "fingerprint", "component_id")


def first_of_each(docs, **options):
    """docs with one row of each component: the smallest doc_id, null last, then text_hash."""
    found = components_of(docs, **options).select("doc_id", "text_hash", "component")
    return one_of_each(docs, found)
