"""Near copies by their shingles: an exact set-similarity join, for the pipeline's stage.

A text is a set of five-word shingles, and two texts with a Jaccard of 0.8 or more are linked.
Shingles have one order for all texts, the frequent ones last.  Similar sets then share
at least `least_shared` shingles among the first `prefix_size` of each, their sizes differ
by a fifth at most, and so many of their sketches' bits are equal that the sets can be similar;
every pair that passes is verified on the whole sets.  (Fingerprints
cannot promise this: pairs with a Jaccard of 0.8 are up to a dozen and more of 64 bits apart,
and within such a radius a metric tree hardly prunes.)

Equal sets are one class and never become pairs.  Rounds of leaders, a few drawn anew for each
shingle, first link each class with the leader it shares most with, if that is enough; that joins
nearly all of a dense group.  Then every two
classes that pass the filters and are not yet connected are compared, so no link that would
join two components is lost and dense groups are not expanded into all pairs.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from larder.llm.common import one_of_each, small_batches, stored
from larder.llm.components import components
from larder.operators.sizes import broadcast_if_small

SIZE = 5
# Similar: at least 4 of 5 shingles of the union are shared.
SHARED, OF = 4, 5
LEADER_ROUNDS = 2
# So many leaders for each shingle and round.
LEADERS = 4
# Longs of a sketch; it tells sets of up to about 64 * SKETCH / 4 shingles apart.
SKETCH = 8
BUCKETS = 1 << 22
PART = 1 << 12
PART_ROWS = 64
MEMO = 100_000
TEXT_ROWS = 1024
PAIR_ROWS = 128
LEADER_SHINGLES = 1 << 20
FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


class Words(dict):
    """XXH64 of distinct words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_hashes(text, memo):
    """64-bit hashes of a text's shingles, repeats included.

    Words as for fingerprints: lower-cased in A-Z, cut at ASCII white space.  Fewer than five
    are one shingle of all; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(SIZE, len(own))
    if not size:
        return own
    count = len(own) - size + 1
    h = np.full(count, size, np.uint64)
    for i in range(size):
        h += own[i : i + count] * FACTORS[i]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def shingle_set(text, memo):
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, memo))


def sketch_of(own):
    """SKETCH longs: bit j says whether an odd number of the set's hashes fall on it.

    Sketches of two sets differ in no more bits than there are shingles in one set alone.
    """
    odd = np.bincount((own % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_shared(n):
    """How many prefix shingles a set of n shares with any similar set of at least n."""
    return 1 + n // 20


def prefix_size(n):
    """How many of n shingles hold least_shared(n) of those that a similar set must share."""
    return n - (SHARED * n + OF - 1) // OF + least_shared(n)


def rarity(docs):
    """How often shingles of each hash bucket occur in all documents, as one array of fixed size.

    Any order of shingles gives exact results; this one keeps frequent passages out of prefixes.
    Each task adds up what it has read, and the sums are added part by part of the array.
    """

    def count(batches):
        memo, counts = Words(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, (shingle_hashes(text, memo) % np.uint64(BUCKETS)).astype(np.int64), 1)
        for first in range(0, BUCKETS, PART):
            own = counts[first : first + PART]
            if own.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first // PART], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())],
                    ["part", "counts"],
                )

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[part] = sums[part] + own if part in sums else own
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["part", "counts"]
            )

    spark, kind = docs.sparkSession, "part int, counts binary"
    with small_batches(spark, TEXT_ROWS):
        parts = stored(docs.select("text").mapInArrow(count, kind), "counts")
    with small_batches(spark, PART_ROWS):
        sums = parts.repartition("part").mapInArrow(add, kind).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    for part, counts in zip(sums.column("part").to_pylist(), sums.column("counts").to_pylist()):
        out[part * PART : (part + 1) * PART] = np.frombuffer(counts, np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefixes(docs, counts):
    """doc_id, text_hash, n (shingles), key and sketch (of the set) and prefix of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def prefix(own):
        often = shared.value[(own % np.uint64(BUCKETS)).astype(np.int64)]
        return own[np.argsort(often, kind="stable")[: prefix_size(len(own))]]

    def run(batches):
        memo = Words()
        for batch in batches:
            sizes, keys, sketches, firsts = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, memo)
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketches.append(sketch_of(own))
                firsts.append(prefix(own).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int32()),
                    pa.array(keys, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n", "key", "sketch", "prefix"],
            )

    return _keyed(docs).mapInArrow(
        run, "doc_id long, text_hash long, n int, key binary, sketch array<long>, prefix array<long>"
    )


def _keyed(docs):
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def verified(docs, classes, pairs):
    """The pairs (a, b) of class ids whose whole sets are similar.

    The texts move, once by class and once to the other end of their pairs, and become sets
    where they meet: sets of 64-bit hashes are larger than texts and do not compress.
    """
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = stored(
        classes.join(ends, "id", "left_semi").select(
            "id", F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")
        ),
        "wanted",
    )
    texts = _keyed(docs)
    same = texts.doc_id.eqNullSafe(F.col("_doc")) & (texts.text_hash == F.col("_hash"))

    def similar(batches):
        memo, leaders, held = Words(), {}, 0
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))
            for a, text, other in zip(*columns):
                x = leaders.get(a)
                if x is None:
                    if held > LEADER_SHINGLES:
                        leaders, held = {}, 0
                    x = leaders[a] = shingle_set(text, memo)
                    held += len(x)
                y = shingle_set(other, memo)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * both >= SHARED * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = texts.join(broadcast_if_small(wanted), same).select("id", "text").dropDuplicates(["id"])
    first = known.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    second = known.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
    with small_batches(docs.sparkSession, PAIR_ROWS):
        return stored(both.mapInArrow(similar, "a long, b long"), "verified")


def _fits(n, other):
    """Whether sets of n and other shingles can be similar by their sizes."""
    return F.least(n, other) * OF >= F.greatest(n, other) * SHARED


def _near():
    """Whether sets of n and o_n shingles can be similar by their sketches, s0... and o_s0...

    Similar sets differ in no more than (OF - SHARED) / (OF + SHARED) of n + o_n shingles.
    """
    differ = sum(F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"o_s{i}"))) for i in range(SKETCH))
    return differ * (OF + SHARED) <= (F.col("n") + F.col("o_n")) * (OF - SHARED)


def similar_roots(docs, classes):
    """id, root of the classes that are linked to others; root is the smallest id reached.

    classes: id, doc_id and text_hash of one of its rows, n, sketch, prefix.
    """
    bits = [f"s{i}" for i in range(SKETCH)]
    sketches = classes.select("id", *[F.col("sketch")[i].alias(s) for i, s in enumerate(bits)])
    rows = classes.select("id", "n", F.explode("prefix").alias("shingle"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("_held")).where("_held > 1").select("shingle")
    rows = stored(rows.join(held, "shingle").select("id", "n", "shingle"), "rows")
    links = roots = None
    for number in range(LEADER_ROUNDS + 1):
        if roots is None:
            rooted = rows.withColumn("root", F.col("id"))
        else:
            rooted = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
            mixed = rooted.groupBy("shingle").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
            rooted = rooted.join(mixed.where("_lo < _hi").select("shingle"), "shingle", "left_semi")
        rooted = rooted.join(sketches, "id")
        own = rooted.select(F.col("id").alias("b"), "n", "shingle", "root", *bits)
        if number < LEADER_ROUNDS:
            # Drawn anew in each round: a leader that is similar to few is not asked again.
            draw = F.xxhash64("id", F.lit(number))
            first = F.min(F.struct(draw.alias("draw"), "root", "id", "n", *bits))
            heads = rooted.groupBy("shingle", F.pmod(draw, F.lit(LEADERS)).alias("seat")).agg(first.alias("o"))
            others, apart = heads.select("shingle", "o.*"), F.col("o_root") != F.col("root")
        else:
            others, apart = rooted, F.col("o_root") < F.col("root")
        others = others.select(
            F.col("shingle").alias("o_shingle"), F.col("root").alias("o_root"), F.col("id").alias("a"),
            F.col("n").alias("o_n"), *[F.col(s).alias(f"o_{s}") for s in bits],
        )
        met = own.join(
            others, (own["shingle"] == others["o_shingle"]) & apart & _fits(F.col("n"), F.col("o_n")) & _near()
        )
        counted = met.groupBy("a", "b").agg(F.count("*").alias("_met"), F.min(F.least("n", "o_n")).alias("_n"))
        counted = counted.where(F.col("_met") >= 1 + F.floor(F.col("_n") / 20))
        if number < LEADER_ROUNDS:
            best = counted.groupBy("b").agg(F.max(F.struct("_met", (-F.col("a")).alias("_a"))).alias("x"))
            pairs = best.select((-F.col("x._a")).alias("a"), "b")
        else:
            pairs = counted.select("a", "b")
        found = verified(docs, classes, stored(pairs, "pairs"))
        links = found if links is None else links.union(found)
        if number == LEADER_ROUNDS or found.count():
            roots = stored(components(links).select(F.col("node").alias("id"), "root"), "roots")
    return roots


def similar_documents(docs):
    """Per row of docs: doc_id, text_hash, component (rows that links reach have the same)."""
    counts = rarity(docs)
    with small_batches(docs.sparkSession, TEXT_ROWS):
        rows = stored(prefixes(docs, counts), "prefixes")
    first = F.min(F.struct("doc_id", "text_hash", "n", "sketch", "prefix")).alias("first")
    classes = rows.groupBy("key").agg(first).select("key", "first.*")
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    roots = similar_roots(docs, classes)
    known = classes.select("key", "id").join(roots, "id", "left").select(
        "key", F.coalesce("root", "id").alias("component")
    )
    return rows.select("doc_id", "text_hash", "key").join(known, "key").select("doc_id", "text_hash", "component")


def first_of_each(docs):
    """docs with one row of each component: the smallest doc_id, null last, then text_hash."""
    return one_of_each(docs, similar_documents(docs))
