"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training texts, quantised to levels that
grow as a logarithm (small counts are exact), and put into a Bloom filter: an n-gram of level q
is entered q times, as (n-gram, 1) to (n-gram, q).  A count is read by probing (n-gram, 1),
(n-gram, 2), ... until one is missing.  The filter is in parts, one for each range of hashes;
parts are broadcast as many at a time as stay below SEGMENT_BYTES, and each further lot is
another pass over the texts that fills in what it knows.

The model is a pair model smoothed towards single words (a Dirichlet prior):
p(w | v) = (c(v w) + m p(w)) / (c(v) + m), p(w) = (c(w) + 1) / (N + V + 1), every c read from
the filter.  The strength m is that of STRENGTHS which makes all training texts likeliest when
each token is left out of its own counts.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from larder.llm.common import small_batches, stored

GROWTH = 1.25
BITS = 4
BITS_AN_ENTRY = 11
STRENGTHS = tuple(4.0**i for i in range(-1, 9))
SEGMENT_BYTES = 192 << 20
HEAD_WORDS = 1 << 19
BUCKET_BYTES = 4 << 20
FLUSH_TOKENS = 1 << 21
CHUNK_TOKENS = 1 << 16
BATCH_ROWS = 512
MEMO, MEMO_BYTES = 100_000, 8 << 20


def _thresholds():
    """The least count of each level: 1, 2, 3, ... then each larger by GROWTH."""
    out = [1]
    while out[-1] < 1 << 61:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * GROWTH))))
    return np.array(out, np.int64)


LEAST = _thresholds()
# The value read for a level: the middle of its counts; 0 for none.
VALUE = np.concatenate(([0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, LEAST[-1:]))


def level(counts):
    return np.searchsorted(LEAST, counts, side="right")


# No word holds white space, so these are the hashes of no word.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\t", b"\n"))


def mixed(x):
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(before, word):
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


class Vocabulary(dict):
    """Numbers of the words met, and columns with what is known of each: its hash, then facts of the hash.

    It starts anew once it holds MEMO words or MEMO_BYTES of them, so texts of ever new words
    do not fill a worker.
    """

    def __init__(self, *facts):
        self.facts = (lambda hashes: hashes, *facts)
        self.reset()

    def reset(self):
        self.clear()
        self.new, self.bytes = [], 0
        self.columns = [fact(np.zeros(0, np.uint64)) for fact in self.facts]

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        self.bytes += len(word)
        return number

    def tokens(self, texts):
        """(numbers of all tokens end to end, tokens of each text): words, A-Z lower-cased, then one end."""
        if len(self) > MEMO or self.bytes > MEMO_BYTES:
            self.reset()
        words, sizes = [], []
        for text in texts:
            # Bytes lower and split by ASCII alone, which are the letters and separators meant.
            own = (text or b"").lower().split()
            own.append(b"\n")
            words += own
            sizes.append(len(own))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.new), np.uint64, len(self.new))
            self.columns = [np.concatenate((c, fact(hashes))) for c, fact in zip(self.columns, self.facts)]
            self.new = []
        return numbers, np.array(sizes, np.int64)


def before_each(flat, sizes):
    """The token before each, START at a text's first."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[np.cumsum(sizes) - sizes] = START
    return out


def chunks(batch, most=CHUNK_TOKENS):
    """Slices of a batch's rows of at most about `most` words each; a longer text is one alone."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"") // 4 + 1
        if size >= most or i + 1 == len(texts):
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def summed(hashes, counts):
    """Distinct hashes, rising, and the sums of their counts."""
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate((hashes[:1] == hashes[:1], hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def bucket_of(hashes, bits):
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def gathered(docs, bits):
    """Counts by task: kind (1 words, 2 pairs), bucket, and the hashes and counts as bytes.

    A task sums what it has read every FLUSH_TOKENS tokens, so a frequent word is one entry
    of it then, however often it occurs.
    """

    def run(batches):
        memo, pending, size = Vocabulary(), ([], []), 0

        def flush():
            for kind, parts in enumerate(pending, 1):
                hashes, counts = np.unique(np.concatenate(parts), return_counts=True)
                edges = np.searchsorted(bucket_of(hashes, bits), np.arange((1 << bits) + 1))
                rows = [(b, edges[b], edges[b + 1]) for b in range(1 << bits) if edges[b] < edges[b + 1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array([kind] * len(rows), pa.int32()),
                        "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                        "hashes": pa.array([hashes[i:j].tobytes() for _, i, j in rows], pa.binary()),
                        "counts": pa.array([counts[i:j].astype("<i8").tobytes() for _, i, j in rows], pa.binary()),
                    }
                )
                parts.clear()

        for batch in batches:
            for _, texts in chunks(batch):
                numbers, sizes = memo.tokens(texts)
                flat = memo.columns[0][numbers]
                pending[0].append(flat)
                pending[0].append(np.full(len(sizes), START))
                pending[1].append(pair_hash(before_each(flat, sizes), flat))
                size += len(flat)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return docs.mapInArrow(run, "kind int, bucket int, hashes binary, counts binary")


def probes(hashes, at_level, sizes):
    """(place, bits) of (hash, level) in parts of the given sizes: one 64-bit word holds all its bits."""
    g = mixed(hashes + np.uint64(0xD6E8FEB86659FD93 * at_level % (1 << 64)))
    place = ((g >> np.uint64(32)) * sizes) >> np.uint64(32)
    return place.astype(np.int64), [(g >> np.uint64(6 * j)) & np.uint64(63) for j in range(BITS)]


def filter_part(hashes, counts):
    """A Bloom filter, as 64-bit words in bytes, of the levels of the counts."""
    levels = level(counts)
    size = max(1, -(-int(levels.sum()) * BITS_AN_ENTRY // 64))
    bits = np.zeros(size * 64, bool)
    for at in range(1, int(levels.max(initial=0)) + 1):
        hashes, levels = hashes[levels >= at], levels[levels >= at]
        place, own = probes(hashes, at, np.uint64(size))
        for bit in own:
            bits[place * 64 + bit.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def counted(docs, bits):
    """Per bucket: filters of words and pairs, exact word counts, tokens, distinct words, words by level.

    A bucket holds the hashes of one range; each task's share of it is summed already, and
    hashes are even, so no word or pair makes a bucket large.
    """

    def run(table):
        found = {}
        kinds = table.column("kind").to_numpy()
        for kind in (1, 2):
            own = table.filter(pa.array(kinds == kind))
            joined = [b"".join(own.column(c).to_pylist()) for c in ("hashes", "counts")]
            found[kind] = summed(np.frombuffer(joined[0], "<u8"), np.frombuffer(joined[1], "<i8"))
        words, counts = found[1]
        real = words != START
        by_level = np.bincount(level(counts[real]), minlength=1).astype(np.int64)
        row = {
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
            "word_filter": pa.array([filter_part(*found[1])], pa.binary()),
            "pair_filter": pa.array([filter_part(*found[2])], pa.binary()),
            "words": pa.array([words[real].view(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([counts[real]], pa.list_(pa.int64())),
            "tokens": pa.array([int(counts[real].sum())], pa.int64()),
            "by_level": pa.array([by_level], pa.list_(pa.int64())),
        }
        return pa.table(row)

    kinds = (
        "bucket int, word_filter binary, pair_filter binary, words array<long>, counts array<long>,"
        " tokens long, by_level array<long>"
    )
    return gathered(docs, bits).groupBy("bucket").applyInArrow(run, kinds)


class Filter:
    """Parts of a filter, end to end; those of other buckets are empty."""

    def __init__(self, lengths, bits):
        """lengths: bytes of each bucket's part."""
        self.bits = bits
        own = np.zeros(1 << bits, np.int64)
        for bucket, length in lengths:
            own[bucket] = length // 8
        self.starts = np.concatenate(([0], np.cumsum(own)))
        self.sizes = own.astype(np.uint64)
        self.data = np.zeros(int(self.starts[-1]), np.uint64)

    def put(self, bucket, data):
        at = self.starts[bucket]
        self.data[at : at + len(data) // 8] = np.frombuffer(data, "<u8")

    def levels(self, hashes):
        """The level read for each hash: probes with rising levels until one is missing."""
        out = np.zeros(len(hashes), np.uint8)
        bucket = bucket_of(hashes, self.bits)
        alive = np.flatnonzero(self.sizes[bucket])
        hashes, sizes, starts = hashes[alive], self.sizes[bucket[alive]], self.starts[bucket[alive]]
        at = 0
        while len(alive) and at < len(LEAST):
            at += 1
            place, bits = probes(hashes, at, sizes)
            word = self.data[starts + place]
            hit = word >> bits[0]
            for bit in bits[1:]:
                hit &= word >> bit
            hit = (hit & np.uint64(1)).astype(bool)
            alive, hashes, sizes, starts = alive[hit], hashes[hit], sizes[hit], starts[hit]
            out[alive] = at
        return out


def likelihoods(of_word, of_pair, of_start, sizes, total, held_out):
    """By text and strength log10 probabilities, and by strength the sum over the texts not held
    out with each token left out of its counts.

    A token's probability follows from three levels, so it is computed once for each triple.
    """
    first = np.cumsum(sizes) - sizes
    of_before = np.empty_like(of_word)
    of_before[1:] = of_word[:-1]
    of_before[first] = of_start
    triple = (of_word.astype(np.int32) << 16) | (of_pair.astype(np.int32) << 8) | of_before
    triples, at = np.unique(triple, return_inverse=True)
    word, pair, before = VALUE[triples >> 16], VALUE[triples >> 8 & 255], VALUE[triples & 255]
    # Both levels are read apart; a pair is never seen more often than what it begins with.
    pair = np.minimum(pair, before)
    learnt = np.bincount(at, np.repeat(~held_out, sizes), len(triples))
    plain, left_out = [], []
    for m in STRENGTHS:
        p = np.log10((pair + m * (word + 1) / total) / (before + m))
        plain.append(np.add.reduceat(p[at], first))
        less = np.maximum(pair - 1, 0) + m * (np.maximum(word - 1, 0) + 1) / total
        left_out.append(float(learnt @ np.log10(less / (np.maximum(before - 1, 0) + m))))
    return np.stack(plain, 1), left_out


def segments(parts, most=SEGMENT_BYTES):
    """Lots of parts (bucket, bytes of words, of pairs), each of at most `most` bytes, or one part."""
    out, size = [[]], 0
    for part in parts:
        own = part[1] + part[2]
        if out[-1] and size + own > most:
            out.append([])
            size = 0
        out[-1].append(part)
        size += own
    return out


def score(docs, most_bytes=SEGMENT_BYTES, head_words=HEAD_WORDS, bucket_bytes=BUCKET_BYTES):
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs: doc_id, text; other columns are left out.  Rows whose id, as text, has a crc32 that
    leaves 2 when divided by 7 are held out of the counts; a null id is not held out.  A null
    or empty text is one end token.  Repeated rows are rows of their own, counted and scored
    each.  With no training rows at all every score is 0; an empty table gives no rows.

    base_score adds log10((c + 1) / (N + V + 1)) over the tokens, with exact counts c: those of
    the head_words most frequent words (by levels) go to the tasks, all others are joined.
    Words count by 64-bit hash.  score is the model's, read from the filter alone.
    """
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    training = docs.where("not held_out").select("text")
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    with small_batches(spark, BATCH_ROWS):
        table = stored(counted(training, bits), "counts")

    tokens, words = table.agg(F.sum("tokens"), F.sum(F.size("words").cast("long"))).first()
    tokens, words = tokens or 0, words or 0
    least = head_count(table, head_words)
    head = table.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    known = head.where(F.col("counts") >= least).toArrow()
    order = np.argsort(known.column("words").to_numpy().view(np.uint64))
    # With a last entry that is no word, so that a search never ends outside.
    head_hashes = np.append(known.column("words").to_numpy().view(np.uint64)[order], np.uint64(0))
    head_counts = np.append(known.column("counts").to_numpy()[order], -1)
    del known, order
    shared_head = spark.sparkContext.broadcast((head_hashes, head_counts))

    parts = table.select("bucket", F.length("word_filter"), F.length("pair_filter")).orderBy("bucket").collect()
    lots = segments(map(tuple, parts), most_bytes)
    state = docs.withColumns({c: F.lit(None).cast("binary") for c in ("word_levels", "pair_levels")})
    state = state.withColumn("start_level", F.lit(0))
    with small_batches(spark, BATCH_ROWS):
        for lot in lots[:-1]:
            filters = shared_filters(table, lot, bits)
            state = stored(probed(state, filters), "levels")
            filters.destroy()
        filters = shared_filters(table, lots[-1], bits)
        rows = stored(scored(state, filters, shared_head, tokens + words + 1), "scores")
    # The scores are written: nothing asks for these again.
    filters.destroy()
    shared_head.destroy()

    best = rows.agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(STRENGTHS))]).first()
    strength = max(range(len(STRENGTHS)), key=lambda i: (best[i] or 0.0, i)) if tokens else len(STRENGTHS) - 1
    # Rarer words and unknown ones: one row a text and word, so a frequent word is none of them.
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", "x.rare", "x.times")
    counts = head.where(F.col("counts") < least).select(F.col("words").alias("rare"), "counts")
    c = F.coalesce("counts", F.lit(0))
    own = rare.join(counts, "rare", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(c + 1)).alias("rare_sum"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0.0)
    return rows.select("key", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", F.get("scores", F.lit(strength)).alias("score")).join(own, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rare_sum", zero) - F.col("n_tokens") * F.lit(float(np.log10(tokens + words + 1)))).alias("base_score"),
        "score",
    )


def head_count(table, most):
    """The least count that at most `most` words reach, a level's least; over all words' levels."""
    found = table.select(F.posexplode("by_level").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n"))
    reached, least = 0, int(LEAST[-1])
    for row in sorted(found.where("level > 0").collect(), reverse=True):
        reached += row.n
        if reached > most:
            break
        least = int(LEAST[row.level - 1])
    return least


def shared_filters(table, lot, bits):
    """The filters of a lot of buckets, broadcast: at most the bytes the lot was cut to."""
    words = Filter([(b, w) for b, w, _ in lot], bits)
    pairs = Filter([(b, p) for b, _, p in lot], bits)
    if lot:
        chosen = table.where(F.col("bucket").between(lot[0][0], lot[-1][0]))
        # Part after part, so that the driver's JVM never holds the lot.
        for row in chosen.select("bucket", "word_filter", "pair_filter").toLocalIterator():
            words.put(row[0], row[1])
            pairs.put(row[0], row[2])
    return table.sparkSession.sparkContext.broadcast((words, pairs))


def with_levels(batch, at, texts, memo, pairs, start):
    """Tokens of some rows and their levels: what earlier passes found, and what the filters know."""
    numbers, sizes = memo.tokens(texts)
    flat, of_word = memo.columns[0][numbers], memo.columns[1][numbers]
    distinct, place = np.unique(pair_hash(before_each(flat, sizes), flat), return_inverse=True)
    of_pair = pairs.levels(distinct)[place]
    earlier = [b"".join(x or b"" for x in batch.column(c).slice(at, len(texts)).to_pylist()) for c in ("word_levels", "pair_levels")]
    if earlier[0]:
        of_word = np.maximum(of_word, np.frombuffer(earlier[0], np.uint8))
        of_pair = np.maximum(of_pair, np.frombuffer(earlier[1], np.uint8))
    return numbers, flat, sizes, of_word, of_pair, max(start, batch.column("start_level")[at].as_py())


def probed(state, filters):
    """state with the levels that these filters know put in: a byte a token and pair."""

    def run(batches):
        words, pairs = filters.value
        memo, start = Vocabulary(words.levels), int(words.levels(np.array([START]))[0])
        for batch in batches:
            for at, texts in chunks(batch):
                _, _, sizes, of_word, of_pair, of_start = with_levels(batch, at, texts, memo, pairs, start)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edges, edges[1:])], pa.binary())
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "text", "held_out")), cut(of_word), cut(of_pair),
                     pa.array([of_start] * len(texts), pa.int32())],
                    ["doc_id", "text", "held_out", "word_levels", "pair_levels", "start_level"],
                )

    return state.mapInArrow(run, state.schema)


def scored(state, filters, head, total):
    """Per row: key, doc_id, held_out, n_tokens, scores by strength, the exact sums over words of
    the head, the other words with how often each occurs; left_out of a chunk in its first row."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        words, pairs = filters.value
        hashes, counts = head.value

        def exact(wanted):
            """The counts of words of the head, -1 of others."""
            place = np.searchsorted(hashes[:-1], wanted)
            found = (hashes[place] == wanted) & (place < len(hashes) - 1)
            return np.where(found, counts[place], -1)

        memo, start = Vocabulary(words.levels, exact), int(words.levels(np.array([START]))[0])
        for batch in batches:
            for at, texts in chunks(batch):
                numbers, flat, sizes, of_word, of_pair, of_start = with_levels(batch, at, texts, memo, pairs, start)
                part = batch.slice(at, len(texts))
                out = part.column("held_out").to_numpy(zero_copy_only=False)
                plain, left_out = likelihoods(of_word, of_pair, of_start, sizes, total, out)
                of_head = memo.columns[2][numbers]
                in_head = of_head >= 0
                first = np.cumsum(sizes) - sizes
                rare, times, edges = rare_words(flat, ~in_head, sizes)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(row + np.arange(len(texts))),
                        "doc_id": part.column("doc_id"),
                        "held_out": part.column("held_out"),
                        "n_tokens": pa.array(sizes),
                        "head_known": pa.array(np.add.reduceat(in_head.astype(np.int64), first)),
                        "head_sum": pa.array(np.add.reduceat(np.log10(np.maximum(of_head, 0) + 1.0), first)),
                        "scores": pa.array(list(plain), pa.list_(pa.float64())),
                        "left_out": pa.array([left_out] + [None] * (len(texts) - 1), pa.list_(pa.float64())),
                        "rare": lists(rare.view(np.int64)),
                        "times": lists(times),
                    }
                )
                row += len(texts)

    kinds = (
        "key long, doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double,"
        " scores array<double>, left_out array<double>, rare array<long>, times array<long>"
    )
    return state.mapInArrow(run, kinds)


def rare_words(flat, chosen, sizes):
    """Per text its distinct chosen hashes and how often each occurs: hashes, times, edges of texts."""
    text = np.repeat(np.arange(len(sizes)), sizes)[chosen]
    hashes = flat[chosen]
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.concatenate((first, [len(hashes)])))
    return hashes[first], times.astype(np.int64), np.searchsorted(text[first], np.arange(len(sizes) + 1))
