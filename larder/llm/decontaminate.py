"""Benchmark decontamination by spaced-seed hashing, without Python.

A mask looks at some of the words in a window and ignores the others, so a passage with
words replaced still agrees with the original wherever the replaced ones fall on ignored
places.  Hashes of the benchmark's windows are joined to those of all windows of the corpus;
each hit fixes an alignment, which is verified word by word.

The masks together leave no way to replace two of 13 words unseen.  An item shorter than that
is cut into one run of words more than may be replaced; one of the runs then is whole.
"""

from pyspark.sql import functions as F

from larder.llm.common import gram_hash, packed, words_of
from larder.operators.sizes import broadcast_if_small

# Word places that count, from the first word of a window.
MASKS = ((0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 3, 7, 8))
SEPARATORS = r"^\p{L}\p{N}"
WINDOW = 13
SHARE = 0.8
LONGEST_RUN = 8


def normal_words(text):
    """Lower-cased runs of letters and digits; null is empty."""
    return words_of(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def windows(rows, masks=MASKS):
    """One row for each place and mask whose window fits: place, mask, hash, and rows' columns.

    rows has `words`.  One generator counts through places and masks, so the words are split
    once a text and stay in the scan's generated loop; a window that does not fit has no hash.
    """
    n = len(masks)
    least = min(max(m) for m in masks) + 1
    numbered = rows.where(F.size("words") >= least).select(
        "*", F.explode(F.sequence(F.lit(0), (F.size("words") - least + 1) * n - 1)).alias("_at")
    )
    place = F.expr(f"int(_at div {n})")
    mask = F.expr(f"int(_at % {n})")
    value = None
    for number, offsets in enumerate(masks):
        fits = (mask == number) & (place + max(offsets) < F.size("words"))
        hashed = gram_hash(F.col("words"), place, offsets)
        value = F.when(fits, hashed) if value is None else value.when(fits, hashed)
    return numbered.select(
        *rows.columns, place.alias("place"), mask.alias("mask"), value.alias("hash")
    )


def runs(items, window=WINDOW, share=SHARE):
    """Seeds of the items shorter than the window: item_place, length and the item's columns.

    Of one to four words none may be replaced, so such an item is one run, itself.
    """
    n = F.size("words")
    parts = (n - F.ceil(n * F.lit(share)) + 1).cast("int")
    length = F.least(F.expr("int(_n div _parts)"), F.lit(LONGEST_RUN))
    short = items.where((n < window) & (n > 0)).withColumn("_n", n).withColumn("_parts", parts)
    return short.withColumn("length", length).select(
        *items.columns,
        "length",
        F.explode(F.expr("transform(sequence(0, _parts - 1), i -> int(i * (_n div _parts)))")).alias("item_place"),
    )


def overlaps(docs, benchmark, masks=MASKS, window=WINDOW, share=SHARE):
    """Verified overlaps: doc_id, item_id, first_word, n_words, n_same, passage.

    Aligned words of a document and an item are compared from hit to hit; an overlap is the
    best stretch of min(window, words of the item) words with at least `share` of them equal,
    and a row is the best alignment of the pair (most equal words, then the first).  Null or
    empty texts, and items without words, have none; an item of one to four words overlaps
    where all its words stand.  Rows that repeat a
    doc_id are one document if their texts are equal, else each is compared.  Benchmark
    hashes are broadcast when their measured size allows it; beyond, the join is shuffled.
    """
    items = benchmark.select(
        F.col("item_id"), normal_words(F.col("text")).alias("words")
    ).where(F.size("words") > 0)
    short = runs(items, window, share)
    # Whole runs are masks too; texts are only searched for the lengths that items have.
    lengths = sorted(r[0] for r in short.select("length").distinct().collect())
    place, n_item = F.col("place").alias("item_place"), F.size("words").alias("n_item")
    seeds = windows(items.where(F.size("words") >= window), masks).select("hash", "mask", "item_id", place, n_item)
    for number, length in enumerate(lengths, len(masks)):
        value = gram_hash(F.col("words"), F.col("item_place"), range(length))
        seeds = seeds.union(
            short.where(F.col("length") == length).select(
                value.alias("hash"), F.lit(number).alias("mask"), "item_id", "item_place", n_item
            )
        )
    masks = (*masks, *[tuple(range(length)) for length in lengths])
    texts = docs.select(F.col("doc_id"), normal_words(F.col("text")).alias("words"))
    hits = windows(texts, masks).join(broadcast_if_small(seeds), ["hash", "mask"])
    # The document's words that lie beside the item's; what lies outside it is null.
    start = F.col("place") - F.col("item_place")
    first = F.greatest(start, F.lit(0))
    beside = F.slice("words", first + 1, F.least(start + F.col("n_item"), F.size("words")) - first)
    found = (
        hits.select(
            "doc_id",
            "item_id",
            start.alias("start"),
            "n_item",
            beside.alias("beside"),
        )
        .groupBy("doc_id", "item_id", "start", "beside")
        .agg(F.first("n_item").alias("n_item"))
    )
    item_words = broadcast_if_small(items.withColumnRenamed("words", "item_words"))
    same = F.expr(
        """transform(sequence(0, n_item - 1), i ->
             if(start + i >= 0 and get(beside, i + least(start, 0)) = item_words[i], 1, 0))"""
    )
    sums = F.expr(
        """aggregate(same, array(0), (acc, x) -> array_append(acc, element_at(acc, -1) + x))"""
    )
    width = F.least(F.lit(window), F.col("n_item"))
    verified = (
        found.join(item_words, "item_id")
        .withColumn("same", same)
        .withColumn("width", width)
        .withColumn("sums", sums)
        .withColumn(
            "best",
            F.expr(
                """array_max(transform(sequence(0, n_item - width),
                     i -> struct(sums[i + width] - sums[i] as n, -i as i)))"""
            ),
        )
        .where(F.col("best.n") >= F.ceil(F.col("width") * F.lit(share)))
    )
    row = verified.select(
        "doc_id",
        "item_id",
        F.struct(
            F.expr("sums[n_item]").alias("n_same"),
            (-F.col("start")).alias("first"),
            F.col("best.n").alias("n_window"),
            F.greatest(F.col("start"), F.lit(0)).alias("first_word"),
            F.size("beside").alias("n_words"),
            F.array_join("beside", " ").alias("passage"),
        ).alias("found"),
    )
    return (
        row.groupBy("doc_id", "item_id")
        .agg(F.max("found").alias("found"))
        .select(
            "doc_id", "item_id", "found.first_word", "found.n_words", "found.n_same", "found.n_window", "found.passage"
        )
    )


def clean_documents(docs, benchmark, **options):
    """docs without those that overlap a benchmark item; columns as they are.

    Rows that share a doc_id, or have none, go or stay each by its own text.
    """
    hashed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    found = overlaps(hashed, benchmark, **options).select(
        F.col("doc_id.doc_id").alias("_leaked"), F.col("doc_id.text_hash").alias("_hash")
    ).distinct()
    rows = packed(docs)
    same = F.col("doc_id").eqNullSafe(F.col("_leaked")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(found, same, "left_anti").select("_row.*")
