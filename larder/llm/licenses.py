"""License scans by diagonal voting, without Python.

Every k-gram of a text is joined by hash to the places of the k-grams of license templates.
A hit votes for the diagonal, place in the text less place in the template.  Votes on
neighbouring diagonals are one span, since words put in or left out shift the rest by a few;
a span names its template when enough of its grams follow one another in the text as they do in
the template.  Every break costs grams, so the cover asked for bounds the breaks and with them
how far diagonals of a span may lie apart.  Short phrases are templates too, which must match whole.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.llm.common import gram_hash, lower_ascii, words_of

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
PHRASE_GRAM, NOTICE_GRAM = 2, 3
COVER = 0.7
NEIGHBOURS = 3
MOST_WORDS = 200_000

# Phrases of the base, word for word, and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Usual notices of public licenses and the labels this method gives.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file "
        "except in compliance with the license",
        "apache-2.0-header",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("released under the mit license", "mit-notice"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files",
        "mit-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "bsd",
    ),
    ("mozilla public license version 2 0", "mpl-2.0"),
)


def grams(rows, sizes=(PHRASE_GRAM, NOTICE_GRAM)):
    """rows (with `words`) for each place and k-gram size that fits: place, k, hash, gram.

    The row before the first place carries no gram: it stands for the text itself.
    """
    n = len(sizes)
    numbered = rows.select("*", F.explode(F.sequence(F.lit(-1), F.size("words") * n - 1)).alias("_at"))
    place = F.expr(f"if(_at < 0, -1, int(_at div {n}))")
    k = F.lit(None).cast("int")
    value = F.lit(None).cast("long")
    for i, size in enumerate(sizes):
        fits = (F.col("_at") >= 0) & (F.expr(f"_at % {n}") == i) & (place + size <= F.size("words"))
        k = F.when(fits, size).otherwise(k)
        value = F.when(fits, gram_hash(F.col("words"), place, range(size))).otherwise(value)
    return numbered.select(*rows.columns, place.alias("place"), k.alias("k"), value.alias("hash"))


def breaks(n_grams, cover):
    """How many breaks, each of NOTICE_GRAM - 1 grams at least, leave `cover` of the grams."""
    return F.floor(F.round(n_grams * (1 - cover) / (NOTICE_GRAM - 1), 6)).cast("int")


def template_grams(spark, phrases, notices, cover=COVER):
    """hash, k, gram, template, label, exact, t_place, n_grams, drift of all templates.

    A notice of fewer words than its gram size uses what it has, so it must match whole too.
    drift is how far diagonals of one span may lie apart: none for phrases, NEIGHBOURS a break.
    """
    rows = [(text, label, True) for text, label in phrases]
    rows += [(text, label, False) for text, label in notices]
    if sum(len(r[0].split()) for r in rows) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are not broadcast")
    table = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "template int, text string, label string, exact boolean"
    )
    words = table.withColumn("words", words_of(lower_ascii(F.col("text")), SEPARATORS)).drop("text")
    size = F.when(F.col("exact") | (F.size("words") < NOTICE_GRAM), PHRASE_GRAM).otherwise(NOTICE_GRAM)
    own = grams(words).where(F.col("k") == size)
    return own.select(
        "hash",
        "k",
        F.slice("words", F.col("place") + 1, F.col("k")).alias("gram"),
        "template",
        "label",
        "exact",
        F.col("place").alias("t_place"),
        (F.size("words") - F.col("k") + 1).alias("n_grams"),
    ).withColumn("drift", F.when(F.col("exact"), 0).otherwise(breaks(F.col("n_grams"), cover) * NEIGHBOURS))


def in_order(hits, most):
    """The most hits that follow one another in text and template; hits: array of (place, t_place).

    Patience sorting: the entry at length n is the least t_place at which n hits in order end.
    """
    hits = F.array_sort(F.transform(hits, lambda h: F.struct(h["place"], (-h["t_place"]).alias("back"))))

    def laid(ends, hit):
        beyond = F.filter(ends, lambda end: end >= -hit["back"])
        return F.concat(F.filter(ends, lambda end: end < -hit["back"]), F.array(-hit["back"]), F.slice(beyond, 2, most))

    return F.size(F.aggregate(hits, F.array().cast("array<int>"), laid))


def spans(docs, phrases=PHRASES, notices=NOTICES, cover=COVER):
    """Per text: a marker row, and a row for each span that a template has in it.

    doc_id, text_hash, n_words, copies (input rows that are equal in both), template, label,
    exact, first_word, end_word, covered (share of the template's grams found in order).  The
    marker's template is null.  Phrases span whole matches only, notices at least `cover`.  Of
    spans whose first diagonals lie within their drift, the best one counts, the first of equals.
    """
    spark = docs.sparkSession
    texts = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        words_of(lower_ascii(F.col("text")), SEPARATORS).alias("words"),
    )
    known = template_grams(spark, phrases, notices, cover)
    hits = grams(texts).join(
        F.broadcast(known.withColumnRenamed("k", "t_k").withColumnRenamed("hash", "t_hash")),
        (F.col("hash") == F.col("t_hash")) & (F.col("k") == F.col("t_k")),
        "left",
    )
    verified = F.slice("words", F.col("place") + 1, F.col("k")) == F.col("gram")
    hits = hits.where((F.col("place") < 0) | verified).select(
        "doc_id",
        "text_hash",
        F.when(F.col("place") < 0, F.size("words")).alias("n_words"),
        "template",
        "label",
        "exact",
        (F.col("place") - F.col("t_place")).alias("diagonal"),
        "t_place",
        "n_grams",
        "drift",
        "place",
        (F.col("place") + F.col("k")).alias("end"),
    )
    text = ["doc_id", "text_hash"]
    votes = hits.groupBy(*text, "template", "diagonal").agg(
        F.first("label").alias("label"),
        F.first("exact").alias("exact"),
        F.first("n_grams").alias("n_grams"),
        F.first("drift").alias("drift"),
        F.max("n_words").cast("long").alias("n_words"),
        # Equal input rows vote alike; places tell how many of them there are.
        F.count("*").alias("copies"),
        F.collect_set("t_place").alias("t_places"),
        F.min("place").alias("first_word"),
        F.max("end").alias("end_word"),
    )
    # A span begins at each diagonal and takes those within its drift.
    most = max([NEIGHBOURS * math.ceil(len(t.split()) * (1 - cover)) for t, _ in notices], default=0)
    by_diagonal = Window.partitionBy(*text, "template").orderBy("diagonal")
    near = F.collect_list(F.struct("diagonal", "t_places", "first_word", "end_word")).over(
        by_diagonal.rangeBetween(0, most)
    )
    begun = votes.withColumn("near", near).withColumn(
        "near", F.filter("near", lambda x: x["diagonal"] <= F.col("diagonal") + F.col("drift"))
    )
    wanted = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(float(cover)))
    marker = F.col("template").isNull()
    found = F.size(F.array_distinct(F.flatten(F.col("near.t_places"))))
    begun = begun.where(marker | (found / F.col("n_grams") >= wanted))
    hits = F.flatten(
        F.transform(
            "near",
            lambda x: F.transform(
                x["t_places"], lambda t: F.struct((t + x["diagonal"]).alias("place"), t.alias("t_place"))
            ),
        )
    )
    covered = F.when(~marker, in_order(hits, F.col("n_grams")) / F.col("n_grams"))
    begun = begun.withColumn("covered", covered).where(marker | (F.col("covered") >= wanted))
    rivals = F.collect_list(F.struct("diagonal", "covered")).over(by_diagonal.rangeBetween(-most, most))
    beaten = F.exists(
        "rivals",
        lambda x: (F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("drift"))
        & (
            (x["covered"] > F.col("covered"))
            | ((x["covered"] == F.col("covered")) & (x["diagonal"] < F.col("diagonal")))
        ),
    )
    return begun.withColumn("rivals", rivals).where(marker | ~beaten).select(
        *text, "n_words", "copies", "template", "label", "exact",
        F.array_min("near.first_word").alias("first_word"),
        F.array_max("near.end_word").alias("end_word"),
        "covered",
    )


def scan(docs, phrases=PHRASES, notices=NOTICES, cover=COVER):
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are their smallest and
    largest start (null without any).  labels are those of phrases and notices, distinct,
    sorted and joined by commas; score is the best cover.  Null texts are empty and have no
    words; rows that repeat a doc_id count each for itself, equal rows have equal results.
    """
    base = F.col("exact") & F.col("template").isNotNull()
    found = spans(docs, phrases, notices, cover).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"),
        F.collect_set("label").alias("label_set"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined("base_set").alias("base_labels"),
        joined("label_set").alias("labels"),
        "score",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
