"""Ranked prefix search for many queries at once."""

import unicodedata

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators.sizes import broadcast_if_small

# Published BM25 parameters of the full-text engine's ranking function.
K1 = 1.2
B = 0.75
RARE = 1e-6


def _latin_folding():
    """Latin letters with their bare letter, then the combining marks to drop."""
    marked = [
        (chr(c), unicodedata.normalize("NFD", chr(c))[0])
        for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    ]
    pairs = [(c, base) for c, base in marked if base != c and base.isascii() and base.isalpha()]
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(c for c, _ in pairs) + marks, "".join(base for _, base in pairs)


FOLDING = _latin_folding()


def fold(text):
    return F.lower(F.translate(text, *FOLDING))


def tokens(text):
    """Lower-case letter and digit runs without diacritics."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_terms(text):
    """Prefix terms of what a person typed: letters and digits of each word."""
    words = F.split(text, r"[\s\u0085\p{Z}]+")
    cleaned = F.transform(words, lambda w: fold(F.regexp_replace(w, r"[^\p{L}\p{Nd}]", "")))
    return F.filter(cleaned, lambda t: t != "")


def search_index(products, key="gtin"):
    """key, is_complete, words, length from columns name, brand and is_complete.

    length counts the words of both columns.
    """
    words = F.concat(tokens(F.col("name")), tokens(F.coalesce("brand", F.lit(""))))
    return products.select(key, "is_complete", words.alias("words")).withColumn("length", F.size("words"))


def search(index, queries, limit, key="gtin"):
    """Ranked hits: query_id, key, is_complete, score, rank.

    queries: query_id, text.  A word is reduced to its prefixes of the lengths the queries
    use, which makes the prefix match an equi-join.  Word counts are combined before the
    exchange; the rank filter keeps limit rows per query and task before the last one.
    """
    terms = queries.select("query_id", search_terms(F.col("text")).alias("_terms")).select(
        "query_id", F.size("_terms").alias("wanted"), F.posexplode("_terms").alias("term_no", "term")
    )
    lengths = terms.agg(F.array_sort(F.collect_set(F.length("term")))).scalar()
    totals = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("length").alias("words"))
    docs = totals.select("docs").scalar()
    average = totals.select(F.col("words") / F.col("docs")).scalar()

    prefixes = F.transform(
        F.filter("_lengths", lambda n: n <= F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n)
    )
    wanted = broadcast_if_small(terms.select("term").distinct())
    found = (
        index.select(key, "is_complete", "length", lengths.alias("_lengths"), F.explode_outer("words").alias("word"))
        .select(key, "is_complete", "length", F.explode_outer(prefixes).alias("term"))
        .join(wanted, "term")
        .groupBy("term", key, "is_complete", "length")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    spread = found.groupBy("term").agg(F.count(F.lit(1)).alias("holders"))
    rarity = F.log((docs - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    weighted = terms.join(spread, "term").withColumn("idf", F.when(rarity > 0, rarity).otherwise(RARE))
    worth = F.col("idf") * (F.col("times") * (K1 + 1)) / (
        F.col("times") + K1 * (1 - B + B * F.col("length") / average)
    )
    scored = (
        found.join(weighted, "term")
        .groupBy("query_id", key, "is_complete", "wanted")
        .agg(F.sum(worth).alias("score"), F.count(F.lit(1)).alias("met"))
        .where(F.col("met") == F.col("wanted"))
    )
    place = F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("is_complete"), key)
    )
    return (
        scored.withColumn("rank", place)
        .where(F.col("rank") <= limit)
        .select("query_id", key, "is_complete", "score", "rank")
    )


def search_products(product, brand, product_search, queries, limit):
    """Search the catalogue tables and name the hits."""
    flags = product.select("gtin", "name", "brand_id", F.col("is_complete"))
    indexed = product_search.join(flags.select("gtin", "is_complete"), "gtin")
    hits = search(search_index(indexed), queries, limit)
    names = brand.select(F.col("id").alias("brand_id"), F.col("name").alias("brand_name"))
    return (
        hits.join(flags.select("gtin", "name", "brand_id"), "gtin")
        .join(names, "brand_id", "left")
        .select("query_id", "rank", "gtin", "name", "brand_name", "is_complete", "score")
    )
