"""Text cleaning, slugs and list fields."""

from functools import reduce

from pyspark.sql import functions as F

from larder.vocab import CATEGORY_MAP, SLUG_ACCENTS, SLUG_LIGATURES, WHITESPACE


def strip(text):
    return F.btrim(text, F.lit(WHITESPACE))


def clean_text(text):
    """Runs of white space become one space; blank becomes null."""
    squeezed = F.regexp_replace(text, r"[\s\u0085\p{Z}]+", " ")
    return F.nullif(F.btrim(squeezed), F.lit(""))


def first_of_list(text):
    """First non-empty item of a comma list."""
    start = F.ltrim(clean_text(text), F.lit(", "))
    return F.nullif(F.btrim(F.substring_index(start, ",", 1)), F.lit(""))


def truncate(text, size):
    """Cut to size characters and drop the space left at the end."""
    cut = F.rtrim(F.substring(text, 1, size), F.lit(WHITESPACE))
    return F.when(F.length(text) > size, cut).otherwise(text)


def slug(text):
    """Lower-case ASCII words joined by '-'; null when empty or over 80 long."""
    folded = F.translate(F.lower(strip(text)), *SLUG_ACCENTS)
    folded = reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SLUG_LIGATURES, folded)
    words = F.btrim(F.regexp_replace(folded, "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.length(words).between(1, 80), words)


def slug_title(slug_column):
    """Slug words with a capital first letter: 'mother-s' gives 'Mother S'."""
    return F.initcap(F.replace(slug_column, F.lit("-"), F.lit(" ")))


def map_category(tags_text, mapping=CATEGORY_MAP):
    """Category of the first mapping pair whose tag occurs in a comma list.

    array_intersect keeps the order of its first argument, so the mapping's own
    order decides, and no join or shuffle is needed.
    """
    known = F.array(*[F.lit(tag.lower()) for tag, _ in mapping])
    names = F.array(*[F.lit(category) for _, category in mapping])
    tags = F.split(F.lower(strip(tags_text)), r"[\s\u0085\p{Z}]*,[\s\u0085\p{Z}]*")
    hit = F.get(F.array_intersect(known, tags), F.lit(0))
    return F.get(names, F.array_position(known, hit).cast("int") - 1)
