"""Near copies by both measures: fingerprints a few bits apart, then equal shingles verified.

SimHash links texts that differ in few words of many; a Jaccard of whole sets of shingles also
links those whose fingerprints lie further apart.  A component follows links of either kind, so
no link that one of them has is lost.
"""

from pyspark.sql import functions as F

from larder.llm import shingles, simhash
from larder.llm.common import one_of_each, stored
from larder.llm.components import components


def linked_documents(docs):
    """Per row of docs: doc_id, text_hash, component (rows that links of either kind reach have the same)."""
    keys = ["doc_id", "text_hash"]
    prints = simhash.components_of(docs).select(*keys, F.concat(F.lit("print "), F.col("component").cast("string")).alias("a"))
    sets = shingles.similar_documents(docs).select(*keys, F.concat(F.lit("set "), F.col("component").cast("string")).alias("b"))
    sets = stored(sets, "sets")
    # A row has one component of each kind, which makes them one.
    left, right = prints.distinct().alias("l"), sets.distinct().alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    roots = components(left.join(right, same).select("a", "b").distinct())
    return sets.join(roots.withColumnRenamed("node", "b"), "b").select(*keys, F.col("root").alias("component"))


def first_of_each(docs):
    """docs with one row of each component: the smallest doc_id, null last, then text_hash."""
    return one_of_each(docs, linked_documents(docs))
