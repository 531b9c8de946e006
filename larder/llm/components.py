"""Connected components of a list of links, without collecting links anywhere."""

from pyspark.sql import functions as F

from larder.llm.common import shared_dir

MOST_ROUNDS = 60


def components(pairs):
    """node, root of every node of pairs (a, b); root is the smallest node it reaches.

    Alternates two steps until nothing changes: each node's larger neighbours, then its
    smaller ones, are linked to the smallest node around.  Rounds grow with the logarithm of
    the longest chain.  A step is a grouped minimum and a join on the node, which splits hot
    nodes; each round is checkpointed in the shared folder.  Self links and repeats are fine.
    """
    shared_dir(pairs.sparkSession)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = pairs.select(high.alias("u"), low.alias("v")).where("u != v").distinct().checkpoint()
    seen = None
    for _ in range(MOST_ROUNDS):
        links = _star(_star(links, True), False).checkpoint()
        state = links.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        ).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(own)


def _star(links, large):
    """One step over links u > v; the result has u > v again."""
    if large:
        around = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = links
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = least.withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u != v").distinct()
