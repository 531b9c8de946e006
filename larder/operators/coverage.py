"""How much of all mentions the most frequent terms cover."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators.sizes import broadcast_if_small, written


def running_total(rows, order, value, into, parts=None):
    """rows with place (from 1) and the sum of value up to each row, in one order over all rows.

    The rows are dealt to ranges of the order; each range is summed, then ranked by itself, and
    starts where the earlier ranges end.  No task sorts more than a range.  The order must be
    total; order is a list of sort columns.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a range keeps its rows whoever reads it again.
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    # One row with an entry a range.
    all_totals = totals.agg(F.collect_list(F.struct("_part", "_sum", "_rows")).alias("_all"))
    zero = F.lit(0).cast("long")
    earlier = lambda field: F.aggregate(
        "_all", zero, lambda s, x: s + F.when(x["_part"] < F.col("_part"), x[field]).otherwise(zero)
    )
    starts = totals.crossJoin(F.broadcast(all_totals)).select(
        "_part", earlier("_sum").alias("_start"), earlier("_rows").alias("_first")
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(starts, "_part").select(
        *rows.columns,
        (F.col("_first") + F.row_number().over(inside)).alias("place"),
        (F.col("_start") + F.sum(value).over(upto)).alias(into),
    )


def term_counts(mentions, term="term"):
    """term, mentions: how often each non-empty term occurs."""
    return mentions.where(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(F.col(term).alias("term")).agg(
        F.count(F.lit(1)).alias("mentions")
    )


def term_coverage(counts, aliases=None):
    """term, mentions, place, covered, total, known: terms by falling count, then by term.

    covered is the sum of mentions up to the term, total that of all; known says whether the
    dictionary's aliases (alias) hold the term, and is null without a dictionary.
    """
    counts = written(counts)
    total = counts.agg(F.coalesce(F.sum("mentions"), F.lit(0)).cast("long").alias("total"))
    found = running_total(counts, [F.desc("mentions"), F.asc("term")], "mentions", "covered")
    found = found.crossJoin(F.broadcast(total))
    if aliases is None:
        return found.withColumn("known", F.lit(None).cast("boolean"))
    names = aliases.select(F.col("alias").alias("term"), F.lit(True).alias("known")).where("term is not null").distinct()
    return found.join(broadcast_if_small(names), "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def coverage_marks(coverage, shares):
    """share, terms: the least number of terms that covers each share (whole per cents) of all mentions."""
    marks = F.explode(F.array(*[F.lit(s) for s in shares])).alias("share")
    reached = coverage.select("place", "covered", "total", marks).where(
        F.col("covered") * 100 >= F.col("share") * F.col("total")
    )
    return reached.groupBy("share").agg(F.min("place").alias("terms"))


def dictionary_share(coverage):
    """One row: terms, mentions, and how many of both the dictionary knows."""
    known = F.col("known")
    return coverage.agg(
        F.count(F.lit(1)).alias("terms"),
        F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"),
        F.count_if(known).alias("known_terms"),
        F.coalesce(F.sum(F.when(known, F.col("mentions"))), F.lit(0)).alias("known_mentions"),
    )
