"""Peer cut-offs per category, basis and nutrient, and comparison with them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions.nutrients import display_name, long_values
from larder.operators.sizes import broadcast_if_small, written
from larder.vocab import NUTRIENT_IDS

GROUP = ["category_id", "basis", "nutrient"]


def category_panels(product, nutrition):
    """Catalogue tables to panels with a category: one row per panel."""
    placed = product.where(F.col("category_id").isNotNull()).select("gtin", "category_id")
    return nutrition.where(F.col("basis").isin("per_100g", "per_100ml")).join(placed, "gtin")


def peer_values(panels, nutrients):
    """Long form (category_id, basis, nutrient, value) of comparable panels.

    Every nutrient is read in the same pass.
    """
    unknown = set(nutrients) - set(NUTRIENT_IDS)
    if unknown:
        raise ValueError(f"unknown nutrients: {sorted(unknown)}")
    values = F.array(*[F.struct(F.lit(n).alias("nutrient"), F.col(n).alias("value")) for n in nutrients])
    return (
        panels.where(F.col("category_id").isNotNull() & F.col("basis").isin("per_100g", "per_100ml"))
        .select("category_id", "basis", F.inline(values))
        .where(F.col("value").isNotNull())
    )


def peer_groups(values, minimum_peers):
    """Groups with enough peers."""
    return values.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("peer_count")).where(
        F.col("peer_count") >= minimum_peers
    )


def peer_stats(values, minimum_peers, lower_percentile, higher_percentile, rule_id, rule_version):
    """Nearest-rank cut-offs.

    Rows are first counted per distinct value with map-side combine, so the window sorts
    distinct figures (two decimals), not products, however large one category is.
    """
    counted = values.groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("n"))
    return cut_offs(counted, minimum_peers, lower_percentile, higher_percentile, rule_id, rule_version)


def cut_offs(counted, minimum_peers, lower_percentile, higher_percentile, rule_id, rule_version):
    """Nearest-rank cut-offs of counted figures: the group columns, value, and n, one row per value."""
    ordered = Window.partitionBy(*GROUP).orderBy("value")
    placed = counted.select(
        *GROUP,
        "value",
        F.sum("n").over(ordered).alias("upto"),
        F.sum("n").over(Window.partitionBy(*GROUP)).alias("total"),
    ).where(F.col("total") >= minimum_peers)

    def cut(percentile):
        rank = F.ceil(F.lit(float(percentile)) / F.lit(100.0) * F.col("total"))
        rank = F.least(F.greatest(rank, F.lit(1)), F.col("total"))
        return F.min(F.when(F.col("upto") >= rank, F.col("value")))

    return placed.groupBy(*GROUP).agg(
        F.max("total").alias("peer_count"),
        cut(lower_percentile).alias("lower_value"),
        cut(higher_percentile).alias("higher_value"),
        F.lit(rule_id).alias("rule_id"),
        F.lit(rule_version).alias("rule_version"),
    )


def peer_comparison(panels, stats, category, key="gtin"):
    """A sentence per panel and nutrient that has peer cut-offs.

    panels: key, block_index, category_id, basis and one column per nutrient.  Cut-offs are
    an aggregate of a large table, so they are written first; their measured size then lets
    them be broadcast and the panels stay where they are.
    """
    stats, category = broadcast_if_small(written(stats)), broadcast_if_small(category)
    names = category.select(F.col("id").alias("category_id"), F.col("name").alias("_name"))
    values = panels.where(F.col("basis").isin("per_100g", "per_100ml")).select(
        key, "block_index", "category_id", "basis", F.inline(long_values({n: F.col(n) for n in NUTRIENT_IDS}))
    ).where(F.col("value").isNotNull())
    joined = values.join(stats, GROUP).join(names, "category_id", "left")
    where = (
        F.when(F.col("value") > F.col("higher_value"), "more than most")
        .when(F.col("value") < F.col("lower_value"), "less than most")
        .otherwise("about the same as most")
    )
    # Fixed value: the sentence.
    sentence = F.format_string(
        "%s: %s of the %d products in the %s category that declare a figure.",
        display_name(F.col("nutrient")),
        where,
        F.col("peer_count"),
        F.lower(F.coalesce("_name", "category_id")),
    )
    return joined.select(
        key, "block_index", "category_id", "basis", "nutrient", "value", "peer_count", sentence.alias("sentence")
    )
