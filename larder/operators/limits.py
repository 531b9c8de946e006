"""Published limits of categories, inherited along the category tree."""

import math

from pyspark.sql import functions as F

from larder.functions.nutrients import long_values
from larder.functions.numbers import show_two
from larder.operators.bands import normalised_panels
from larder.operators.sizes import broadcast_if_small, written
from larder.vocab import NUTRIENT_IDS


def nearest_ancestor(categories, marked):
    """category_id, nearest_id, in_cycle: the nearest marked category on the way to the root.

    categories: id, parent_id; marked: category_id.  A marked category is its own nearest; one
    without any on its way has null.  A parent that is no category ends the way.  Where parents
    lead in a circle, in_cycle is true, and the nearest is the first marked one met, if any.
    Of repeated ids the row with the smallest parent counts, null last.

    Each round every category that still points somewhere looks up the category it points to and
    takes over what that one knows and where it points, so the way doubles: rounds grow with the
    logarithm of the depth, and after more steps than there are categories only circles still
    point somewhere.  The categories are as many in every round, so none of the rounds sends them
    through the driver: a broadcast of each would add up.
    """
    tree = categories.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = tree.select(F.col("id").alias("parent_id"), F.lit(True).alias("_is"))
    has = marked.select(F.col("category_id").alias("id"), F.lit(True).alias("_has")).where("id is not null").distinct()
    state = written(
        tree.join(known.hint("merge"), "parent_id", "left").join(has.hint("merge"), "id", "left").select(
            "id",
            F.when(F.col("_is"), F.col("parent_id")).alias("jump"),
            F.when(F.col("_has"), F.col("id")).alias("nearest"),
        )
    )
    n = state.count()
    for _ in range(max(1, math.ceil(math.log2(max(n, 2))) + 1)):
        if not state.where(F.col("jump").isNotNull()).limit(1).count():
            break
        there = state.select(
            F.col("id").alias("jump"), F.col("jump").alias("_further"), F.col("nearest").alias("_found")
        )
        moved = state.where(F.col("jump").isNotNull()).join(there.hint("merge"), "jump", "left").select(
            "id", F.col("_further").alias("jump"), F.coalesce("nearest", "_found").alias("nearest")
        )
        # Those that have arrived stay as they are; joined by their null they would be one group.
        state = written(moved.unionByName(state.where(F.col("jump").isNull())))
    return state.select(
        F.col("id").alias("category_id"), F.col("nearest").alias("nearest_id"), F.col("jump").isNotNull().alias("in_cycle")
    )


def category_limits(panels, categories, limits, key="gtin"):
    """One row per comparable panel and limit of its category whose nutrient is declared.

    limits: category_id, source_category, nutrient, display, unit, derived_from, multiply_by,
    above.  A category without limits of its own has all those of its nearest ancestor with
    some.  A value equal to a limit is not above it.  Categories in a circle have none beyond
    those met on it.
    """
    of = nearest_ancestor(categories, limits).where("nearest_id is not null").select("category_id", "nearest_id")
    rules = limits.withColumnRenamed("category_id", "nearest_id").withColumn("reads", F.coalesce("derived_from", "nutrient"))
    # Every category has a row per limit here, so both joins are measured and not left to the size of files.
    rules = broadcast_if_small(written(of.join(broadcast_if_small(rules), "nearest_id")))
    values = (
        normalised_panels(panels)
        .where(F.col("category_id").isNotNull())
        .select(
            key, "block_index", "category_id", F.col("comparable.form").alias("form"),
            F.col("comparable.factor").alias("factor"), F.inline(long_values({n: F.col(n) for n in NUTRIENT_IDS})),
        )
        .where(F.col("value").isNotNull())
        .select(
            key, "block_index", "category_id", "form", F.col("nutrient").alias("reads"),
            (F.col("value") * F.col("factor")).alias("reading"),
        )
    )
    value = F.when(F.col("derived_from").isNotNull(), F.col("reading") * F.col("multiply_by")).otherwise(F.col("reading"))
    judged = values.join(rules, ["category_id", "reads"]).withColumn("value", value)
    over = F.col("value") > F.col("above")
    sentence = F.format_string(
        "%s: %s %s per %s, %s the limit of %s %s for %s.",
        "display", show_two(F.col("value")), "unit", F.when(F.col("form") == "drink", "100 ml").otherwise("100 g"),
        F.when(over, "above").otherwise("within"), show_two(F.col("above")), "unit", "source_category",
    )
    return judged.select(
        key, "block_index", "category_id", F.col("nearest_id").alias("limit_category"), "source_category", "nutrient",
        "value", "above", over.alias("exceeds"), sentence.alias("statement"),
    )
