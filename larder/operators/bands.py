"""Nutrient rows of a panel and their bands under published rules."""

from pyspark.sql import functions as F

from larder.functions.nutrients import comparable_basis, display_name, long_values, panel_order, unit_of
from larder.functions.numbers import show_two
from larder.operators.sizes import broadcast_if_small
from larder.vocab import NUTRIENT_IDS


def nutrient_rows(panels, key="gtin"):
    """Rows a product screen shows: a value, or 'Unknown' when listed as not declared."""
    shown = panels.select(
        key, "block_index", "not_declared", F.inline(long_values({n: F.col(n) for n in NUTRIENT_IDS}))
    ).where(F.col("value").isNotNull() | F.array_contains("not_declared", F.col("nutrient")))
    figure = F.concat_ws(" ", show_two(F.col("value")), unit_of(F.col("nutrient")))
    return shown.select(
        key,
        "block_index",
        panel_order(F.col("nutrient")).alias("position"),
        "nutrient",
        display_name(F.col("nutrient")).alias("display"),
        "value",
        F.when(F.col("value").isNull(), "Unknown").otherwise(figure).alias("shown"),
    )


def normalised_panels(panels):
    """Adds struct column comparable; panels that cannot be compared are dropped."""
    scaled = comparable_basis(
        F.col("basis"), F.col("serving_value"), F.col("serving_unit"), F.col("serving_description")
    )
    return panels.withColumn("comparable", scaled).where(F.col("comparable").isNotNull())


def nutrient_bands(panels, bands, key="gtin"):
    """One row per panel and band whose nutrient is declared.

    The rules are joined on their basis, form and the nutrient they read, so a panel only
    meets rules that apply to it.
    """
    values = (
        normalised_panels(panels)
        .select(key, "block_index", "comparable", F.inline(long_values({n: F.col(n) for n in NUTRIENT_IDS})))
        .where(F.col("value").isNotNull())
        .select(
            key,
            "block_index",
            F.col("comparable.basis").alias("basis"),
            F.col("comparable.form").alias("form"),
            F.col("comparable.calculated").alias("calculated"),
            F.col("comparable.serving_description").alias("serving_description"),
            F.col("comparable.serving_amount").alias("serving_amount"),
            F.col("nutrient").alias("reads"),
            (F.col("value") * F.col("comparable.factor")).alias("reading"),
        )
    )
    rules = bands.withColumn("reads", F.coalesce("derived_from", "nutrient"))
    joined = values.join(broadcast_if_small(rules), ["basis", "form", "reads"])
    value = F.when(
        F.col("derived_from").isNotNull(), F.col("reading") * F.col("multiply_by")
    ).otherwise(F.col("reading"))
    judged = joined.withColumn("value", value)
    portion = F.coalesce(
        (F.col("serving_amount") > F.col("portion_applies_above"))
        & (F.col("value") * F.col("serving_amount") / 100.0 > F.col("portion_higher_above")),
        F.lit(False),
    )
    level = (
        F.when(portion, "Higher")
        .when(F.col("value") <= F.col("lower_at_or_below"), "Lower")
        .when(F.col("value") > F.col("higher_above"), "Higher")
        .otherwise("Moderate")
    )
    return judged.withColumn("level", level).select(
        key,
        "block_index",
        "rule_id",
        F.col("version").alias("rule_version"),
        "nutrient",
        "display",
        "unit",
        "value",
        "level",
        "calculated",
        F.when(F.col("calculated"), F.coalesce("serving_description", F.lit("the stated serving"))).alias(
            "calculated_from"
        ),
        F.when(F.col("derived_from").isNotNull(), F.col("derived_note")).alias("derived_note"),
        _statement().alias("statement"),
    )


def _statement():
    """The explanation of a band."""
    unit, low, high = F.col("unit"), show_two(F.col("lower_at_or_below")), show_two(F.col("higher_above"))
    comparison = (
        F.when(
            F.col("level") == "Lower",
            F.format_string("at or below %s %s, which this rule calls lower", low, unit),
        )
        .when(
            F.col("level") == "Higher",
            F.format_string("above %s %s, which this rule calls higher", high, unit),
        )
        .otherwise(
            F.format_string("between %s and %s %s, which this rule calls moderate", low, high, unit)
        )
    )
    per = F.when(F.col("basis") == "per_100ml", "100 ml").otherwise("100 g")
    sentence = F.format_string("%s %s per %s: %s.", show_two(F.col("value")), unit, per, comparison)
    note = F.format_string(
        " Calculated from the declared serving of %s, not printed on the packet.",
        F.coalesce("serving_description", F.lit("")),
    )
    return F.when(F.col("calculated"), F.concat(sentence, note)).otherwise(sentence)


def rule_findings(bands):
    """Rule rows that cite no source or share a rule id, version and nutrient."""
    uncited = bands.where(
        (F.coalesce(F.trim("source_title"), F.lit("")) == "")
        | ~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False))
        | (F.coalesce(F.trim("source_locator"), F.lit("")) == "")
    ).select("rule_id", F.lit("uncited").alias("problem")).distinct()
    repeated = (
        bands.groupBy("rule_id", "nutrient", "basis", "form")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("rule_id", F.lit("duplicate").alias("problem"))
        .distinct()
    )
    return uncited.unionByName(repeated)
