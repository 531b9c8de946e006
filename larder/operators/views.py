"""What a product screen shows, for every product at once."""

from pyspark.sql import functions as F

from larder.functions.dates import freshness, freshness_note
from larder.functions.nutrients import display_name, unit_of
from larder.functions.numbers import show_one, show_two
from larder.operators import bands as band_rules
from larder.operators import peers, phrases
from larder.operators.lookup import display_names
from larder.operators.mapping import is_complete
from larder.operators.tables import panel_rows
from larder.vocab import BASES, NUTRIENT_IDS, SOURCE_TYPES

# Labels in vocabulary order.
BASIS_LABELS = ["Per 100 g", "Per 100 ml", "Per serving", "Per package"]
SOURCE_LABELS = [
    "Photograph of the packet",
    "Manufacturer",
    "Regulator",
    "Open database",
    "Retailer",
    "Community contribution",
]


def _label(column, keys, labels):
    chain = F
    for key, label in zip(keys[:-1], labels[:-1]):
        chain = chain.when(column == key, label)
    return chain.otherwise(labels[-1])


def basis_label(basis):
    return _label(basis, BASES, BASIS_LABELS)


def verification_text(status):
    # One sentence per status.
    return (
        F.when(status == "verified", "Verified against packaging by a contributor.")
        .when(status == "disputed", "Sources disagree about this product, so treat it with care.")
        .otherwise("Community data, not independently verified. Trust the packet over this app.")
    )


def sources_text(sources):
    def line(s):
        licence = F.when(s["licence"] != "", F.concat(F.lit(", "), s["licence"])).otherwise("")
        return F.concat(
            F.lit("• "), _label(s["type"], SOURCE_TYPES, SOURCE_LABELS), F.lit(", retrieved "),
            s["retrieved_at"], licence,
        )

    return F.when(F.coalesce(F.size(sources), F.lit(0)) == 0, "No source recorded.").otherwise(
        F.array_join(F.transform(sources, line), "\n")
    )


def package_text(package):
    unit = F.when(package["quantity"]["unit"].isin("g", "kg", "ml", "l"), package["quantity"]["unit"]).otherwise("")
    return F.when(
        package.isNotNull(), F.trim(F.concat_ws(" ", show_one(package["quantity"]["value"]), unit))
    )


def panel_views(nutrition):
    """Each panel as a screen shows it: its basis in words and its rows in panel order.

    A row is a figure with its unit, or Unknown where the packet declares none.
    """

    def view(panel, i):
        def row(nutrient):
            value, name = panel["values"][nutrient], F.lit(nutrient)
            absent = F.coalesce(F.array_contains(panel["not_declared"], nutrient), F.lit(False))
            figure = F.concat_ws(" ", show_two(value), unit_of(name))
            shown = F.when(value.isNull(), "Unknown").otherwise(figure)
            made = F.struct(name.alias("nutrient"), display_name(name).alias("display"), shown.alias("shown"))
            return F.when(value.isNotNull() | absent, made)

        rows = F.array_compact(F.array(*[row(n) for n in NUTRIENT_IDS]))
        return F.struct(i.alias("block_index"), basis_label(panel["basis"]).alias("basis_label"), rows.alias("rows"))

    return F.transform(nutrition, view)


def product_scalars(products, brand, today):
    """Names, texts, freshness, completeness and panels of each product, all from its own row."""
    named = display_names(products, brand, "brand", "brand_name")
    checked = F.col("verification.last_verified")
    complete = is_complete("nutrition", F.trim("ingredients_raw"))
    return named.select(
        "gtin",
        "name",
        "brand_name",
        F.array_join(F.array_compact(F.array("brand_name", package_text(F.col("package")))), " · ").alias("description"),
        verification_text(F.col("verification.status")).alias("verification"),
        sources_text(F.col("sources")).alias("sources"),
        freshness(checked, today).alias("freshness"),
        freshness_note(checked, today).alias("freshness_note"),
        complete.alias("is_complete"),
        (~complete).alias("needs_discovery"),
        panel_views(F.col("nutrition")).alias("panels"),
    )


def product_view(products, brand, category, bands, stats, dictionary, today):
    """One wide row per product.

    The parts are grouped by gtin and joined on gtin.
    """
    panels = panel_rows(products, "category").withColumnRenamed("category", "category_id")
    levels = (
        band_rules.nutrient_bands(panels, bands)
        .groupBy("gtin")
        .agg(F.array_sort(F.collect_list(F.struct("block_index", "rule_id", "nutrient", "level", "statement"))).alias("indicators"))
    )
    compared = (
        peers.peer_comparison(panels, stats, category)
        .groupBy("gtin")
        .agg(F.array_sort(F.collect_list(F.struct("block_index", "nutrient", "sentence"))).alias("peers"))
    )
    claimed = phrases.claimed_phrases(products, dictionary, "gtin", "ingredients_raw", tree="ingredients")
    found = phrases.detect(claimed, "gtin").select("gtin", "state", "statement")
    return (
        product_scalars(products, brand, today)
        .join(found, "gtin", "left")
        .join(levels, "gtin", "left")
        .join(compared, "gtin", "left")
    )
