"""Product and reference records to catalogue tables, and back."""

from functools import reduce

from pyspark.sql import functions as F

from larder.functions.nutrients import declared_count
from larder.operators.dedup import last_wins
from larder.operators.ingredients import flatten_ingredients
from larder.operators.mapping import is_complete
from larder.schemas import TABLES
from larder.vocab import NUTRIENT_IDS


def _shaped(df, table):
    """Select and cast to the declared columns of a table."""
    columns = [c.strip().split(" ") for c in TABLES[table].split(",")]
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns])


def product_table(products):
    return _shaped(
        products.select(
            "gtin",
            "barcode_printed",
            "barcode_format",
            "name",
            F.col("brand").alias("brand_id"),
            F.col("category").alias("category_id"),
            F.col("package.quantity.value").alias("package_value"),
            F.col("package.quantity.unit").alias("package_unit"),
            F.col("package.multipack_count").alias("multipack_count"),
            "ingredients_raw",
            F.col("verification.status").alias("verification_status"),
            F.col("verification.last_verified").alias("last_verified"),
            is_complete().cast("int").alias("is_complete"),
        ),
        "product",
    )


def product_country_table(products):
    """Duplicates inside one record are removed in the row, so no shuffle is needed."""
    return products.select("gtin", F.explode(F.array_distinct("countries")).alias("country"))


def panels(products, *keep):
    """One row per nutrition panel: gtin, keep, block_index, panel."""
    return products.select("gtin", *keep, F.posexplode("nutrition").alias("block_index", "panel"))


def panel_rows(products, *keep):
    """Panels as flat columns: gtin, keep, block_index, basis, serving, nutrients, not_declared."""
    return panels(products, *keep).select(
        "gtin",
        *[F.col(c) for c in keep],
        "block_index",
        F.col("panel.basis").alias("basis"),
        F.col("panel.serving.description").alias("serving_description"),
        F.col("panel.serving.quantity.value").alias("serving_value"),
        F.col("panel.serving.quantity.unit").alias("serving_unit"),
        *[F.col(f"panel.values.{n}").alias(n) for n in NUTRIENT_IDS],
        F.col("panel.not_declared").alias("not_declared"),
    )


def nutrition_table(products):
    return _shaped(panel_rows(products), "nutrition")


def not_declared_table(products):
    return panels(products).select(
        "gtin", "block_index", F.explode(F.array_distinct("panel.not_declared")).alias("field")
    )


def ingredient_item_table(products):
    return _shaped(flatten_ingredients(products), "ingredient_item")


def source_table(products):
    """First entry per (gtin, source_id); a repeated id inside a record is ignored."""
    listed = products.select("gtin", "sources", F.posexplode("sources").alias("_i", "s"))
    first = listed.where(F.array_position("sources.id", F.col("s.id")) == F.col("_i") + 1)
    return _shaped(
        first.select(
            "gtin",
            F.col("s.id").alias("source_id"),
            F.col("s.type").alias("type"),
            F.col("s.url").alias("url"),
            F.col("s.retrieved_at").alias("retrieved_at"),
            F.col("s.licence").alias("licence"),
        ),
        "source",
    )


def provenance_table(products):
    return products.select("gtin", F.explode("provenance").alias("path", "e")).select(
        "gtin", "path", F.col("e.source").alias("source_id"), F.col("e.confidence").alias("confidence")
    )


def product_search_table(products):
    return products.select("name", F.coalesce("brand", F.lit("")).alias("brand"), "gtin")


def brand_table(brands, order=None):
    """Last record of an id wins when an order column is given."""
    return _shaped(_replace(brands, "id", order), "brand")


def category_table(categories, order=None):
    rows = _replace(categories, "id", order).withColumnRenamed("parent", "parent_id")
    return _shaped(rows, "category")


def category_substitute_table(categories):
    return categories.select(
        F.col("id").alias("category_id"), F.explode("substitutable_with").alias("substitute_id")
    ).distinct()


def category_nutrient_table(categories):
    return categories.select(
        F.col("id").alias("category_id"), F.explode("relevant_nutrients").alias("field")
    ).distinct()


def ingredient_table(ingredients, order=None):
    return _shaped(_replace(ingredients, "id", order), "ingredient")


def ingredient_alias_table(ingredients):
    return ingredients.select(F.col("id").alias("ingredient_id"), F.explode("aliases").alias("alias")).distinct()


def ingredient_flag_table(ingredients):
    return ingredients.select(F.col("id").alias("ingredient_id"), F.explode("flags").alias("flag")).distinct()


def country_table(countries, order=None):
    rows = _replace(countries, "code", order).withColumnRenamed("default_nutrition_basis", "default_basis")
    return _shaped(rows, "country")


def _replace(df, key, order):
    return last_wins(df, key, order) if order else df


def meta_table(spark, catalogue_version, built_on, spec, kind="full", minimum_app_version="1.0.0"):
    # Keys of the metadata table.
    rows = [
        ("catalogue_version", str(catalogue_version)),
        ("schema_version", "1"),
        ("built_on", str(built_on)),
        ("minimum_app_version", minimum_app_version),
        ("kind", kind),
        ("licence", spec.licence),
        ("attribution", spec.attribution),
    ]
    return spark.createDataFrame(rows, TABLES["meta"])


def load_dictionary(ingredient, ingredient_alias, ingredient_flag):
    """Ingredient rows with their aliases and flags as sorted arrays; null when none."""
    aliases = ingredient_alias.groupBy(F.col("ingredient_id").alias("id")).agg(
        F.array_sort(F.collect_list("alias")).alias("aliases")
    )
    flags = ingredient_flag.groupBy(F.col("ingredient_id").alias("id")).agg(
        F.array_sort(F.collect_list("flag")).alias("flags")
    )
    return ingredient.join(aliases, "id", "left").join(flags, "id", "left")


def assemble_products(tables):
    """Nested records from the catalogue tables.

    Children are grouped by gtin and joined on gtin, so each table is exchanged once.
    The ingredient tree is not rebuilt; it reads back as null.
    """

    def gathered(df, name, item, order):
        """Children of a record in order, as an array."""
        listed = F.array_sort(F.collect_list(F.struct(*order, item.alias("_item"))))
        return df.groupBy("gtin").agg(F.transform(listed, lambda x: x["_item"]).alias(name))

    serving = F.struct(
        F.col("serving_description").alias("description"),
        F.when(
            F.col("serving_value").isNotNull(),
            F.struct(F.col("serving_value").alias("value"), F.col("serving_unit").alias("unit")),
        ).alias("quantity"),
    )
    panel = F.struct(
        "basis",
        F.when(F.col("serving_description").isNotNull(), serving).alias("serving"),
        F.struct(*NUTRIENT_IDS).alias("values"),
        "block_index",
    )
    children = [
        gathered(tables["product_country"], "countries", F.col("country"), ["country"]),
        gathered(tables["nutrition"], "nutrition", panel, ["block_index"]),
        gathered(
            tables["nutrition_not_declared"], "_missing", F.struct("block_index", "field"), ["block_index", "field"]
        ),
        gathered(
            tables["source"],
            "sources",
            F.struct(F.col("source_id").alias("id"), "type", "url", "retrieved_at", "licence"),
            ["source_id"],
        ),
        gathered(
            tables["provenance"],
            "provenance",
            F.struct("path", F.struct(F.col("source_id").alias("source"), "confidence").alias("entry")),
            ["path"],
        ).withColumn("provenance", F.map_from_entries("provenance")),
    ]
    joined = reduce(lambda left, right: left.join(right, "gtin", "left"), children, tables["product"])

    def fields_of(block):
        """The fields a block does not declare; null without any."""
        own = F.filter("_missing", lambda m: m["block_index"] == block)
        return F.when(F.size(own) > 0, F.transform(own, lambda m: m["field"]))

    nutrition = F.transform(
        "nutrition",
        lambda p: p.dropFields("block_index").withField("not_declared", fields_of(p["block_index"])),
    )
    package = F.struct(
        F.struct(F.col("package_value").alias("value"), F.col("package_unit").alias("unit")).alias("quantity"),
        F.col("multipack_count").alias("multipack_count"),
    )
    return joined.select(
        "gtin",
        "barcode_printed",
        "barcode_format",
        "name",
        F.col("brand_id").alias("brand"),
        F.col("category_id").alias("category"),
        F.coalesce("countries", F.array().cast("array<string>")).alias("countries"),
        F.when(F.col("package_value").isNotNull(), package).alias("package"),
        nutrition.alias("nutrition"),
        "ingredients_raw",
        F.lit(None).cast("string").alias("ingredients"),
        F.coalesce("sources", F.array().cast(children[3].schema["sources"].dataType)).alias("sources"),
        "provenance",
        F.struct(F.col("verification_status").alias("status"), "last_verified").alias("verification"),
        F.lit(1).alias("schema_version"),
    )


def starter_products(products, size):
    """The most complete products: score descending, then key.  Output order is by key.

    Only keys and scores are ranked; the records are joined to the chosen keys.
    """
    first = F.get(F.col("nutrition"), F.lit(0))["values"]
    panel = 4 + F.least(F.lit(4), F.floor(declared_count(first) / 3).cast("int"))
    score = (
        F.when(F.size("nutrition") > 0, panel).otherwise(0)
        + F.when(F.col("ingredients_raw") != "", 3).otherwise(0)
        + F.col("brand").isNotNull().cast("int")
        + F.col("category").isNotNull().cast("int")
        + F.col("package").isNotNull().cast("int")
    )
    scored = products.select("gtin", score.alias("score")).where(F.col("score") > 0)
    chosen = scored.orderBy(F.desc("score"), "gtin").limit(size)
    return products.join(chosen, "gtin").select(*products.columns, "score").orderBy("gtin")

