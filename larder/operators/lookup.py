"""Finding products by code, and names by id."""

from pyspark.sql import functions as F

from larder.functions.barcodes import normalize_gtin


def lookup_products(probes, product, code):
    """Probe codes of any width against the catalogue; unknown and invalid codes stay, unfound.

    One join on the key, each side exchanged once; AQE splits the probes of a popular code.
    Probes without a key join nothing, so they do not meet in one partition.
    """
    keyed = probes.select("*", F.explode_outer(F.array(normalize_gtin(F.col(code)))).alias("gtin"))
    known = product.withColumn("_known", F.lit(True))
    found = keyed.where(F.col("gtin").isNotNull()).join(known, "gtin", "left")
    invalid = keyed.where(F.col("gtin").isNull())
    return (
        found.unionByName(invalid, allowMissingColumns=True)
        .withColumn("found", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def product_count(product):
    return product.agg(F.count(F.lit(1)).alias("products"))


def display_names(refs, names, id_column, name_column="display_name"):
    """Name of a referenced brand or category, else the id itself."""
    known = names.select(F.col("id").alias(id_column), F.col("name").alias("_name"))
    return refs.join(known, id_column, "left").withColumn(
        name_column, F.coalesce("_name", id_column)
    ).drop("_name")
