"""Product and reference records to a catalogue."""

from pyspark.sql import functions as F

from larder.operators import tables as t
from larder.operators.peers import peer_stats, peer_values
from larder.schemas import TABLES
from larder.sources.catalogue import write_catalogue


def catalogue_tables(products, dims, meta, peer_rule=None, starter=None):
    """The 18 catalogue tables by name.

    dims: brand, category, ingredient and country records.  peer_rule: dict with
    minimum_peers, lower_percentile, higher_percentile, nutrients, rule_id, rule_version;
    without it there are no peer rows.  starter keeps the most complete products.
    """
    chosen = t.starter_products(products, starter).drop("score") if starter else products
    tables = {
        "meta": meta,
        "product": t.product_table(chosen),
        "product_country": t.product_country_table(chosen),
        "nutrition": t.nutrition_table(chosen),
        "nutrition_not_declared": t.not_declared_table(chosen),
        "ingredient_item": t.ingredient_item_table(chosen),
        "ingredient": t.ingredient_table(dims["ingredient"]),
        "ingredient_alias": t.ingredient_alias_table(dims["ingredient"]),
        "ingredient_flag": t.ingredient_flag_table(dims["ingredient"]),
        "brand": t.brand_table(dims["brand"]),
        "category": t.category_table(dims["category"]),
        "category_substitute": t.category_substitute_table(dims["category"]),
        "category_nutrient": t.category_nutrient_table(dims["category"]),
        "country": t.country_table(dims["country"]),
        "source": t.source_table(chosen),
        "provenance": t.provenance_table(chosen),
        "product_search": t.product_search_table(chosen),
    }
    tables["category_peer_stat"] = catalogue_peer_stats(chosen, peer_rule)
    return {name: tables[name] for name in TABLES}


def build_catalogue(products, dims, meta, path, peer_rule=None, starter=None):
    """Writes the records once, then every table from those files.

    The plan that makes the products runs once, however many tables read them; each table
    reads its own columns of the written records.
    """
    records = f"{path}/records"
    products.write.mode("overwrite").parquet(records)
    kept = products.sparkSession.read.schema(products.schema).parquet(records)
    write_catalogue(catalogue_tables(kept, dims, meta, peer_rule, starter), path)


def catalogue_peer_stats(products, peer_rule):
    """Cut-offs straight from the records: the panels carry their category, so no join."""
    if peer_rule is None:
        return products.sparkSession.createDataFrame([], TABLES["category_peer_stat"])
    panels = t.panel_rows(products, "category").withColumnRenamed("category", "category_id")
    values = peer_values(panels, peer_rule["nutrients"])
    stats = peer_stats(
        values,
        peer_rule["minimum_peers"],
        peer_rule["lower_percentile"],
        peer_rule["higher_percentile"],
        peer_rule["rule_id"],
        peer_rule["rule_version"],
    )
    return stats.select(*[F.col(c.strip().split(" ")[0]) for c in TABLES["category_peer_stat"].split(",")])
