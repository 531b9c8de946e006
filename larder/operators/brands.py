"""Brand and category roll-ups from imported products."""

from pyspark.sql import functions as F

from larder.functions.text import slug_title
from larder.vocab import CATEGORY_MAP


def brand_rollup(products, spec=None, retrieved_at=None):
    """One brand record per slug seen; the name is rebuilt from the slug."""
    found = products.where(F.col("brand").isNotNull()).groupBy("brand").agg(F.count(F.lit(1)).alias("products"))
    brands = found.select(F.col("brand").alias("id"), slug_title(F.col("brand")).alias("name"), "products")
    if spec is None:
        return brands
    evidence = F.struct(
        F.lit("s1").alias("source"), F.lit("medium").alias("confidence"), F.lit(None).cast("string").alias("note")
    )
    source = F.struct(
        F.lit("s1").alias("id"),
        F.lit(spec.type).alias("type"),
        F.concat(F.lit(spec.brand_url), F.col("id")).alias("url"),
        F.lit(str(retrieved_at)).alias("retrieved_at"),
        F.lit(spec.licence).alias("licence"),
        F.lit(None).cast("string").alias("note"),
    )
    return brands.select(
        "id",
        "name",
        F.lit(None).cast("string").alias("owner"),
        F.array(F.lit(spec.country)).alias("countries"),
        F.array(source).alias("sources"),
        F.create_map(F.lit("name"), evidence).alias("provenance"),
        F.lit(1).alias("schema_version"),
    )


def merge_brands(existing, imported):
    """Existing brands whose name and owner are unchanged keep their dates."""
    columns = imported.columns
    old = existing.select("id", F.struct(*columns).alias("_old"))
    new = imported.select("id", F.struct(*columns).alias("_new"))
    same = (F.col("_old.name") == F.col("_new.name")) & F.col("_old.owner").eqNullSafe(F.col("_new.owner"))
    kept = F.when(F.col("_new").isNull() | F.coalesce(same, F.lit(False)), F.col("_old")).otherwise(F.col("_new"))
    return old.join(new, "id", "full_outer").select(kept.alias("_b")).select("_b.*")


def mapped_categories(spark, mapping=CATEGORY_MAP):
    """Distinct categories the mapping can produce."""
    return spark.createDataFrame(mapping, "tag string, category string").select("category").distinct()


def categories_without_record(mapped, category):
    return mapped.join(category.select(F.col("id").alias("category")), "category", "left_anti")
