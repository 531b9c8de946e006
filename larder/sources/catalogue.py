"""Catalogue tables on disk."""

from pyspark.sql import functions as F

from larder.schemas import TABLES

SUPPORTED_VERSION = "1"


def write_catalogue(tables, path, mode="overwrite"):
    """One Parquet directory per table; those with a gtin are ranged and ordered by it.

    A key lookup then opens one file and prunes its row groups.
    """
    for name, df in tables.items():
        keyed = "gtin" in df.columns
        ranged = df.repartitionByRange("gtin").sortWithinPartitions("gtin") if keyed else df
        ranged.write.mode(mode).parquet(f"{path}/{name}")


def read_catalogue(spark, path):
    """Every table by name.

    A table an older catalogue lacks reads as empty; another schema version is refused.
    """
    tables = {name: _read(spark, f"{path}/{name}", columns) for name, columns in TABLES.items()}
    version = tables["meta"].where(F.col("key") == "schema_version").first()
    if version is not None and version["value"] != SUPPORTED_VERSION:
        raise ValueError(f"catalogue schema version {version['value']} is not {SUPPORTED_VERSION}")
    return tables


def _read(spark, path, columns):
    try:
        return spark.read.schema(columns).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], columns)


def catalogue_status(meta, product):
    """One row: version, build date, product count and whether it can be used."""
    keys = meta.agg(
        *[
            F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
            for k in ("catalogue_version", "schema_version", "built_on", "kind")
        ]
    )
    count = product.agg(F.count(F.lit(1))).scalar()
    usable = (F.col("schema_version") == SUPPORTED_VERSION) & (F.col("product_count") > 0)
    return keys.withColumn("product_count", count).withColumn("usable", F.coalesce(usable, F.lit(False)))
