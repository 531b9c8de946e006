"""Record trees and the sharded record sink."""

from pyspark.sql import functions as F

from larder import schemas
from larder.functions.barcodes import gtin_shard


def read_record_text(spark, directory, base=None):
    """(path, text) of every *.json below a directory; path is relative to base when given."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(directory, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    if base is not None:
        path = F.regexp_replace(path, "^.*?" + base.rstrip("/").replace(".", "\\.") + "/", "")
    return files.select(path.alias("path"), F.col("value").alias("text"))


def read_records(spark, directory, schema, glob="*.json"):
    """Typed records of a directory tree, with their path; a missing directory is empty."""
    try:
        files = (
            spark.read.schema(schema)
            .option("multiLine", "true")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .json(directory)
        )
        return files.select(F.col("_metadata.file_path").alias("path"), "*")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"path string, {schema}")


def parse_records(records, key="path", text="text"):
    """Product columns of record text; keeps the key, and the text as raw."""
    record = F.from_json(F.col(text), schemas.PRODUCT)
    return records.select(key, F.col(text).alias("raw"), record.alias("_r")).select(key, "raw", "_r.*")


def write_records(products, path, mode="overwrite"):
    """Records by shard.

    Only the touched shards are replaced under dynamic overwrite.  Rows are rebalanced by
    shard: AQE splits the shard that holds most codes and puts small ones together, so a
    shard is a few files of even size.  Rows are ordered by key inside each file, so key
    lookups prune row groups.
    """
    (
        products.withColumn("shard", gtin_shard(F.col("gtin")))
        .hint("rebalance", F.col("shard"))
        .sortWithinPartitions("shard", "gtin")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(path)
    )
