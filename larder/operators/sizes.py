"""Join sides whose size is checked before they are broadcast."""

from pyspark.sql import functions as F

from larder.sources.scratch import new_folder

BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df, max_bytes=BROADCAST_BYTES):
    """df with a broadcast hint when its measured size allows it, else with one that forbids it.

    The size is one aggregated number.  Beyond the bound the join is a merge join, which AQE
    splits where keys are skewed: without a hint Spark would broadcast df whenever its files
    are small, and compressed files are many times smaller than the rows it sends.  For
    dimensions and dictionaries only, since df is read once for the check.
    """
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df.hint("merge")


def written(df):
    """df, written to the shared folder and read again, so that measuring it computes nothing twice."""
    spark = df.sparkSession
    path = new_folder(spark, "side")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
