"""One record per key."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def first_wins(df, key, order):
    """The first row of each key by order.

    The row_number filter lets Spark keep one row per key on the map side before the
    exchange, so a key with a third of all rows sends one row per task.
    """
    return _ranked(df, key, F.col(order).asc() if isinstance(order, str) else order)


def last_wins(df, key, order):
    return _ranked(df, key, F.col(order).desc() if isinstance(order, str) else order)


def _ranked(df, key, order):
    keys = [key] if isinstance(key, str) else list(key)
    orders = order if isinstance(order, (list, tuple)) else [order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*orders))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def duplicate_keys(df, key, path):
    """Second and later records of a key, naming the first holder.

    Counts are combined before the exchange; only keys that repeat are joined back.
    """
    firsts = (
        df.groupBy(key)
        .agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .drop("_n")
    )
    return df.select(key, path).join(firsts, key).where(F.col(path) > F.col("first_path"))
