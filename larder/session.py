"""Session settings the jobs are written for."""

from pyspark.sql import SparkSession

# AQE picks join sides from measured sizes and splits skewed partitions, so the
# operators hint no broadcast of data that grows with the input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording a Python call site for every column costs seconds on the wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    # So many keys of a small batch are compared with the pages of the record log at once.
    "spark.sql.parquet.pushdown.inFilterThreshold": "500",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cpus="*", shuffle_partitions=8, memory="8g", **extra):
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("larder")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
