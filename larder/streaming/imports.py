"""Incremental import of export files as they arrive."""

from pyspark.sql import functions as F

from larder.plans.importing import import_batch


def export_stream(spark, directory, max_files=None):
    """Export lines of new files: value, file, block."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory).select(
        F.make_valid_utf8("value").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def with_order(batch):
    """The stream order of a micro-batch; row numbers exist only inside a batch."""
    order = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    return batch.select("value", order.alias("ord"))


def start_import(lines, root, checkpoint, spec, retrieved_at, today, then=None, **trigger):
    """Runs import_batch on every micro-batch; a repeated batch replaces its own output.

    then(spark, batch_id) follows each batch, for views of the log; it must bear repeating too.
    """

    def write(batch, batch_id):
        import_batch(with_order(batch), root, batch_id, spec, retrieved_at, today)
        if then:
            then(batch.sparkSession, batch_id)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
