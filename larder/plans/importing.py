"""Export lines to product records."""

from pyspark.sql import functions as F

from larder.operators.dedup import first_wins
from larder.operators.mapping import accepted, map_products
from larder.operators.quality import with_row_error
from larder.operators.sizes import written
from larder.operators.upsert import substance
from larder.sources.export import decode_lines
from larder.sources.record_log import append_batch, few_keys, fingerprints, merge_runs


def map_lines(lines, spec, retrieved_at, order="ord"):
    """Every line as product columns or a drop reason, with its stream order."""
    return map_products(decode_lines(lines), spec, retrieved_at, keep=(order,))


def import_products(lines, spec, retrieved_at, order="ord"):
    """Accepted products, first line of each key."""
    return products_of(map_lines(lines, spec, retrieved_at, order), order)


def products_of(mapped, order="ord"):
    """Accepted products of mapped lines, first line of each key."""
    return first_wins(accepted(mapped), "gtin", order).drop(order)


def changes_against(latest, candidates, today):
    """Records a batch must write: new or changed ones, and prunes of records now in error.

    latest: gtin, substance, deleted as they were.  Unchanged candidates write nothing, so
    their dates stay.
    """
    before = latest.select(
        "gtin", F.col("substance").alias("_before"), F.col("deleted").alias("_gone")
    )
    live = F.col("_before").isNotNull() & ~F.col("_gone")
    compared = candidates.withColumn("substance", substance()).join(before, "gtin", "left")
    written = compared.where(~F.coalesce(live & (F.col("_before") == F.col("substance")), F.lit(False)))
    judged = with_row_error(written, today, "deleted")
    # A bad record that was never live leaves no trace; one that was live is marked deleted.
    return judged.where(~F.col("deleted") | F.coalesce(live, F.lit(False))).drop("_before", "_gone")


def import_batch(lines, root, batch, spec, retrieved_at, today, order="ord"):
    """Import one batch of lines into the record log at root.  Safe to repeat.

    The batch is mapped once and written; of the log, a small batch reads the pages that may
    hold its keys.  The batches before it are merged by size once it is in.
    """
    spark = lines.sparkSession
    candidates = written(import_products(lines, spec, retrieved_at, order))
    latest = fingerprints(spark, root, batch, few_keys(candidates))
    append_batch(changes_against(latest, candidates, today), root, batch)
    merge_runs(spark, root, batch)
