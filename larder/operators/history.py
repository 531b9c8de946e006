"""Scans against the catalogue of their time: validity intervals of the record log, and an as-of join."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def versions(log, key="gtin", at="valid_at"):
    """The log's rows with valid_from and valid_to: from its time until the next batch of the key.

    log: key, at, batch, deleted and what else a record holds.  At equal times the later batch
    counts, and the earlier one is valid never.  A deletion ends the version before it and is
    itself no version.  The last version has no end.  Rows without a key or time are left out.
    """
    order = Window.partitionBy(key).orderBy(at, "batch")
    timed = log.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    spans = timed.withColumn("valid_to", F.lead(at).over(order)).withColumnRenamed(at, "valid_from")
    lasting = F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))
    return spans.where(lasting & ~F.coalesce("deleted", F.lit(False))).drop("deleted", "batch")


def scans_as_of(scans, versions, fields=("name",), keep=(), width=None):
    """keep, gtin, scanned_at, found, and the fields of the version valid at scanned_at.

    A version holds from valid_from, included, to valid_to, not included, so a scan at the very
    time of a batch sees that batch.  A scan that arrives late still sees its own time.  Scans
    without a gtin are left out; those before the first version or in a gap are not found.

    width (seconds) cuts time into stretches and the join goes by code and stretch, so scans of
    a hot code are many keys and meet only the versions of their stretch.  Without a width it
    goes by code alone, as a stream needs it.
    """
    coded = scans.where(F.col("gtin").isNotNull())
    held = versions.select(F.col("gtin").alias("_gtin"), "valid_from", "valid_to", *[F.col(f).alias(f"_{f}") for f in fields])
    on = (F.col("gtin") == F.col("_gtin")) & (F.col("scanned_at") >= F.col("valid_from"))
    on = on & (F.col("valid_to").isNull() | (F.col("scanned_at") < F.col("valid_to")))
    if width:
        stretch = lambda t: F.floor(F.unix_seconds(t) / F.lit(width))
        coded = coded.withColumn("_stretch", stretch(F.col("scanned_at").cast("timestamp")))
        # One row: versions reach no further than the scans do.
        ends = coded.agg(F.min("_stretch").alias("_first"), F.max("_stretch").alias("_last"))
        first = F.greatest(stretch(F.col("valid_from").cast("timestamp")), F.col("_first"))
        last = F.least(stretch(F.col("valid_to").cast("timestamp")), F.col("_last"))
        held = held.crossJoin(F.broadcast(ends)).where(first <= last).withColumn(
            "_at", F.explode(F.sequence(first, last))
        ).drop("_first", "_last")
        on = on & (F.col("_stretch") == F.col("_at"))
    found = F.col("_gtin").isNotNull()
    return coded.join(held, on, "left").select(
        *keep, "gtin", "scanned_at", found.alias("found"), *[F.col(f"_{f}").alias(f) for f in fields]
    )
