"""Scan logs: classify, look up, rank."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions.barcodes import scan_kind, scan_message, scanned_gtin


def with_scanned_key(scans, raw="raw"):
    """Adds gtin, null when the scan is no product.

    A generator of one row: a null filter on gtin would otherwise be pushed below and
    decode every scan twice.
    """
    return scans.select("*", F.explode_outer(F.array(scanned_gtin(F.col(raw)))).alias("gtin"))


def classify_scans(scans, raw="raw"):
    """Adds kind, gtin and message."""
    code = F.col(raw)
    return with_scanned_key(scans, raw).withColumn("kind", scan_kind(code, F.col("gtin"))).withColumn(
        "message", scan_message(code, F.col("kind"))
    )


def enrich_scans(scans, product, raw="raw", keep=()):
    """Product scans with whether the catalogue has the code: keep, gtin, scanned_at, found.

    Works on batch and streaming scans.  Hits and misses are both recorded.
    """
    known = product.select("gtin", F.lit(True).alias("_known"))
    coded = with_scanned_key(scans, raw).where(F.col("gtin").isNotNull())
    return coded.join(known, "gtin", "left").select(
        *keep, "gtin", "scanned_at", F.coalesce("_known", F.lit(False)).alias("found")
    )


def record_scans(enriched, keep=()):
    """One row per (gtin, scanned_at): recording a scan twice changes nothing."""
    return enriched.dropDuplicates([*keep, "gtin", "scanned_at"])


def recent_scans(scans, limit, per=None):
    """Latest scans, overall or per user.  Ties are broken by gtin."""
    order = [F.desc("scanned_at"), F.asc("gtin")]
    if per is None:
        return scans.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy(per).orderBy(*order))
    return scans.withColumn("position", place).where(F.col("position") <= limit)


def scan_history_named(scans, product):
    """Scans with today's product name, else the code.

    Only scans recorded as found are looked up, and found is evaluated again.
    """
    names = product.select("gtin", F.col("name").alias("_name"))
    name = F.when(F.col("found"), F.col("_name"))
    return (
        scans.join(names, "gtin", "left")
        .withColumn("title", F.coalesce(name, F.col("gtin")))
        .withColumn("found", name.isNotNull())
        .drop("_name")
    )


def miss_demand(enriched):
    """Codes the catalogue lacks, by number of scans."""
    return (
        enriched.where(~F.col("found"))
        .groupBy("gtin")
        .agg(F.count(F.lit(1)).alias("scans"))
        .orderBy(F.desc("scans"), "gtin")
    )


def heavy_misses(enriched, window, share):
    """window_start, gtin, scans, total: codes with more than 1 / share of a window's misses, exactly."""
    counts = (
        enriched.where(~F.col("found"))
        .groupBy(F.window("scanned_at", window)["start"].alias("window_start"), "gtin")
        .agg(F.count(F.lit(1)).alias("scans"))
    )
    totals = counts.groupBy("window_start").agg(F.sum("scans").alias("total"))
    return counts.join(totals, "window_start").where(F.col("scans") * share > F.col("total"))
