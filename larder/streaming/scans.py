"""Scan log as a stream."""

from larder.operators.scans import enrich_scans, miss_demand


def enriched_stream(scans, product, delay, raw="raw", keep=()):
    """Streaming scans with found, recorded once per (gtin, scanned_at).

    delay bounds the state kept to recognise a repeated scan.
    """
    timed = scans.withWatermark("scanned_at", delay)
    enriched = enrich_scans(timed, product, raw, keep)
    return enriched.dropDuplicatesWithinWatermark([*keep, "gtin", "scanned_at"])


def write_scans(enriched, path, checkpoint, **trigger):
    return (
        enriched.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def demand_stream(enriched):
    """Misses per code; sort is allowed because the sink is in complete mode."""
    return miss_demand(enriched)
