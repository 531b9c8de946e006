"""Run reports."""

from pyspark.sql import functions as F

from larder.operators.mapping import is_complete
from larder.operators.sizes import written


def import_report(mapped, order="ord"):
    """One row of counts over mapped rows: read, mapped, dropped, duplicates, incomplete.

    Rows are combined per key before the exchange, so dropped rows (null key) and popular
    keys cost one row per task.
    """
    dropped = F.col("drop_reason").isNotNull()
    key = F.when(~dropped, F.col("gtin"))
    first = F.min(F.when(~dropped, F.struct(order, (~is_complete()).alias("gap"))))
    per_key = mapped.groupBy(key.alias("_key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dropped).alias("dropped"), first.alias("first")
    )
    kept = F.col("_key").isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates_read"),
        F.count_if(kept).alias("mapped"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(kept & F.col("first.gap")).alias("incomplete"),
    )


def upsert_counts(states):
    """Written and unchanged counts of an upsert."""
    return states.agg(
        F.count_if(F.col("state").isin("new", "changed")).alias("written"),
        F.count_if(F.col("state") == "unchanged").alias("unchanged"),
    )


def run_report(mapped, states, judged, broken, sample=50, order="ord"):
    """The whole report of an import as one row.

    mapped: rows of map_lines; states: rows of upsert_states; judged: products with a flag
    `broken` of those that the validator rejects.  Adds to import_report what was written and
    unchanged, how many were rejected with the first keys of them, and the drop reasons with
    their counts.  Each part is one row, so the parts are put side by side.
    """
    reasons = drop_reason_counts(mapped).agg(
        F.array_sort(F.collect_list(F.struct("drop_reason", "rows"))).alias("drop_reasons")
    )
    lost = written(judged.where(F.col(broken)).select("gtin"))
    keys = lost.orderBy("gtin").limit(sample).agg(F.array_sort(F.collect_list("gtin")).alias("rejected_sample"))
    rejected = lost.agg(F.count(F.lit(1)).alias("rejected"))
    row = import_report(mapped, order)
    for part in (upsert_counts(states), rejected, keys, reasons):
        row = row.crossJoin(part)
    return row


def drop_reason_counts(mapped):
    return (
        mapped.where(F.col("drop_reason").isNotNull())
        .groupBy("drop_reason")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "drop_reason")
    )


def gap_queue(products):
    """Products with neither nutrition nor ingredients, by key."""
    return products.where(~is_complete()).select("gtin", "name").orderBy("gtin")


def build_counts(products):
    return products.agg(
        F.count(F.lit(1)).alias("products"), F.count_if(~is_complete()).alias("incomplete")
    )


def row_number_of(df):
    """A number for the content of a row of df: the first 12 digits of the md5 of its columns.

    Null is told from every text, and nested columns are taken as JSON.
    """

    def shown(name, kind):
        nested = kind.startswith(("array", "map", "struct"))
        return F.to_json(name) if nested else F.col(name).cast("string")

    parts = [
        F.coalesce(F.concat(F.lit("="), shown(name, kind)), F.lit("-")) for name, kind in df.dtypes
    ]
    head = F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 12)
    return F.conv(head, 16, 10).cast("decimal(38,0)")


def content_fingerprint(df):
    """Order-independent fingerprint of a table: equal content, equal number."""
    total = F.coalesce(F.sum(row_number_of(df)), F.lit(0))
    return df.agg(total.cast("decimal(38,0)").alias("fingerprint"))


CONTENT = ("gtin", "name", "ingredients_raw")


def _section(products, prefix=""):
    """Counts and content fingerprint of one artefact, in one pass."""
    number = row_number_of(products.select(*CONTENT))
    return products.agg(
        F.count(F.lit(1)).alias(f"{prefix}products"),
        F.count_if(~is_complete()).alias(f"{prefix}incomplete"),
        F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"{prefix}content"),
    )


def build_manifest(
    products, catalogue_version, built_on, spec, kind="full", schema_version=1,
    minimum_app_version="1.0.0", starter=None,
):
    """One row describing a built catalogue: its own counts and content, and its starter's.

    Without a starter the starter columns are null.
    """
    # Names of the manifest columns.
    whole = _section(products)
    if starter is None:
        part = [
            F.lit(None).cast(t).alias(f"starter_{n}")
            for n, t in (("products", "long"), ("incomplete", "long"), ("content", "string"))
        ]
        described = whole.select("*", *part)
    else:
        described = whole.crossJoin(_section(starter, "starter_"))  # one row each
    return described.select(
        F.lit(catalogue_version).alias("catalogue_version"),
        F.lit(schema_version).alias("schema_version"),
        F.lit(minimum_app_version).alias("minimum_app_version"),
        F.lit(str(built_on)).alias("built_on"),
        F.lit(kind).alias("kind"),
        F.lit(spec.licence).alias("licence"),
        F.lit(spec.attribution).alias("attribution"),
        "*",
    )


def findings_summary(findings, strict=False):
    """Counts per severity and the verdict: errors block, warnings too when strict."""
    errors = F.count_if(F.col("severity") == "error")
    warnings = F.count_if(F.col("severity") == "warning")
    return findings.agg(
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("notes"),
        ((errors > 0) | (F.lit(strict) & (warnings > 0))).alias("blocked"),
    )
