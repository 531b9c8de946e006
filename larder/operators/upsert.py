"""Write only what changed."""

from pyspark.sql import functions as F

from larder.operators.quality import with_row_error
from larder.schemas import PRODUCT_COLUMNS


def substance(prefix=""):
    """SHA-256 of a record without its retrieval and verification dates.

    Map entries are sorted so that equal maps give equal text.
    """

    def col(name):
        return F.col(f"{prefix}{name}")

    undated = F.transform(
        col("sources"),
        lambda s: F.struct(s["id"], s["type"], s["url"], s["licence"], s["note"]),
    )
    parts = {
        "names": F.array_sort(F.map_entries(col("names"))),
        "sources": undated,
        "provenance": F.array_sort(F.map_entries(col("provenance"))),
        "verification": col("verification.status"),
    }
    record = F.struct(*[parts.get(name, col(name)).alias(name) for name in PRODUCT_COLUMNS])
    return F.sha2(F.to_json(record), 256)


def upsert_states(existing, candidates, key="gtin"):
    """(key, state) for each candidate: new, changed or unchanged.

    Only keys and fingerprints are joined.
    """
    before = existing.select(key, substance().alias("_before"))
    after = candidates.select(key, substance().alias("_after"))
    state = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_before") == F.col("_after"), "unchanged")
        .otherwise("changed")
    )
    return after.join(before, key, "left").select(key, state.alias("state"))


def upsert(existing, candidates, key="gtin"):
    """All records after the import, with state new, changed, unchanged or untouched.

    An equal candidate leaves the existing row and its dates alone.  One full outer join
    on the key; the candidates must already be unique.
    """
    left = existing.select(key, F.struct(*PRODUCT_COLUMNS).alias("_old"), substance().alias("_before"))
    right = candidates.select(key, F.struct(*PRODUCT_COLUMNS).alias("_new"), substance().alias("_after"))
    state = (
        F.when(F.col("_new").isNull(), "untouched")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_before") == F.col("_after"), "unchanged")
        .otherwise("changed")
    )
    joined = left.join(right, key, "full_outer").select(state.alias("state"), "_old", "_new")
    record = F.when(F.col("state").isin("new", "changed"), F.col("_new")).otherwise(F.col("_old"))
    return joined.select("state", record.alias("_record")).select("_record.*", "state")


def prune_invalid(products, findings, key="gtin"):
    """Products without an error finding, of any rule.  Reference records are never pruned.

    For the rules of a record's own fields alone, prune_broken needs no findings and no join.
    """
    broken = findings.where(F.col("severity") == "error").select(key).distinct()
    return products.join(broken, key, "left_anti")


def prune_broken(products, today):
    """Products that break no row-local rule of severity error; rows stay where they are."""
    return with_row_error(products, today, "_broken").where(~F.col("_broken")).drop("_broken")


def rejections(findings, key="gtin"):
    """First error of every record that has one, in the order in which a record is read.

    Fields come in their written order and their items by number; rules of one place by code.
    """
    field = F.array_position(
        F.array(*[F.lit(c) for c in PRODUCT_COLUMNS]), F.regexp_extract("pointer", "^/([^/]*)", 1)
    )
    item = F.regexp_extract("pointer", "^/[^/]*/([0-9]+)", 1).try_cast("int")
    place = F.struct(
        field.alias("field"), F.coalesce(item, F.lit(-1)).alias("item"), "pointer", "code", "message"
    )
    return (
        findings.where(F.col("severity") == "error")
        .groupBy(key)
        .agg(F.min(place).alias("_first"))
        .select(key, F.col("_first.code").alias("code"), F.col("_first.message").alias("message"))
    )


def rejection_sample(findings, key="gtin", size=50):
    """The report's sample of rejections, in key order."""
    return rejections(findings, key).orderBy(key).limit(size)
