"""Export rows to product records, or to a reason why not."""

from pyspark.sql import functions as F

from larder import schemas, vocab
from larder.functions.barcodes import format_from_length, normalize_gtin
from larder.functions.numbers import parse_number, round_half_away
from larder.functions.text import clean_text, first_of_list, map_category, slug, strip, truncate
from larder.sources.export import NUTRIENT_FIELDS, TEXT_FIELDS

SOURCE_KEY = "s1"


def in_region(printed, countries_tags, tag, prefix):
    listed = F.lower(F.coalesce(countries_tags, F.lit(""))).contains(tag.lower())
    return listed | printed.startswith(prefix)


def cleaned_rows(rows, keep=()):
    """Export fields with blanks as nulls, and the figures of the declared basis as numbers.

    Per-100 ml shares the per-100 g columns.  No basis is assumed when none is declared.
    """
    filled = rows.select(
        *keep,
        "malformed",
        *[F.nullif(strip(F.col(f)), F.lit("")).alias(f) for f in TEXT_FIELDS],
        *[F.col(f) for f in NUTRIENT_FIELDS],
    )
    declared = F.lower(F.col("nutrition_data_per"))
    basis = (
        F.when(declared == "100g", "per_100g")
        .when(declared == "100ml", "per_100ml")
        .when(declared == "serving", "per_serving")
    )
    placed = filled.withColumn("basis", basis)

    def figure(stem):
        chosen = F.when(F.col("basis") == "per_serving", F.col(f"{stem}_serving")).otherwise(
            F.col(f"{stem}_100g")
        )
        return F.when(F.col("basis").isNotNull(), chosen)

    others = [*keep, "malformed", *TEXT_FIELDS, "basis"]
    texts = placed.select(*others, *[figure(stem).alias(n) for n, stem, _ in vocab.EXPORT_NUTRIENTS])
    parsed = texts.select(
        *others, *[parse_number(F.col(n)).alias(n) for n, _, _ in vocab.EXPORT_NUTRIENTS]
    )
    # Sodium becomes milligrams before rounding.
    return parsed.select(
        *others,
        *[
            round_half_away(F.col(n) * scale if scale != 1 else F.col(n)).alias(n)
            for n, _, scale in vocab.EXPORT_NUTRIENTS
        ],
    )


def drop_reason(spec):
    """First reason that applies, or null for a row that becomes a product."""
    sold_here = in_region(
        F.col("barcode_printed"), F.col("countries_tags"), spec.region_tag, spec.region_prefix
    )
    return (
        F.when(F.col("malformed"), vocab.DROP_MALFORMED)
        .when(F.col("gtin").isNull(), vocab.DROP_BARCODE)
        .when(~sold_here, vocab.DROP_REGION)
        .when(F.col("name").isNull() | (F.length("name") < 2), vocab.DROP_NAME)
    )


def package_struct(amount, unit_text):
    unit = F.when(F.lower(unit_text).isin("ml", "l"), "ml").otherwise("g")
    return F.when(
        amount > 0,
        F.struct(
            F.struct(amount.alias("value"), unit.alias("unit")).alias("quantity"),
            F.lit(None).cast("int").alias("multipack_count"),
        ),
    )


def nutrition_panel():
    """The panel of the declared basis, or null.

    A serving panel needs a serving text, and a panel without any figure is no panel.
    """
    grams = F.col("serving_grams")
    serving = F.when(
        (F.col("basis") == "per_serving") & F.col("serving_size").isNotNull(),
        F.struct(
            truncate(F.col("serving_size"), 100).alias("description"),
            F.when(grams > 0, F.struct(grams.alias("value"), F.lit("g").alias("unit"))).alias("quantity"),
        ),
    )
    figures = {n for n, _, _ in vocab.EXPORT_NUTRIENTS}
    values = F.struct(
        *[(F.col(n) if n in figures else F.lit(None).cast("double")).alias(n) for n in vocab.NUTRIENT_IDS]
    )
    panel = F.struct(
        F.col("basis"),
        serving.alias("serving"),
        values.alias("values"),
        F.lit(None).cast("array<string>").alias("not_declared"),
    )
    any_figure = F.coalesce(*[F.col(n) for n in sorted(figures)]).isNotNull()
    described = (F.col("basis") != "per_serving") | F.col("serving_size").isNotNull()
    return F.when(any_figure & described, panel)


def stamp_provenance(**present):
    """Entry (s1, medium) for every path whose value is present."""
    evidence = F.struct(
        F.lit(SOURCE_KEY).alias("source"),
        F.lit("medium").alias("confidence"),
        F.lit(None).cast("string").alias("note"),
    )
    entries = F.array(
        *[
            F.when(is_present, F.struct(F.lit(path).alias("key"), evidence.alias("value")))
            for path, is_present in present.items()
        ]
    )
    return F.map_from_entries(F.array_compact(entries))


def map_products(rows, spec, retrieved_at, keep=()):
    """Product columns and drop_reason for every export row; keep passes columns through.

    The product columns of a dropped row are not meaningful.
    """
    day = F.lit(str(retrieved_at))
    figures = [n for n, _, _ in vocab.EXPORT_NUTRIENTS]
    named = cleaned_rows(rows, keep).select(
        *keep,
        "malformed",
        "basis",
        *figures,
        "countries_tags",
        F.coalesce("code", F.lit("")).alias("barcode_printed"),
        normalize_gtin(F.col("code")).alias("gtin"),
        clean_text(F.col("product_name")).alias("name"),
        slug(first_of_list(F.col("brands"))).alias("brand"),
        map_category(F.col("categories_tags")).alias("category"),
        parse_number(F.col("product_quantity")).alias("amount"),
        "product_quantity_unit",
        clean_text(F.col("serving_size")).alias("serving_size"),
        parse_number(F.col("serving_quantity")).alias("serving_grams"),
        clean_text(F.col("ingredients_text")).alias("ingredients_raw"),
    )
    ready = named.select(
        *keep,
        drop_reason(spec).alias("drop_reason"),
        "gtin",
        "barcode_printed",
        truncate(F.col("name"), 200).alias("name"),
        "brand",
        "category",
        package_struct(F.col("amount"), F.col("product_quantity_unit")).alias("package"),
        nutrition_panel().alias("panel"),
        truncate(F.col("ingredients_raw"), 4000).alias("ingredients_raw"),
    )
    source = F.struct(
        F.lit(SOURCE_KEY).alias("id"),
        F.lit(spec.type).alias("type"),
        F.concat(F.lit(spec.product_url), F.col("barcode_printed")).alias("url"),
        day.alias("retrieved_at"),
        F.lit(spec.licence).alias("licence"),
        F.lit(None).cast("string").alias("note"),
    )
    columns = {
        "barcode_format": format_from_length(F.col("barcode_printed")),
        "names": F.lit(None),
        "countries": F.array(F.lit(spec.country)),
        "nutrition": F.when(F.col("panel").isNotNull(), F.array("panel")),
        "ingredients": F.lit(None),
        "sources": F.array(source),
        "provenance": stamp_provenance(
            name=F.lit(True),
            brand=F.col("brand").isNotNull(),
            category=F.col("category").isNotNull(),
            package=F.col("package").isNotNull(),
            nutrition=F.col("panel").isNotNull(),
            ingredients_raw=F.col("ingredients_raw").isNotNull(),
        ),
        "conflicts": F.lit(None),
        "verification": F.struct(F.lit("unverified").alias("status"), day.alias("last_verified")),
        "schema_version": F.lit(1),
    }
    mapped = [
        *[F.col(c) for c in keep],
        F.col("drop_reason"),
        *[columns.get(name, F.col(name)).cast(kind).alias(name) for name, kind in schemas.PRODUCT_FIELDS],
    ]
    # A generator of one row: without it a filter on drop_reason is pushed below and every
    # field it needs is worked out twice.  The row is made before it, where Spark compiles it.
    whole = ready.select(F.struct(*mapped).alias("_row"))
    return whole.select(F.inline_outer(F.array("_row")))


def accepted(mapped, limit=None):
    """Rows that became products; limit is for smoke runs only."""
    products = mapped.where(F.col("drop_reason").isNull()).drop("drop_reason")
    return products.limit(limit) if limit else products


def is_complete(nutrition="nutrition", ingredients_raw="ingredients_raw"):
    """A product with neither a panel nor ingredient text is incomplete."""
    return F.coalesce(F.size(nutrition) > 0, F.lit(False)) | F.coalesce(
        F.nullif(ingredients_raw, F.lit("")).isNotNull(), F.lit(False)
    )

