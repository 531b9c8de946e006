"""The product export: one JSON object per line, or flat delimited rows."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from larder.vocab import EXPORT_LICENCE, EXPORT_NUTRIENTS, WHITESPACE

# Fields of an export row.
TEXT_FIELDS = [
    "code",
    "product_name",
    "brands",
    "countries_tags",
    "categories_tags",
    "nutrition_data_per",
    "serving_size",
    "serving_quantity",
    "product_quantity",
    "product_quantity_unit",
    "ingredients_text",
]
NUTRIENT_FIELDS = [f"{stem}{suffix}" for suffix in ("_100g", "_serving") for _, stem, _ in EXPORT_NUTRIENTS]
FIELDS = TEXT_FIELDS + NUTRIENT_FIELDS


@dataclass(frozen=True)
class SourceSpec:
    """What the mapper must know about a source.  A licence is required."""

    id: str
    licence: str
    attribution: str
    product_url: str
    brand_url: str
    type: str = "open_database"
    region_tag: str = "en:india"
    region_prefix: str = "890"
    country: str = "IN"

    def __post_init__(self):
        if not self.licence.strip() or not self.attribution.strip():
            raise ValueError(f"source {self.id} must state its licence and attribution")


# The open database export.
OPEN_DATABASE = SourceSpec(
    id="open-food-facts",
    licence=EXPORT_LICENCE,
    attribution="Contains data from Open Food Facts (https://world.openfoodfacts.org), made available "
    "under the Open Database License (ODbL) v1.0.",
    product_url="https://world.openfoodfacts.org/product/",
    brand_url="https://world.openfoodfacts.org/brand/",
)
SOURCES = {OPEN_DATABASE.id: OPEN_DATABASE}


def source_spec(source_id):
    """The spec of an allowed source."""
    if source_id not in SOURCES:
        raise ValueError(f"source {source_id} is not on the list of allowed sources")
    return SOURCES[source_id]


def read_lines(spark, path, spread=None, skip_corrupt=False):
    """Export lines with their stream order: columns value, ord.

    ord sorts by file, then offset of the split, then row within the split, so it does
    not depend on how Spark packs splits into tasks.  A .gz file is one split: pass
    spread to share its lines out before the parsing.

    A file that cannot be read to its end fails the job.  With skip_corrupt the lines before
    the fault are kept; read_extent then reports how much of each file they are.
    """
    lines = (
        spark.read.option("ignoreCorruptFiles", str(bool(skip_corrupt)).lower())
        .text(path)
        .select(
            F.make_valid_utf8("value").alias("value"),
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ord"),
        )
        .where(F.col("value") != "")
    )
    return lines.repartition(spread, F.col("ord.row")) if spread else lines


def read_extent(lines):
    """How much of each file was read: file, lines, bytes, whole (its last line is an object).

    For runs with skip_corrupt, where a file may end before its end: Spark gives no more than
    the lines before the fault, so a report shows what they are, not what is missing.
    """
    last = F.max_by(F.col("value"), F.struct("ord.block", "ord.row"))
    ends = lines.groupBy(F.col("ord.file").alias("file")).agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), last.alias("value")
    )
    whole = F.btrim(F.col("value"), F.lit(WHITESPACE)).endswith("}")
    return ends.select("file", "lines", "bytes", whole.alias("whole"))


# What is not strict JSON is malformed.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _last(keys, texts, name):
    """The text of the last member of that name; keys and texts run backwards."""
    return F.get(texts, F.array_position(keys, name) - 1)


def _members(top):
    """Names and texts of a parsed object's members, the last first."""
    return F.reverse(F.map_keys(top)), F.reverse(F.map_values(top))


def decode_lines(lines, value="value"):
    """One string column per export field, plus malformed; other columns stay.

    A field is looked up at the top level first, and a null there hides the value in
    nutriments.  Of members that repeat a name the last counts.  Empty lines are not rows.
    The line is parsed once, nutriments once more.
    """
    others = [F.col(c) for c in lines.columns if c != value]
    text = F.btrim(F.col(value), F.lit(WHITESPACE))
    whole = text.startswith("{") & text.endswith("}")
    top = F.when(whole, F.from_json(F.col(value), "map<string,string>", STRICT))
    parsed = lines.where(F.col(value) != "").select(*others, F.col(value).alias("_line"), top.alias("_top"))
    keys, texts = _members(F.col("_top"))
    listed = parsed.select(
        *others, "_line", F.col("_top").isNull().alias("malformed"), keys.alias("_keys"), texts.alias("_texts")
    )
    # Only members that are fields are read of it; a name that is repeated keeps its last text here too.
    fields = ", ".join(f"`{name}` string" for name in FIELDS)
    inner = F.from_json(_last(F.col("_keys"), F.col("_texts"), "nutriments"), f"struct<{fields}>", STRICT)
    nested = listed.select(*others, "_line", "malformed", "_keys", "_texts", inner.alias("_inner"))
    # Settled: each is mentioned once below, and Spark would put it back into the loop.
    listed = settled(
        nested.select(
            *others, "_line", "malformed", "_keys", "_texts",
            F.array(*[F.col("_inner")[name] for name in FIELDS]).alias("_inner_texts"),
        )
    )
    # One loop over the names: as a column each, the searches make a method too large for Java to compile.
    places = F.transform(F.array(*[F.lit(name) for name in FIELDS]), lambda name: F.array_position("_keys", name))
    texts = F.transform(
        places,
        lambda place, i: F.when(place > 0, F.get("_texts", place.cast("int") - 1)).otherwise(F.get("_inner_texts", i)),
    )
    held = listed.select(*others, "_line", "malformed", texts.alias("_fields"))
    found = held.select(
        *others, "_line", "malformed", *[F.get("_fields", F.lit(i)).alias(name) for i, name in enumerate(FIELDS)]
    )
    return settled(found.select(*others, "malformed", *[_flat_text(name).alias(name) for name in FIELDS]))


def settled(rows):
    """rows whose columns are worked out once: fields that nobody asks for are not made, filters stop here.

    Spark puts a filter on a computed column below the projections that compute it and repeats them
    for every mention.  It does not put one below a column of row numbers, and the generator that reads
    that column keeps it there.
    """
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    return numbered.select("*", F.explode(F.array("_at")).alias("_one")).drop("_at", "_one")


def _flat_text(name):
    """Scalars as they are, arrays as a comma list, objects as null.

    A text that begins with a bracket is a list or an object unless the line has it in quotes.
    """
    raw = F.col(name)
    quoted = F.col("_line").rlike(f'"{name}"\\s*:\\s*"[\\[{{]')
    nested = F.array_join(F.filter(_items(raw), lambda x: x != ""), ",")
    return (
        F.when(~raw.startswith("[") & ~raw.startswith("{"), raw)
        .when(quoted, raw)
        .when(raw.startswith("["), nested)
    )


def _items(text, depth=1):
    """The items of a JSON array as texts; inner arrays are joined, objects are null."""

    def flat(item):
        scalar = F.when(~item.startswith("{"), item)
        if not depth:
            return scalar
        inner = F.array_join(F.filter(_items(item, depth - 1), lambda x: x != ""), ",")
        return F.when(item.startswith("["), F.coalesce(inner, item)).otherwise(scalar)

    return F.transform(F.from_json(text, "array<string>", STRICT), flat)


def read_rows(spark, path, sep="\t", **options):
    """Flat export with a header line; the same mapper accepts it.

    Header names match without case, the first of two equal names wins, and short rows
    give nulls.
    """
    raw = spark.read.options(header=True, sep=sep, quote="", **options).csv(path)
    return flat_rows(raw)


def flat_rows(raw):
    # Spark renames equal header names by appending their position.
    seen = {}
    for name in raw.columns:
        seen.setdefault(name.strip().lower(), name)
    for position, name in enumerate(raw.columns):
        suffix = str(position)
        stem = name.strip().lower()
        if stem.endswith(suffix) and stem[: -len(suffix)] in FIELDS:
            seen.setdefault(stem[: -len(suffix)], name)
    columns = [
        (F.col(f"`{seen[f]}`") if f in seen else F.lit(None)).cast("string").alias(f) for f in FIELDS
    ]
    return raw.select(F.lit(False).alias("malformed"), *columns)


def input_lineage(df):
    """Files a file-based DataFrame was read from: path, size, modification time."""
    return df.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_modification_time"),
    ).distinct()


def source_snapshot(lineage, spec, retrieved_at):
    """Input lineage with the source's licence and attribution."""
    return lineage.select(
        F.lit(spec.id).alias("source_id"),
        F.col("file_path").alias("url"),
        F.lit(str(retrieved_at)).alias("retrieved_at"),
        F.col("file_size").alias("size_bytes"),
        F.col("file_modification_time").alias("modified_at"),
        F.lit(spec.licence).alias("licence"),
        F.lit(spec.attribution).alias("attribution"),
    )


def file_contents(lines, file="file", value="value"):
    """file, lines, characters, content: what each file holds, whatever its name or splits.

    content is a hash of the lines as a multiset: two sums of digits of each line's MD5, so
    parts of a file add up in any order and a line that is repeated, changed or missing shows.
    An empty line counts; a null one is left out.
    """
    digest = F.md5(F.col(value))
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
    sums = lines.where(F.col(value).isNotNull()).groupBy(F.col(file).alias("file")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.length(value)).alias("characters"),
        F.sum(part(1)).alias("_a"),
        F.sum(part(18)).alias("_b"),
    )
    content = F.concat_ws("-", F.col("lines").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return sums.select("file", "lines", "characters", content.alias("content"))


def unseen_files(contents, snapshot):
    """Files whose content no snapshot has, one of equal ones: a file that comes again is skipped.

    snapshot: content of what earlier runs read.  Of new files with the same content the one
    whose name is first stays.
    """
    known = snapshot.select("content").distinct()
    firsts = contents.groupBy("content").agg(F.min(F.struct("file", "lines", "characters")).alias("_f"))
    return firsts.join(known, "content", "left_anti").select("_f.file", "_f.lines", "_f.characters", "content")
