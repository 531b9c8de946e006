"""Queries that write files of the driver's tables and read them back, and whole-table jobs."""

from pyspark.sql import functions as F

from checks.analysis import LABEL_VALUES, PEER_RULE, STATS, chain
from checks.bindings import export_lines, oracle, records, table
from checks.imports import SPEC, products, with_raw
from checks.registry import register
from checks.rules import FIRSTS
from larder import schemas
from larder.operators import brands, peers, quality, tables
from larder.sources import export
from larder.sources.records import read_records
from larder.sources.scratch import new_folder


def read_back(spark, d):
    """Export lines as plain and as gzip files, decoded from both."""
    lines = export_lines(spark, d)
    root = new_folder(spark, "export")
    plain, packed = f"{root}/plain", f"{root}/packed"
    even = F.xxhash64("value") % 2 == 0
    lines.where(even).select("value").write.text(plain)
    lines.where(~even).select("value").write.option("compression", "gzip").text(packed)
    found = export.decode_lines(export.read_lines(spark, [plain, packed]))
    return found.select("malformed", "code", "product_name", "categories_tags", "serving_quantity")


register(
    "export_files", read_back,
    with_raw(
        "select bad as malformed, case when not bad then code end as code, case when not bad then product_name end as "
        "product_name, case when not bad then categories_tags end as categories_tags, case when not bad then "
        "serving_quantity end as serving_quantity from kept"
    ),
)


def repeated_members(spark, d):
    """Lines in which a member comes twice: the last one counts, also inside nutriments."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    line = F.format_string(
        '{"code":"1","product_name":"first","product_name":"%s","fiber_100g":null,"nutriments":'
        '{"fat_100g":1,"fiber_100g":5,"fat_100g":%d},"code":"%d"}',
        "o_orderpriority", F.col("o_orderkey") % 90, "o_orderkey",
    )
    found = export.decode_lines(orders.select("o_orderkey", line.alias("value")))
    return found.select("o_orderkey", "malformed", "code", "product_name", "fat_100g", "fiber_100g")


register(
    "repeated_members", repeated_members,
    "select o_orderkey, false as malformed, cast(o_orderkey as varchar) as code, o_orderpriority as product_name, "
    "cast(o_orderkey % 90 as varchar) as fat_100g, null as fiber_100g from orders",
)


def record_files(spark, d):
    """Records of parts as multi-line JSON files in a tree, a shelf a folder; every hundredth file has no name."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    path = new_folder(spark, "parts")
    name = F.when(F.col("p_partkey") % 100 > 0, F.col("p_name"))
    record = F.to_json(F.struct(F.concat(F.lit("P"), "p_partkey").alias("code"), name.alias("name"), F.lit(1).alias("schema_version")))
    # An array over several lines is a file of records.
    lines = parts.groupBy((F.col("p_partkey") % 40).alias("shelf"), F.floor(F.col("p_partkey") / 4000).alias("file")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("\n]")).alias("value")
    )
    lines.write.partitionBy("shelf", "file").option("compression", "none").option("lineSep", "\n").text(path)
    return read_records(spark, path, schemas.COUNTRY, glob="*.txt").select("code", "name", "schema_version")


register(
    "record_tree", record_files,
    "select concat('P', p_partkey) as code, case when p_partkey % 100 > 0 then p_name end as name, 1 as schema_version from part",
)


def flat_file(spark, d):
    """A tab file with a repeated and an unknown column, and names in other case."""
    path = new_folder(spark, "flat")
    orders = table(spark, d, "orders")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderpriority", F.lit("x"), F.lit("other"))
    short = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey").cast("string")).otherwise(line)
    # Each file of a flat export has a header of its own.
    body = orders.select(F.concat(F.lit("Code\tPRODUCT_NAME\tunknown\tcode\n"), short).alias("value"))
    body.write.text(path)
    rows = export.read_rows(spark, path)
    return rows.where("code <> 'Code'").select("code", "product_name")


register(
    "flat_file", flat_file,
    "select cast(o_orderkey as varchar) as code, case when o_orderkey % 5 <> 0 then o_orderpriority end as product_name "
    "from orders",
)


def catalogue_stats(spark, d):
    """Peer cut-offs from the product and nutrition tables, joined."""
    base = records(spark, d).withColumn("gtin", F.col("rid").cast("string"))
    panels = peers.category_panels(tables.product_table(base), tables.nutrition_table(base))
    values = peers.peer_values(panels, PEER_RULE["nutrients"])
    return peers.peer_stats(values, 5, 25, 75, "peers", "1.0.0")


register(
    "catalogue_peer_stats", catalogue_stats,
    chain("typed_nutrition", [LABEL_VALUES, STATS.replace("n >= 30", "n >= 5")], "select * from stats"),
)
register(
    "duplicate_gtins",
    lambda spark, d: quality.duplicate_gtins(records(spark, d), "path", "path").select("path", "severity", "code", "pointer"),
    oracle(
        f"select path, 'error' as severity, '0701' as code, '/gtin' as pointer from ({FIRSTS}) f where path > first_path"
    ),
)


def merged(spark, d):
    """Brands of an import against earlier ones: every third was known, every sixth by another name."""
    new = brands.brand_rollup(products(spark, d), SPEC, "2026-09-27")
    known = brands.brand_rollup(products(spark, d), SPEC, "2026-08-27").where(F.length("id") % 3 == 0)
    renamed = F.when(F.length("id") % 2 == 0, F.concat("name", F.lit(" old"))).otherwise(F.col("name"))
    found = brands.merge_brands(known.withColumn("name", renamed), new)
    return found.select("id", F.col("sources")[0]["retrieved_at"].alias("retrieved_at"))


register(
    "merge_brands", merged,
    with_raw(
        "select distinct brand as id, case when length(brand) % 3 = 0 and length(brand) % 2 <> 0 then '2026-08-27' else "
        "'2026-09-27' end as retrieved_at from products where brand is not null"
    ),
)


def meta_rows(spark, d):
    """The metadata table of a build, beside the number of products it describes."""
    count = table(spark, d, "part_products").agg(F.count("*").cast("string").alias("value"))
    return tables.meta_table(spark, 7, "2026-06-15", SPEC).where("key in ('catalogue_version', 'kind')").unionByName(
        count.select(F.lit("products").alias("key"), "value")
    )


register(
    "meta_table", meta_rows,
    oracle(
        "select 'catalogue_version' as key, '7' as value union all select 'kind', 'full' union all "
        "select 'products', cast(count(*) as varchar) from {part_products}"
    ),
)
