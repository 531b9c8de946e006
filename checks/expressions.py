"""Column functions over whole tables."""

from pyspark.sql import functions as F

from checks.bindings import TODAY, oracle, table
from checks.registry import register
from larder.functions import barcodes, dates, numbers, text
from larder.operators import scans
from larder.functions.pointers import pointer_of


def over(name, *columns):
    """A query that selects expressions from a table or binding."""
    return lambda spark, d: table(spark, d, name).select(*[c() if callable(c) else c for c in columns])


register(
    "gtin_check_digit",
    over("code_rows", "p_partkey", lambda: barcodes.check_digit(F.col("body")).alias("digit")),
    oracle("select p_partkey, cast(cd as integer) as digit from {code_rows}"),
)
register(
    "gtin_valid",
    over("code_rows", "p_partkey", lambda: barcodes.has_valid_check_digit(F.col("code")).alias("valid")),
    oracle("select p_partkey, p_partkey % 17 <> 0 as valid from {code_rows}"),
)
register(
    "gtin_normalize",
    over(
        "code_rows", "p_partkey",
        lambda: barcodes.normalize_gtin(F.concat(F.lit(" "), "code", F.lit("\t"))).alias("gtin"),
    ),
    oracle(
        "select p_partkey, case when p_partkey % 17 <> 0 then lpad(code, 14, '0') end as gtin from {code_rows}"
    ),
)
register(
    "gtin_shard",
    over(
        "part_products", "gtin", lambda: barcodes.gtin_shard(F.col("gtin")).alias("shard"),
    ),
    oracle("select gtin, '890' as shard from {part_products}"),
)
register(
    "shard_layout",
    lambda spark, d: table(spark, d, "code_rows")
    .select(barcodes.normalize_gtin(F.col("code")).alias("gtin"))
    .where(F.col("gtin").isNotNull())
    .select(
        "gtin", barcodes.gtin_shard(F.col("gtin")).alias("shard"), barcodes.record_path(F.col("gtin")).alias("path")
    ),
    oracle(
        "select gtin, shard, concat('products/', shard, '/', gtin, '.json') as path from ("
        "select gtin, lpad(left(cast(cast(gtin as bigint) as varchar), 3), 3, '0') as shard from ("
        "select lpad(code, 14, '0') as gtin from {code_rows} where p_partkey % 17 <> 0) g) s"
    ),
)
register(
    "barcode_format",
    over("code_rows", "p_partkey", lambda: barcodes.format_from_length(F.col("code")).alias("format")),
    oracle(
        "select p_partkey, case p_partkey % 4 when 0 then 'EAN-13' when 1 then 'EAN-8' when 2 then 'UPC-A' "
        "else 'GTIN-14' end as format from {code_rows}"
    ),
)

NUMBER_TEXT = """
select l_orderkey, l_linenumber, l_quantity, l_extendedprice, case l_orderkey % 11
  when 0 then concat(' ', cast(l_linenumber as varchar(20)), '.25 ') when 1 then '5d' when 2 then 'NaN'
  when 3 then '-3' when 4 then concat(cast(l_linenumber as varchar(20)), 'e2') when 5 then '.5' when 6 then '7.'
  when 7 then 'abc' when 8 then '+8' when 9 then '1e999' else '' end as txt
from {lineitem}
"""


def number_rows(spark, d):
    return spark.sql(NUMBER_TEXT, lineitem=table(spark, d, "lineitem"))


register(
    "parse_number",
    lambda spark, d: number_rows(spark, d).select("txt", numbers.parse_number(F.col("txt")).alias("number")),
    oracle(
        "select txt, case l_orderkey % 11 when 0 then l_linenumber + 0.25e0 when 4 then l_linenumber * 100e0 "
        "when 5 then 0.5e0 when 6 then 7e0 when 8 then 8e0 else null end as number from n",
        f"n as ({NUMBER_TEXT})",
    ),
)


def half_away(x):
    """DuckDB text of two-decimal rounding on the scaled value."""
    return f"(floor(({x}) * 100) + case when ({x}) * 100 - floor(({x}) * 100) >= 0.5 then 1 else 0 end) / 100"


register(
    "round_half_away",
    over(
        "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice",
        lambda: numbers.round_half_away(F.col("l_extendedprice") / 8).alias("eighth"),
        lambda: numbers.round_half_away(F.col("l_quantity") + F.lit(1.005)).alias("shifted"),
    ),
    oracle(
        "select l_orderkey, l_linenumber, l_extendedprice, "
        f"{half_away('l_extendedprice / 8')} as eighth, {half_away('l_quantity + 1.005e0')} as shifted from {{lineitem}}"
    ),
)
SPACES = r"[\s\x0b\x{85}\p{Z}]+"
register(
    "clean_text",
    over("documents", "doc_id", lambda: text.clean_text(F.col("text")).alias("cleaned")),
    oracle(f"select doc_id, nullif(trim(regexp_replace(text, '{SPACES}', ' ', 'g')), '') as cleaned from {{documents}}"),
)
register(
    "first_of_list",
    over("raw_rows", "seq", lambda: text.first_of_list(F.col("brands")).alias("first_brand")),
    oracle(
        "select seq, case k % 4 when 0 then o_orderpriority when 1 then 'Nestlé' when 3 then "
        "concat('Mother''s ', o_orderstatus) end as first_brand from {raw_rows}"
    ),
)
register(
    "slug",
    over(
        "part", "p_partkey",
        lambda: text.slug(
            F.concat(F.lit(" "), "p_name", F.lit(" Ñandú & Sœur Straße/"), "p_brand", F.repeat(F.lit("x"), F.col("p_size")))
        ).alias("slug"),
    ),
    oracle(
        "select p_partkey, case when length(s) <= 80 then s end as slug from (select p_partkey, concat("
        "replace(p_name, ' ', '-'), '-nandu-soeur-strasse-brand-', substring(p_brand, 7, 9), repeat('x', p_size)) as s "
        "from {part}) t"
    ),
)
register(
    "category_map",
    over("raw_rows", "seq", lambda: text.map_category(F.col("categories_tags")).alias("category")),
    oracle(
        "select seq, case k % 8 when 0 then 'cream-biscuits' when 1 then 'soft-drink' when 3 then 'chocolate' "
        "when 5 then 'flour' when 6 then 'salt' when 7 then 'tea' end as category from {raw_rows}"
    ),
)
register(
    "freshness",
    lambda spark, d: table(spark, d, "orders")
    .withColumn("day", F.date_format(F.add_months("o_orderdate", 12 * 28), "yyyy-MM-dd"))
    .select(
        "o_orderkey", "day",
        dates.freshness(F.col("day"), TODAY).alias("level"),
        dates.freshness_note(F.col("day"), TODAY).alias("note"),
    ),
    oracle(
        "select o_orderkey, strftime(day, '%Y-%m-%d') as day, level, concat('Last checked ', "
        "strftime(day, '%-d %B %Y'), case level when 'Current' then '.' when 'ReviewRecommended' then "
        "', over six months ago. Formulations change, so this is worth re-checking against the packet.' else "
        "', over a year ago. This may not match what is on the shelf now.' end) as note from (select *, "
        "case when months < 6 then 'Current' when months < 12 then 'ReviewRecommended' else 'PossiblyOutdated' end "
        "as level from (select o_orderkey, day, (2026 - year(day)) * 12 + 6 - month(day) - "
        "case when 15 < day(day) then 1 else 0 end as months from (select o_orderkey, "
        "cast(o_orderdate + interval 336 month as date) as day from {orders}) a) b) c"
    ),
)
register(
    "classify_scans",
    lambda spark, d: scans.classify_scans(table(spark, d, "scan_rows")).select("event_id", "kind", "gtin", "message"),
    oracle(
        "select event_id, kind, case when kind = 'Product' then gtin14 end as gtin, case kind when 'BadCheckDigit' then "
        "'That did not read as a valid barcode. Try again, holding the packet flat and steady.' "
        "when 'Empty' then 'Nothing was read.' when 'Product' then '' else case when raw like 'HTTPS%' then "
        "'That is a web link, not a product barcode. Scan the barcode with the black bars instead.' else "
        "'That is a code of some kind, but not a product barcode. Look for the one with black bars and digits "
        "underneath.' end end as message from (select *, case event_id % 7 when 3 then 'NotAProduct' when 4 then "
        "'BadCheckDigit' when 5 then case when event_id % 2 = 0 then 'Empty' else 'NotAProduct' end else 'Product' end "
        "as kind from {scan_rows}) s"
    ),
)
PATHS = """
select o_orderkey, case o_orderkey % 5 when 0 then concat('nutrition[', cast(o_orderkey % 3 as varchar(20)), '].values.x')
  when 1 then 'a~b.c/d' when 2 then '' when 3 then '[0]' else 'name' end as path from {orders}
"""
register(
    "provenance_pointers",
    lambda spark, d: spark.sql(PATHS, orders=table(spark, d, "orders")).select(
        "o_orderkey", pointer_of(F.col("path")).alias("pointer")
    ),
    oracle(
        "select o_orderkey, case o_orderkey % 5 when 0 then concat('/nutrition/', cast(o_orderkey % 3 as varchar), "
        "'/values/x') when 1 then '/a~0b/c~1d' when 2 then '' when 3 then '/0' else '/name' end as pointer from {orders}"
    ),
)
