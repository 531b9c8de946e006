"""Catalogue tables from label records."""

from pyspark.sql import functions as F

from checks.bindings import oracle, records, table
from checks.registry import register
from checks.rules import with_nodes
from larder.operators import lookup, report, tables
from larder.operators.sizes import written
from larder.sources import catalogue
from larder.sources.export import input_lineage
from larder.vocab import NUTRIENT_IDS


def from_records(make):
    """A table keyed by record id instead of gtin, since some label records share a gtin."""
    return lambda spark, d: make(records(spark, d).withColumn("gtin", F.col("rid").cast("string")))


COMPLETE = "basis0 is not null or ingredients_raw is not null"
register(
    "cat_product", from_records(tables.product_table),
    oracle(
        "select cast(rid as varchar) as gtin, printed as barcode_printed, format as barcode_format, name, brand as "
        "brand_id, category as category_id, package_value, package_unit, multipack as multipack_count, ingredients_raw, "
        f"status as verification_status, last_verified, case when {COMPLETE} then 1 else 0 end as is_complete "
        "from {label_rows}"
    ),
)
register(
    "cat_product_country", from_records(tables.product_country_table),
    oracle(
        "select cast(rid as varchar) as gtin, 'IN' as country from {label_rows} union all select cast(rid as varchar), "
        "country2 from {label_rows} where country2 <> 'IN'"
    ),
)
register(
    "cat_nutrition", from_records(tables.nutrition_table),
    oracle(
        "select cast(rid as varchar) as gtin, block_index, basis, serving_description, serving_value, serving_unit, "
        + ", ".join(NUTRIENT_IDS) + " from {typed_nutrition}"
    ),
)
register(
    "cat_not_declared", from_records(tables.not_declared_table),
    oracle(
        "select cast(rid as varchar) as gtin, 0 as block_index, unnest(case nd when 1 then ['added_sugars_g', 'sugars_g'] "
        "else ['trans_fat_g'] end) as field from {label_rows} where nd > 0"
    ),
)
register(
    "cat_ingredient_item", from_records(tables.ingredient_item_table),
    with_nodes(
        "select cast(rid as varchar) as gtin, ordinal, parent_ordinal, raw, canonical_id, percentage from nodes"
    ),
)
register(
    "cat_source", from_records(tables.source_table),
    oracle(
        "select cast(rid as varchar) as gtin, s as source_id, 'packaging' as type, null as url, '2026-01-01' as "
        "retrieved_at, null as licence from (select rid, unnest(case when rid % 5 = 1 then ['s1', 's2'] else ['s1'] end) "
        "as s from {label_rows}) u"
    ),
)
register(
    "cat_provenance", from_records(tables.provenance_table),
    oracle(
        "select cast(rid as varchar) as gtin, path, case path when 'ghost.path' then 's9' else 's1' end as source_id, "
        "case when path = 'name' and rid % 33 = 0 then 'low' else 'high' end as confidence from ("
        "select rid, unnest(['name', 'category', 'ingredients_raw', 'ingredients', case when rid % 21 <> 0 then 'brand' "
        "end, case when rid % 22 <> 0 then 'package' end, case when rid % 16 <> 0 then 'nutrition' else 'nutrition[0]' "
        "end, case when rid % 25 = 0 then 'ghost.path' end]) as path from {label_rows}) p where path is not null"
    ),
)
register(
    "cat_product_search", from_records(tables.product_search_table),
    oracle("select name, coalesce(brand, '') as brand, cast(rid as varchar) as gtin from {label_rows}"),
)

# Reference records from the small tables; two rows of an id show that the last one wins.
BRANDS = "select concat('b', s_suppkey % 40) as id, s_name as name, cast(s_nationkey as varchar(20)) as owner, s_suppkey as seq from {supplier}"
CATEGORIES = """
select concat('c', cast(n_nationkey as varchar(20))) as id, n_name as name, concat('c', cast(n_regionkey as varchar(20))) as parent,
  case when n_nationkey % 2 = 0 then 'per_100g' else 'per_100ml' end as typical_basis, n_nationkey, n_regionkey from {nation}
"""


def brand_records(spark, d):
    text = BRANDS.replace("concat('b', s_suppkey % 40)", "concat('b', cast(s_suppkey % 40 as string))")
    return spark.sql(text, supplier=table(spark, d, "supplier"))


def category_records(spark, d):
    rows = spark.sql(CATEGORIES, nation=table(spark, d, "nation"))
    key = F.col("n_nationkey")
    return rows.select(
        "id", "name", "parent", "typical_basis",
        F.array(F.concat(F.lit("c"), ((key + 1) % 25).cast("string")), F.concat(F.lit("c"), ((key + 1) % 25).cast("string")))
        .alias("substitutable_with"),
        F.when(key % 3 == 0, F.array(F.lit("sugars_g"), F.lit("sodium_mg"))).alias("relevant_nutrients"),
    )


def country_records(spark, d):
    return table(spark, d, "nation").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"),
        F.lit("per_100g").alias("default_nutrition_basis"), F.lit("sodium").alias("sodium_declared_as"),
    )


def ingredient_records(spark, d):
    """A dictionary with one entry per part."""
    part = table(spark, d, "part")
    key = F.col("p_partkey")
    return part.select(
        key.cast("int").alias("ordinal"),
        F.concat(F.lit("i"), key.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.when(key % 2 == 0, F.col("p_brand")).alias("explanation"),
        F.when(key % 3 == 0, F.array("p_brand", "p_type", "p_type")).alias("aliases"),
        F.when(key % 5 == 0, F.array(F.lit("palm_derived"))).alias("flags"),
    )


register(
    "cat_brand", lambda spark, d: tables.brand_table(brand_records(spark, d), "seq"),
    oracle(f"select id, name, owner from ({BRANDS}) b qualify row_number() over (partition by id order by seq desc) = 1"),
)
register(
    "cat_category", lambda spark, d: tables.category_table(category_records(spark, d)),
    oracle(f"select id, name, parent as parent_id, typical_basis from ({CATEGORIES}) c"),
)
register(
    "cat_category_substitute", lambda spark, d: tables.category_substitute_table(category_records(spark, d)),
    oracle(f"select id as category_id, concat('c', (n_nationkey + 1) % 25) as substitute_id from ({CATEGORIES}) c"),
)
register(
    "cat_category_nutrient", lambda spark, d: tables.category_nutrient_table(category_records(spark, d)),
    oracle(
        f"select id as category_id, unnest(['sugars_g', 'sodium_mg']) as field from ({CATEGORIES}) c where n_nationkey % 3 = 0"
    ),
)
register(
    "cat_country", lambda spark, d: tables.country_table(country_records(spark, d)),
    oracle(
        "select concat('C', n_nationkey) as code, n_name as name, 'per_100g' as default_basis, 'sodium' as "
        "sodium_declared_as from {nation}"
    ),
)
register(
    "cat_ingredient", lambda spark, d: tables.ingredient_table(ingredient_records(spark, d)),
    oracle(
        "select concat('i', p_partkey) as id, p_name as name, p_type as category, case when p_partkey % 2 = 0 then p_brand "
        "end as explanation from {part}"
    ),
)
register(
    "cat_ingredient_alias", lambda spark, d: tables.ingredient_alias_table(ingredient_records(spark, d)),
    oracle(
        "select concat('i', p_partkey) as ingredient_id, unnest([p_brand, p_type]) as alias from {part} "
        "where p_partkey % 3 = 0"
    ),
)
register(
    "cat_ingredient_flag", lambda spark, d: tables.ingredient_flag_table(ingredient_records(spark, d)),
    oracle(
        "select concat('i', p_partkey) as ingredient_id, 'palm_derived' as flag from {part} where p_partkey % 5 = 0"
    ),
)


def dictionary(spark, d):
    entries = ingredient_records(spark, d)
    loaded = tables.load_dictionary(
        tables.ingredient_table(entries), tables.ingredient_alias_table(entries), tables.ingredient_flag_table(entries)
    )
    return loaded.select(
        "id", "name", F.array_join("aliases", "|").alias("aliases"), F.array_join("flags", "|").alias("flags")
    )


register(
    "load_dictionary", dictionary,
    oracle(
        "select concat('i', p_partkey) as id, p_name as name, case when p_partkey % 3 = 0 then concat(least(p_brand, "
        "p_type), '|', greatest(p_brand, p_type)) end as aliases, case when p_partkey % 5 = 0 then 'palm_derived' end as "
        "flags from {part}"
    ),
)


def assembled(spark, d):
    base = written(records(spark, d).withColumn("gtin", F.col("rid").cast("string")))
    parts = {
        "product": tables.product_table(base),
        "product_country": tables.product_country_table(base),
        "nutrition": tables.nutrition_table(base),
        "nutrition_not_declared": tables.not_declared_table(base),
        "source": tables.source_table(base),
        "provenance": tables.provenance_table(base),
    }
    return tables.assemble_products(parts).select(
        "gtin", "name", F.array_join("countries", ",").alias("countries"),
        F.col("package.quantity.value").alias("package_value"),
        F.array_join("nutrition.basis", ",").alias("bases"),
        F.get("nutrition", F.lit(0))["values"]["sodium_mg"].alias("sodium_mg"),
        F.array_join(F.get("nutrition", F.lit(0))["not_declared"], ",").alias("not_declared"),
        F.array_join("sources.id", ",").alias("sources"),
        F.size("provenance").alias("entries"),
    )


register(
    "assemble_products", assembled,
    oracle(
        "select cast(rid as varchar) as gtin, name, case when country2 <> 'IN' then concat(country2, ',IN') else 'IN' end as "
        "countries, package_value, case when basis0 is not null then concat_ws(',', basis0, basis1) end as bases, "
        "case when basis0 is not null then sodium end as sodium_mg, case nd when 1 then 'added_sugars_g,sugars_g' when 2 "
        "then 'trans_fat_g' end as not_declared, case when rid % 5 = 1 then 's1,s2' else 's1' end as sources, "
        "5 + case when rid % 21 <> 0 then 1 else 0 end + case when rid % 22 <> 0 then 1 else 0 end + "
        "case when rid % 25 = 0 then 1 else 0 end as entries from {label_rows}"
    ),
)
DECLARED = " + ".join(
    f"case when {c} is not null then 1 else 0 end"
    for c in ["kcal", "kj", "protein", "carbohydrate", "sugars", "added", "fat", "saturated", "trans", "fibre", "sodium"]
)
register(
    "starter_topk",
    lambda spark, d: tables.starter_products(
        records(spark, d).withColumn("gtin", F.lpad(F.col("rid").cast("string"), 14, "0")), 200
    ).select("gtin", "score"),
    oracle(
        "select gtin, score from (select lpad(cast(rid as varchar), 14, '0') as gtin, "
        f"case when basis0 is not null then 4 + least(4, ({DECLARED}) // 3) else 0 end + "
        "case when ingredients_raw is not null then 3 else 0 end + case when brand is not null then 1 else 0 end + "
        "case when category is not null then 1 else 0 end + case when package_value is not null then 1 else 0 end as "
        "score from {label_rows}) s where score > 0 order by score desc, gtin limit 200"
    ),
)
register(
    "product_count", lambda spark, d: lookup.product_count(table(spark, d, "part_products")),
    oracle("select count(*) as products from {part_products}"),
)


def lookups(spark, d):
    probes = table(spark, d, "scan_rows").select("event_id", F.col("code").alias("probe"))
    found = lookup.lookup_products(probes, table(spark, d, "part_products").select("gtin", "name"), "probe")
    return found.select("event_id", "gtin", "name", "found")


register(
    "lookup_products", lookups,
    oracle(
        "select event_id, s.gtin14 as gtin, p.name, p.gtin is not null as found from {scan_rows} s "
        "left join {part_products} p on s.gtin14 = p.gtin"
    ),
)
register(
    "display_names",
    lambda spark, d: lookup.display_names(
        table(spark, d, "part_products").select("gtin", "brand_id"), table(spark, d, "brand_names"), "brand_id"
    ).select("gtin", "brand_id", "display_name"),
    oracle(
        "select gtin, brand_id, coalesce(b.name, brand_id) as display_name from {part_products} p "
        "left join {brand_names} b on b.id = p.brand_id"
    ),
)


def status(spark, d):
    meta = spark.createDataFrame(
        [("catalogue_version", "7"), ("schema_version", "1"), ("built_on", "2026-06-15"), ("kind", "full")],
        "key string, value string",
    )
    return catalogue.catalogue_status(meta, table(spark, d, "part_products"))


register(
    "catalogue_status", status,
    oracle(
        "select '7' as catalogue_version, '1' as schema_version, '2026-06-15' as built_on, 'full' as kind, "
        "count(*) as product_count, count(*) > 0 as usable from {part_products}"
    ),
)
register(
    "content_fingerprint",
    lambda spark, d: report.content_fingerprint(table(spark, d, "part_products")).select(
        F.col("fingerprint").cast("string").alias("fingerprint")
    ),
    oracle(
        "select cast(sum(('0x' || substring(md5(array_to_string(["
        + ", ".join(
            f"coalesce('=' || cast({c} as varchar), '-')"
            for c in ("p_partkey", "gtin", "barcode_printed", "name", "brand_id", "category_id", "is_complete")
        )
        + "], chr(31))), 1, 12))::bigint) as varchar) as fingerprint from {part_products}"
    ),
)
register(
    "input_lineage",
    lambda spark, d: input_lineage(table(spark, d, "lineitem")),
    None,
)
