"""Import queries over export lines made from orders."""

from pyspark.sql import functions as F

from checks.bindings import RETRIEVED, TODAY, export_lines, oracle, table
from checks.expressions import half_away
from checks.registry import register
from larder.operators import brands, dedup, mapping, report, tables, upsert
from larder.operators.quality import with_row_error
from larder.operators.sizes import written
from larder.plans.importing import import_products, map_lines, products_of
from larder.sources.export import OPEN_DATABASE, decode_lines
from larder.vocab import CATEGORY_MAP, EXPORT_LICENCE

SPEC = OPEN_DATABASE

# What the lines must become, from the row key alone.
R = half_away


def _figure(column, scale="", hidden=""):
    """A figure of the declared basis; serving columns hold a quarter."""
    return (
        f"case when basis is null then null {hidden} when basis = 'per_serving' then {R(f'{column} / 4{scale}')} "
        f"else {R(f'{column}{scale}')} end"
    )


KEPT = "kept as (select *, k % 31 = 0 as bad from {raw_rows} where k % 37 <> 0)"
MAPPED = f"""
mapped as (
  select seq, k, code, reason, printed, gtin, name, brand, category, package_value, package_unit, ingredients_raw,
    basis, case when basis = 'per_serving' then '1 piece' end as serving_description,
    case when basis = 'per_serving' and k % 20 <> 2 and k % 30 <> 12 then 25e0 end as serving_value,
    {_figure('energy_kcal')} as energy_kcal, {_figure('proteins')} as protein_g,
    {_figure('carbohydrates')} as carbohydrate_g,
    {_figure('sugars', hidden="when basis <> 'per_serving' and k % 29 = 0 then null")} as sugars_g,
    {_figure('fat')} as fat_g, {_figure('saturated_fat')} as saturated_fat_g,
    {_figure('fiber')} as fibre_g, {_figure('sodium', ' * 1000')} as sodium_mg
  from (
    select *,
      case when bad then 'the source line is not valid JSON'
        when k % 17 = 0 or k % 11 = 0 then 'barcode is missing, malformed, or fails its check digit'
        when code not like '890%' and countries_tags is null then 'not sold in India and not an Indian barcode'
        when length(trim(product_name)) < 2 then 'no product name' end as reason,
      code as printed, lpad(code, 14, '0') as gtin,
      trim(regexp_replace(product_name, '\\s+', ' ', 'g')) as name,
      case k % 4 when 0 then lower(replace(o_orderpriority, ' ', '-')) when 1 then 'nestle'
        when 3 then concat('mother-s-', lower(o_orderstatus)) end as brand,
      case k % 8 when 0 then 'cream-biscuits' when 1 then 'soft-drink' when 3 then 'chocolate'
        when 5 then 'flour' when 6 then 'salt' when 7 then 'tea' end as category,
      case when k % 3 = 0 and k % 500 > 0 then cast(k % 500 as double) end as package_value,
      case when k % 3 = 0 and k % 500 > 0 then case when k % 6 = 0 then 'ml' else 'g' end end as package_unit,
      nullif(trim(regexp_replace(ingredients_text, '\\s+', ' ', 'g')), '') as ingredients_raw,
      case k % 5 when 0 then 'per_100g' when 3 then 'per_100g' when 1 then 'per_100ml'
        when 2 then case when k % 10 = 2 then 'per_serving' end end as basis
    from kept
  ) m
)
"""
FIRST = """
products as (
  select * from mapped where reason is null
  qualify row_number() over (partition by gtin order by seq) = 1
)
"""
STEPS = (KEPT, MAPPED, FIRST)


def with_raw(body, *more):
    """The CTE chain: bindings, then the import steps and more of them, then the body."""
    chain = oracle("select 1 from {raw_rows}")
    bindings = chain[len("with "):].rsplit(" select 1 from raw_rows", 1)[0]
    steps = ", ".join(s.strip().replace("{raw_rows}", "raw_rows") for s in (*STEPS, *more))
    return f"with {bindings}, {steps} {body}"


def mapped(spark, d):
    return map_lines(export_lines(spark, d), SPEC, RETRIEVED)


def products(spark, d):
    return import_products(export_lines(spark, d), SPEC, RETRIEVED)


def accepted(spark, d):
    return mapping.accepted(mapped(spark, d))


register(
    "scan_jsonl",
    lambda spark, d: decode_lines(export_lines(spark, d)).select(
        F.col("ord").alias("seq"), "malformed", "code", "product_name", "categories_tags", "serving_quantity",
        F.col("fiber_100g").try_cast("double").alias("fiber"), F.col("sugars_100g").isNull().alias("no_sugars"),
    ),
    with_raw(
        "select seq, bad as malformed, case when not bad then code end as code, case when not bad then product_name "
        "end as product_name, case when not bad then categories_tags end as categories_tags, "
        "case when not bad then serving_quantity end as serving_quantity, case when not bad then fiber end as fiber, "
        "bad or k % 29 = 0 as no_sugars from kept"
    ),
)
register(
    "malformed_lines",
    lambda spark, d: decode_lines(export_lines(spark, d)).where("malformed").select(F.col("ord").alias("seq")),
    with_raw("select seq from kept where bad"),
)
register(
    "drop_reasons",
    lambda spark, d: mapped(spark, d).select(F.col("ord").alias("seq"), "drop_reason"),
    with_raw("select seq, reason as drop_reason from mapped"),
)
register(
    "region_filter",
    lambda spark, d: decode_lines(export_lines(spark, d))
    .where(mapping.in_region(F.col("code"), F.col("countries_tags"), SPEC.region_tag, SPEC.region_prefix))
    .select(F.col("ord").alias("seq"), "code"),
    with_raw(
        "select seq, code from kept where not bad and (code like '890%' or countries_tags is not null)"
    ),
)
PANEL = [
    "energy_kcal", "protein_g", "carbohydrate_g", "sugars_g", "fat_g", "saturated_fat_g", "fibre_g", "sodium_mg",
]


def flat(df, *keep):
    panel = F.get("nutrition", F.lit(0))
    return df.select(
        *keep,
        "gtin",
        panel["basis"].alias("basis"),
        panel["serving"]["description"].alias("serving_description"),
        panel["serving"]["quantity"]["value"].alias("serving_value"),
        *[panel["values"][n].alias(n) for n in PANEL],
    )


register(
    "nutrition_panels",
    lambda spark, d: flat(accepted(spark, d), F.col("ord").alias("seq")).where(F.col("basis").isNotNull()),
    with_raw(
        f"select seq, gtin, basis, serving_description, serving_value, {', '.join(PANEL)} from mapped "
        "where reason is null and basis is not null"
    ),
)
register(
    "package_quantity",
    lambda spark, d: accepted(spark, d).select(
        F.col("ord").alias("seq"),
        F.col("package.quantity.value").alias("package_value"),
        F.col("package.quantity.unit").alias("package_unit"),
    ),
    with_raw("select seq, package_value, package_unit from mapped where reason is null"),
)
register(
    "stamp_provenance",
    lambda spark, d: accepted(spark, d)
    .select(F.col("ord").alias("seq"), F.explode("provenance").alias("path", "e"))
    .select("seq", "path", F.col("e.source").alias("source"), F.col("e.confidence").alias("confidence")),
    with_raw(
        "select seq, path, 's1' as source, 'medium' as confidence from ("
        "select seq, unnest(['name', case when brand is not null then 'brand' end, case when category is not null "
        "then 'category' end, case when package_value is not null then 'package' end, case when basis is not null "
        "then 'nutrition' end, case when ingredients_raw is not null then 'ingredients_raw' end]) as path "
        "from mapped where reason is null) p where path is not null"
    ),
)
register(
    "import_products",
    lambda spark, d: flat(
        products(spark, d), "barcode_printed", "barcode_format", "name", "brand", "category", "ingredients_raw",
        F.array_join("countries", ",").alias("countries"), F.col("sources")[0]["url"].alias("url"),
        F.col("sources")[0]["licence"].alias("licence"), F.col("verification.status").alias("status"),
        F.col("verification.last_verified").alias("last_verified"),
    ),
    with_raw(
        "select printed as barcode_printed, case when length(printed) = 14 then 'GTIN-14' else 'EAN-13' end as barcode_format, name, brand, category, ingredients_raw, "
        f"'IN' as countries, concat('{SPEC.product_url}', printed) as url, '{EXPORT_LICENCE}' as licence, "
        f"'unverified' as status, '{RETRIEVED}' as last_verified, gtin, basis, serving_description, serving_value, "
        f"{', '.join(PANEL)} from products"
    ),
)
register(
    "dedup_first_wins",
    lambda spark, d: dedup.first_wins(accepted(spark, d), "gtin", "ord").select("gtin", F.col("ord").alias("seq"), "name"),
    with_raw("select gtin, seq, name from products"),
)
register(
    "import_report",
    lambda spark, d: report.import_report(mapped(spark, d)),
    with_raw(
        "select (select count(*) from mapped) as candidates_read, count(*) as mapped, "
        "(select count(*) from mapped where reason is not null) as dropped, "
        "(select count(*) from mapped where reason is null) - count(*) as duplicates, "
        "count(*) filter (basis is null and ingredients_raw is null) as incomplete from products"
    ),
)
register(
    "drop_reason_counts",
    lambda spark, d: report.drop_reason_counts(mapped(spark, d)),
    with_raw(
        'select reason as drop_reason, count(*) as "rows" from mapped where reason is not null group by reason'
    ),
)
register(
    "gap_queue",
    lambda spark, d: report.gap_queue(products(spark, d)),
    with_raw("select gtin, name from products where basis is null and ingredients_raw is null"),
)
register(
    "is_complete",
    lambda spark, d: products(spark, d).select("gtin", mapping.is_complete().alias("is_complete")),
    with_raw("select gtin, basis is not null or ingredients_raw is not null as is_complete from products"),
)
register(
    "build_counts",
    lambda spark, d: report.build_counts(products(spark, d)),
    with_raw(
        "select count(*) as products, count(*) filter (basis is null and ingredients_raw is null) as incomplete "
        "from products"
    ),
)
def manifest(spark, d):
    whole = written(products(spark, d))
    starter = tables.starter_products(whole, 100)
    return report.build_manifest(whole, 7, TODAY, SPEC, minimum_app_version="2.1.0", starter=starter)


CONTENT = (
    "cast(coalesce(sum(('0x' || substring(md5(array_to_string([coalesce('=' || gtin, '-'), coalesce('=' || name, '-'), "
    "coalesce('=' || ingredients_raw, '-')], chr(31))), 1, 12))::bigint), 0) as varchar)"
)
DECLARED = " + ".join(f"case when {n} is not null then 1 else 0 end" for n in PANEL)
SCORED = f"""
scored as (
  select *, case when basis is not null then 4 + least(4, ({DECLARED}) // 3) else 0 end
    + case when ingredients_raw is not null then 3 else 0 end + case when brand is not null then 1 else 0 end
    + case when category is not null then 1 else 0 end + case when package_value is not null then 1 else 0 end as score
  from products
)
"""
STARTER = "starter as (select * from scored where score > 0 order by score desc, gtin limit 100)"
COUNTS = f"count(*), count(*) filter (basis is null and ingredients_raw is null), {CONTENT}"
register(
    "build_manifest", manifest,
    with_raw(
        f"select 7 as catalogue_version, 1 as schema_version, '2.1.0' as minimum_app_version, '{TODAY}' as built_on, "
        f"'full' as kind, '{EXPORT_LICENCE}' as licence, '{SPEC.attribution}' as attribution, f.*, s.* from "
        f"(select {COUNTS} from products) f(products, incomplete, content), "
        f"(select {COUNTS} from starter) s(starter_products, starter_incomplete, starter_content)",
        SCORED, STARTER,
    ),
)
register(
    "brand_rollup",
    lambda spark, d: brands.brand_rollup(products(spark, d)),
    with_raw(
        "select brand as id, case when brand = 'nestle' then 'Nestle' when brand like 'mother%' then "
        "concat('Mother S ', upper(right(brand, 1))) when brand like '4%' then '4 Not Specified' else "
        "concat(left(brand, 1), ' ', upper(substring(brand, 3, 1)), substring(brand, 4)) end as name, "
        "count(*) as products from products where brand is not null group by brand"
    ),
)
register(
    "mapped_categories",
    # The categories that products of the import have serve as the category records.
    lambda spark, d: brands.categories_without_record(
        brands.mapped_categories(spark),
        products(spark, d).where("length(name) > 12").select(F.col("category").alias("id")).distinct(),
    ),
    with_raw(
        "select category from (select unnest(["
        + ", ".join(sorted({f"'{category}'" for _, category in CATEGORY_MAP}))
        + "]) as category) m where category not in (select category from products where length(name) > 12 and "
        "category is not null)"
    ),
)


def row_number():
    """The order key inside a record's gtin."""
    body = F.substring("gtin", 1, 13).cast("bigint")
    prefixed = F.col("gtin").startswith("0890") | F.col("gtin").startswith("0400")
    return F.when(prefixed, body % 10**9).otherwise(body)


def second_import(spark, d):
    """The same rows a month later: a third with other figures, a tenth gone, new codes for some."""
    later = import_products(export_lines(spark, d), SPEC, "2026-09-27")
    number = row_number()
    changed = F.when(number % 3 == 0, F.concat("name", F.lit(" new recipe"))).otherwise(F.col("name"))
    return later.where(number % 10 != 0).withColumn("name", changed)


def first_import(spark, d):
    return earlier(products(spark, d))


def earlier(found):
    return found.where(row_number() % 7 != 0)


register(
    "incremental_upsert",
    lambda spark, d: upsert.upsert(first_import(spark, d), second_import(spark, d)).select(
        "gtin", "name", "state", F.col("verification.last_verified").alias("last_verified"),
        F.col("sources")[0]["retrieved_at"].alias("retrieved_at"),
    ),
    with_raw(
        "select gtin, case when state in ('new', 'changed') and k % 3 = 0 then concat(name, ' new recipe') else name end as name, "
        "state, case when state in ('new', 'changed') then '2026-09-27' else '2026-08-27' end as last_verified, "
        "case when state in ('new', 'changed') then '2026-09-27' else '2026-08-27' end as retrieved_at from ("
        "select gtin, name, k, case when k % 10 = 0 then 'untouched' when k % 7 = 0 then 'new' when k % 3 = 0 then "
        "'changed' else 'unchanged' end as state from products where not (k % 10 = 0 and k % 7 = 0)) s"
    ),
)
register(
    "upsert_counts",
    lambda spark, d: report.upsert_counts(upsert.upsert_states(first_import(spark, d), second_import(spark, d))),
    with_raw(
        "select count(*) filter (k % 7 = 0 or k % 3 = 0) as written, count(*) filter (k % 7 <> 0 and k % 3 <> 0) as "
        "unchanged from products where k % 10 <> 0"
    ),
)


def whole_report(spark, d):
    # Each import is mapped once; every part of the report reads what was written of it.
    lines = written(mapped(spark, d))
    found = written(products_of(lines))
    judged = with_row_error(found, RETRIEVED, "broken")
    states = upsert.upsert_states(earlier(found), second_import(spark, d))
    found = report.run_report(lines, states, judged, "broken", 5)
    listed = F.array_join(
        F.transform("drop_reasons", lambda r: F.concat(r["drop_reason"], F.lit("="), r["rows"].cast("string"))), ";"
    )
    return found.withColumn("drop_reasons", listed).withColumn("rejected_sample", F.array_join("rejected_sample", ","))


PER_100 = "basis in ('per_100g', 'per_100ml')"
MASS = (
    "coalesce(protein_g, 0) + coalesce(carbohydrate_g, 0) + coalesce(fat_g, 0) + "
    "case when carbohydrate_g is null then coalesce(fibre_g, 0) else 0 end"
)
BROKEN = (
    "broken as (select gtin from products where sugars_g > carbohydrate_g + 0.1 or saturated_fat_g > fat_g + 0.1 "
    f"or ({PER_100} and {MASS} > 101))"
)
register(
    "run_report", whole_report,
    with_raw(
        "select (select count(*) from mapped) as candidates_read, (select count(*) from products) as mapped, "
        "(select count(*) from mapped where reason is not null) as dropped, "
        "(select count(*) from mapped where reason is null) - (select count(*) from products) as duplicates, "
        "(select count(*) from products where basis is null and ingredients_raw is null) as incomplete, "
        "(select count(*) from products where k % 10 <> 0 and (k % 7 = 0 or k % 3 = 0)) as written, "
        "(select count(*) from products where k % 10 <> 0 and k % 7 <> 0 and k % 3 <> 0) as unchanged, "
        "(select count(*) from broken) as rejected, "
        "(select string_agg(gtin, ',' order by gtin) from (select gtin from broken order by gtin limit 5)) as rejected_sample, "
        "(select string_agg(reason || '=' || n, ';' order by reason) from (select reason, count(*) as n from mapped where "
        "reason is not null group by reason)) as drop_reasons",
        BROKEN,
    ),
)
