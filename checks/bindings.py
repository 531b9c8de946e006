"""Inputs derived from the driver's tables.

Every binding is one SQL text that Spark and DuckDB both run; {name} refers to a driver
table or to another binding.  Barcodes get their check digit by arithmetic on the key, so
the expression under test is not used to make its own input.
"""

import re

from pyspark.sql import functions as F

from larder import schemas
from larder.sources.export import settled

TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
}
DIGIT = re.compile(r"floor\(cast\((\w+) as decimal\(20,0\)\) / (\d+)\)")
NAME = r"\{([a-z_]\w*)\}"
TODAY = "2026-06-15"
RETRIEVED = "2026-08-27"


def _digits(key):
    """The 13 digits of a key, and whether it fits behind a three-digit prefix."""
    powers = [(i, "cast({k} as bigint)" if not i else f"floor(cast({{k}} as decimal(20,0)) / {10**i})") for i in range(13)]
    digits = ", ".join(f"cast({p.format(k=key)} as bigint) % 10 as k{i}" for i, p in powers)
    return f"{digits}, {key} < 1000000000 as narrow"


# Weighted digits of a body; a narrow key leaves all above the ninth at zero.
ODD = "3 * (k0 + k2 + k4 + k6 + k8 + k10 + k12) + k1 + k3 + k5 + k7 + k9 + k11"


def _nine(key):
    """Nine digits of a narrow key, thirteen of a wider one."""
    return f"lpad(cast({key} as varchar(20)), case when {key} < 1000000000 then 9 else 13 end, '0')"


def _cd(weight):
    """Check digit behind a prefix of that weight; a wide key has no prefix."""
    return f"(10 - ({ODD} + case when narrow then {weight} else 0 end) % 10) % 10"


def _code(prefix, digit="cd"):
    """Prefix, key and check digit; a wide key fills all 14 digits."""
    return f"concat(case when narrow then '{prefix}' else '' end, nine, cast({digit} as varchar(2)))"


SQL = {}

# Printed codes of four widths; every 17th has a wrong check digit.
SQL["code_rows"] = f"""
select p_partkey, body, cd,
  concat(body, cast(case when p_partkey % 17 = 0 then (cd + 1) % 10 else cd end as varchar(2))) as code
from (
  select p_partkey,
    case when not narrow then nine when width = 0 then concat('890', nine) when width = 1 then substring(nine, 3, 7)
      when width = 2 then concat('03', nine) else concat('1890', nine) end as body,
    case when width = 0 then {_cd(35)} when width = 1 then {_cd(0)} when width = 2 then {_cd(3)}
      else {_cd(38)} end as cd
  from (select p_partkey, case when p_partkey % 4 = 1 and p_partkey >= 10000000 then 0 else p_partkey % 4 end as width,
          {_nine('p_partkey')} as nine, {_digits('p_partkey')} from {{part}}) d
) c
"""

# Export rows from orders; every 13th appears again later in the stream.
SQL["raw_base"] = f"""
select k, o_orderstatus, o_orderpriority, o_totalprice,
  case when k % 17 = 0 then {_code('890', '(cd + 1) % 10')}
       when k % 11 = 0 then right(lpad(cast(k as varchar(20)), 20, '0'), 7)
       when k % 7 = 3 then {_code('400', 'cd4')}
       else {_code('890')} end as code,
  case when k % 19 = 0 then '  ' when k % 23 = 0 then 'x'
       else concat('  ', o_orderpriority, '  pack ', cast(k % 100 as varchar(20)), ' ') end as product_name,
  case k % 4 when 0 then concat(' ,', o_orderpriority, ' , other') when 1 then 'Nestlé, x'
       when 2 then null else concat('Mother''s  ', o_orderstatus) end as brands,
  case when not narrow or k % 7 = 3 and k % 2 = 0 then 'en:France,en:India' else null end as countries_tags,
  case k % 8 when 0 then 'en:biscuits,en:cream-biscuits' when 1 then 'en:sodas' when 2 then 'en:unknown'
       when 3 then 'EN:Chocolates , en:candies' when 4 then null when 5 then 'en:wheat-flours,en:flours'
       when 6 then 'en:salts' else 'en:teas' end as categories_tags,
  case k % 5 when 0 then '100g' when 1 then '100ml' when 2 then 'serving' when 3 then ' 100G ' else null end
    as nutrition_data_per,
  case k % 10 when 2 then '1  piece' when 7 then null else '25 g' end as serving_size,
  case when k % 20 = 2 then null when k % 30 = 12 then '0' else '25' end as serving_quantity,
  case k % 3 when 0 then cast(k % 500 as varchar(20)) when 1 then 'abc' else null end as product_quantity,
  case when k % 12 = 0 then 'l' when k % 6 = 0 then ' ML ' when k % 6 = 3 then 'kg' else null end
    as product_quantity_unit,
  case when k % 6 < 3 then concat('Wheat flour,  sugar, palm oil (', cast(k % 50 as varchar(20)), '%), salt')
       when k % 6 = 3 then '   ' else null end as ingredients_text,
  cast(k % 900 as double) + 0.5e0 as energy_kcal,
  cast(k % 400 as double) / 8e0 as proteins,
  cast(k % 1000 as double) / 10e0 as carbohydrates,
  o_totalprice / 7919e0 as sugars,
  cast(k % 300 as double) / 7e0 as fat,
  cast(k % 300 as double) / 14e0 as saturated_fat,
  case when k % 50 = 0 then -1e0 else null end as trans_fat,
  case when k % 2 = 0 then cast(k % 70 as double) / 3e0 else null end as fiber,
  cast(k % 1000 as double) / 7919e0 as sodium
from (
  select *, {_cd(35)} as cd, {_cd(4)} as cd4
  from (select o_orderkey as k, o_orderstatus, o_orderpriority, o_totalprice,
          {_nine('o_orderkey')} as nine, {_digits('o_orderkey')} from {{orders}}) d
) c
"""
SQL["raw_rows"] = """
select k as seq, b.* from {raw_base} b
union all
select k + 1000000000000 as seq, k, o_orderstatus, o_orderpriority, o_totalprice, code,
  concat('again ', product_name) as product_name, brands, countries_tags, categories_tags,
  nutrition_data_per, serving_size, serving_quantity, product_quantity, product_quantity_unit,
  null as ingredients_text, energy_kcal, proteins, carbohydrates, sugars, fat, saturated_fat, trans_fat,
  fiber, sodium
from {raw_base} b where k % 13 = 0
"""

# Label records from lineitem, flat, one per order line number; records() nests them.
SQL["label_base"] = f"""
select *, case when k % 29 = 1 then k - 1 else k end as kk
from (
  select l_orderkey * 8 + l_linenumber as k, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey,
    max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice, min(l_returnflag) as l_returnflag,
    max(round(l_discount * 100, 2)) as fat, max(round(l_tax * 100, 2)) as tax
  from {{lineitem}} group by l_orderkey * 8 + l_linenumber
) g
"""
SQL["label_rows"] = f"""
select k as rid, concat('data/products/', case when k % 37 = 0 then '111' else '890' end, '/', gtin,
    case when kk <> k then '-b' else '' end, '.json') as path,
  gtin, printed, format, name, brand, category, country2, package_value, package_unit, multipack,
  basis0, basis1, serving_description, serving_value, serving_unit, fat, saturated, trans, carbohydrate,
  sugars, added, protein, fibre,
  case when k % 13 = 0 then 10e0 when k % 14 = 0 then null
       else 4 * protein + 4 * coalesce(carbohydrate, 0e0) + 9 * fat end as kcal,
  case when k % 15 = 0 then 100e0 else null end as kj,
  sodium, l_quantity as sugars1, ingredients_raw, tree, wheat_pct, oil_pct, palm_pct, nd, status, last_verified, k
from (
  select *,
    case when k % 17 = 0 then {_code('890', '(cd + 1) % 10')} else {_code('890')} end as printed,
    case when k % 23 = 0 then {_code('0890', '(cd + 3) % 10')}
         when k % 17 = 0 then {_code('0890', '(cd + 1) % 10')}
         else {_code('0890')} end as gtin,
    case when k % 41 = 0 then 'EAN-8' when k % 43 = 0 then 'UPC-E' else 'EAN-13' end as format,
    concat(l_returnflag, ' item ', cast(l_partkey % 100 as varchar(20))) as name,
    case when k % 9 = 0 then null else concat('brand-', cast(l_suppkey % 40 as varchar(20))) end as brand,
    case when k % 5 = 0 then null when l_partkey % 13 = 0 then 'salt'
         else concat('cat-', cast(l_partkey % 12 as varchar(20))) end as category,
    case when k % 6 = 0 then 'IN' when k % 6 < 3 then null
         else concat('C', cast(l_suppkey % 25 as varchar(20))) end as country2,
    case when k % 4 = 0 then null else l_quantity * 10 end as package_value,
    case when k % 4 = 0 then null else (case k % 5 when 0 then 'g' when 1 then 'kg' when 2 then 'ml'
         when 3 then 'l' else 'piece' end) end as package_unit,
    case when k % 4 <> 0 and k % 7 = 0 then 6 else null end as multipack,
    case when k % 10 = 0 then null when l_returnflag = 'A' then 'per_100g' when l_returnflag = 'R'
         then 'per_100ml' else 'per_serving' end as basis0,
    case when k % 10 = 0 or k % 7 <> 2 then null when k % 14 <> 2 then 'per_package' when l_returnflag = 'A'
         then 'per_100g' when l_returnflag = 'R' then 'per_100ml' else 'per_serving' end as basis1,
    case when (l_returnflag not in ('A', 'R') or k % 4 = 1) and k % 10 <> 0
         then concat(cast(k % 50 as varchar(20)), ' g') else null end as serving_description,
    case when (l_returnflag not in ('A', 'R') or k % 4 = 1) and k % 10 <> 0 and k % 6 <> 0
         then cast(k % 200 as double) else null end as serving_value,
    case when (l_returnflag not in ('A', 'R') or k % 4 = 1) and k % 10 <> 0 and k % 6 <> 0
         then (case when k % 8 = 1 then 'ml' when k % 9 = 1 then 'piece' when k % 9 = 2 then 'kg' else 'g' end)
         else null end as serving_unit,
    case when k % 11 = 0 then fat + 0.5e0 else fat / 2 end as saturated,
    case when k % 53 = 0 then fat + 1 else null end as trans,
    case when k % 8 = 0 then null else l_quantity end as carbohydrate,
    case when k % 12 = 0 then l_quantity + 1 when k % 3 = 0 then null else l_quantity / 2 end as sugars,
    case when k % 59 = 0 then l_quantity + 5 else null end as added,
    case when k % 61 = 0 then 95e0 else tax end as protein,
    case when k % 2 = 0 then 3e0 else null end as fibre,
    case when k % 67 = 0 then 40000e0 when k % 3 = 1 then l_extendedprice / 100 else null end as sodium,
    case k % 3 when 0 then null when 1 then concat('Wheat flour (', cast(k % 60 as varchar(20)),
         '%), edible vegetable oil (palm), sugar, salt')
         else 'Rice flour, palm sugar; palm kernel oil' end as ingredients_raw,
    case when k % 4 = 1 then 1 else 0 end as tree,
    k % 60 as wheat_pct, k % 50 as oil_pct, k % 120 as palm_pct,
    case when k % 10 = 0 then 0 when k % 18 = 0 then 1 when k % 19 = 0 then 2 else 0 end as nd,
    case k % 3 when 0 then 'verified' when 1 then 'unverified' else 'disputed' end as status,
    case when k % 71 = 0 then '2027-01-01' when k % 73 = 0 then 'not a date'
         else concat(cast(2024 + k % 3 as varchar(20)), '-', lpad(cast(1 + k % 12 as varchar(20)), 2, '0'), '-',
           lpad(cast(1 + k % 28 as varchar(20)), 2, '0')) end as last_verified
  from (select *, {_cd(35)} as cd
        from (select *, {_nine('kk')} as nine, {_digits('kk')} from {{label_base}}) a) b
) c
"""

# Panels of a large category table: few categories, many rows.
SQL["panel_rows"] = """
select l_orderkey, l_linenumber, p_type as category_id,
  case l_returnflag when 'A' then 'per_100g' when 'R' then 'per_100ml' else 'per_serving' end as basis,
  case when l_linenumber % 7 = 0 then null else l_quantity end as sugars_g,
  round(l_discount * 100, 2) as fat_g, floor(l_extendedprice) / 100e0 as sodium_mg
from {lineitem} join {part} on l_partkey = p_partkey
"""

# Products on shelves of one country, for alternatives.
SQL["shelf_rows"] = """
select concat(l_orderkey, '-', l_linenumber) as gtin, max(p_type) as category_id,
  case max(l_returnflag) when 'A' then 'per_100g' when 'R' then 'per_100ml' else 'per_serving' end as basis,
  concat('C', max(l_suppkey) % 3) as country,
  case when l_linenumber % 7 = 0 then null else max(l_quantity) end as sugars_g,
  round(max(l_discount) * 100, 2) as fat_g, round(max(l_tax) * 100, 2) as fibre_g,
  floor(max(l_extendedprice)) / 100e0 as sodium_mg
from {lineitem} join {part} on l_partkey = p_partkey group by l_orderkey, l_linenumber
"""
SQL["shelf_nutrients"] = """
select distinct p_type as category_id, 'sugars_g' as field from {part} where p_type <> 'LARGE'
union all select distinct p_type, 'fat_g' from {part} where p_type in ('STANDARD', 'ECONOMY', 'PROMO')
union all select distinct p_type, 'fibre_g' from {part} where p_type in ('ECONOMY', 'PROMO')
union all select distinct p_type, 'sodium_mg' from {part} where p_type = 'MEDIUM'
"""
SQL["shelf_substitutes"] = """
select distinct p_type as category_id, case p_type when 'STANDARD' then 'ECONOMY' when 'SMALL' then 'MEDIUM'
  else 'STANDARD' end as substitute_id from {part} where p_type in ('STANDARD', 'SMALL', 'PROMO')
"""

# A tree with long ways, circles and a parent that does not exist; panels on its categories.
SQL["category_tree"] = """
select concat('c', k) as id, case when k = 0 then null when k % 97 = 0 then concat('c', k)
    when k % 103 = 7 then 'ghost' when k % 5 = 0 then concat('c', k - 5) else concat('c', cast(floor(k / 2) as bigint)) end
  as parent_id from (select c_custkey as k from {customer}) c
"""
SQL["tree_limits"] = """
select id as category_id, concat('Group ', id) as source_category, nutrient, display, 'g' as unit, reads as derived_from,
  factor as multiply_by, above
from (select concat('c', c_custkey) as id from {customer} where c_custkey % 50 = 10) c cross join (
  select 'sugars_g' as nutrient, 'Sugars' as display, cast(null as varchar(20)) as reads, cast(null as double) as factor, 10e0 as above
  union all select 'salt_g', 'Salt', 'sodium_mg', 0.0025e0, 1.5e0) l
"""
SQL["tree_panels"] = """
select gtin, concat('c', mod(l_orderkey * 7 + l_linenumber, (select count(*) from {customer}))) as category_id,
  case when l_linenumber % 3 = 0 then 'per_100ml' when l_linenumber % 3 = 1 then 'per_100g' else 'per_serving' end as basis,
  case when l_linenumber % 3 = 2 then 25e0 end as serving_value, case when l_linenumber % 3 = 2 then 'g' end as serving_unit,
  sugars_g, sodium_mg
from (select l_orderkey, l_linenumber, concat(l_orderkey, '-', l_linenumber) as gtin, max(l_quantity) as sugars_g,
        floor(max(l_extendedprice)) / 50e0 as sodium_mg from {lineitem} group by l_orderkey, l_linenumber) g
"""

# What suppliers say of parts; a supplier's type follows its key.
SQL["claim_rows"] = """
select l_partkey as part, concat('p', l_partkey) as key, case when l_linenumber % 2 = 0 then 'sugars_g' else 'fat_g' end as path,
  concat('s', l_suppkey % 40) as source,
  case l_suppkey % 7 when 0 then 'packaging' when 1 then 'manufacturer' when 2 then 'regulator' when 3 then 'open_database'
    when 4 then 'retailer' when 5 then 'community' else 'hearsay' end as type,
  case when l_linenumber % 5 = 4 then null when l_suppkey % 40 < 25 and l_quantity < 40 then '10'
    else cast(cast(floor(l_quantity / 15) as bigint) as varchar(20)) end as value
from {lineitem}
"""

# A catalogue of parts and scans of them; a third of the scanned keys is not in it.
SQL["part_products"] = f"""
select p_partkey, {_code('0890')} as gtin, {_code('890')} as barcode_printed,
  p_name as name, concat('brand-', substring(p_brand, 7, 10)) as brand_id, p_type as category_id,
  case when p_size % 2 = 0 then 1 else 0 end as is_complete
from (
  select *, {_cd(35)} as cd
  from (select *, {_nine('p_partkey')} as nine, {_digits('p_partkey')} from {{part}}) d
) c
"""
SQL["scan_rows"] = f"""
select event_id, user_id, ts as scanned_at, k, code, gtin14,
  case event_id % 7 when 0 then concat('(01)', gtin14) when 1 then concat(']d201', gtin14, '10ABC')
    when 2 then concat(' ', code, '  ') when 3 then concat('HTTPS://example.org/', code)
    when 4 then wrong when 5 then (case when event_id % 2 = 0 then '' else 'hello' end) else code end as raw
from (
  select *, {_code('890')} as code, {_code('0890')} as gtin14, {_code('890', '(cd + 1) % 10')} as wrong
  from (
    select *, {_cd(35)} as cd
    from (
      select *, {_nine('k')} as nine, {_digits('k')}
      from (select event_id, user_id, ts, (user_id * 37 + event_id) %
              (select cast(floor(count(*) * 1.5e0) as bigint) from {{part}}) as k from {{events}}) e
    ) d
  ) c
) b
"""
# Every third scanned code of the catalogue is written at the time of its scan, some deleted.
SQL["version_rows"] = """
select gtin14 as gtin, scanned_at as valid_at, event_id as batch, concat('v', event_id) as name, event_id % 36 = 0 as deleted
from {scan_rows} where event_id % 3 = 0 and k < (select count(*) from {part})
"""
SQL["brand_names"] = """
select concat('brand-', cast(s_suppkey as varchar(20))) as id, s_name as name from {supplier} where s_suppkey < 30
"""
SQL["category_names"] = """
select concat('cat-', cast(n_nationkey as varchar(20))) as id, n_name as name from {nation} where n_nationkey < 10
union all select 'salt' as id, 'Salt' as name
"""
SQL["country_codes"] = """
select concat('C', cast(n_nationkey as varchar(20))) as code from {nation} where n_nationkey < 20
union all select 'IN' as code
"""
SQL["dictionary_names"] = """
select 'wheat-flour' as id union all select 'palm-oil' as id
"""
SQL["typed_nutrition"] = """
select gtin, 0 as block_index, basis0 as basis, serving_description, serving_value, serving_unit,
  kcal as energy_kcal, kj as energy_kj, protein as protein_g, carbohydrate as carbohydrate_g,
  sugars as sugars_g, added as added_sugars_g, fat as fat_g, saturated as saturated_fat_g,
  trans as trans_fat_g, fibre as fibre_g, sodium as sodium_mg, nd, category, rid
from {label_rows} where basis0 is not null
union all
select gtin, 1, basis1, null, null, null, null, null, null, null, sugars1, null, null, null, null, null, null,
  0, category, rid
from {label_rows} where basis1 is not null
"""

# Queries typed into a search box.
SQL["search_queries"] = """
select 'q1' as query_id, 'red wid' as text union all select 'q2' as query_id, 'ring' as text
union all select 'q3' as query_id, 'b brand' as text union all select 'q4' as query_id, 'blue''s' as text
union all select 'q5' as query_id, '()' as text union all select 'q6' as query_id, 'small small' as text
"""


def names_in(text):
    return re.findall(NAME, text)


def table(spark, sf_dir, name):
    """A driver table or a binding as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs = {n: table(spark, sf_dir, n) for n in dict.fromkeys(names_in(SQL[name]))}
    # The digits of a key in whole numbers, which Spark divides much faster than decimals.
    text = DIGIT.sub(r"((\1 - pmod(\1, \2)) div \2)", SQL[name])
    return spark.sql(text, **inputs)


def oracle(body, *extra):
    """DuckDB text: the bindings the body refers to as CTEs, then the body."""
    ctes = {}

    def visit(text):
        for name in dict.fromkeys(names_in(text)):
            if name not in TABLES and name not in ctes:
                visit(SQL[name])
                ctes[name] = re.sub(NAME, r"\1", SQL[name])

    visit(body)
    parts = [f"{name} as ({text})" for name, text in ctes.items()]
    parts += [re.sub(NAME, r"\1", e) for e in extra]
    head = "with " + ", ".join(parts) + " " if parts else ""
    return head + re.sub(NAME, r"\1", body)


def spread(spark, sf_dir, name, key):
    """A binding shared out by key, whatever files its tables have."""
    return table(spark, sf_dir, name).repartition(key)


def export_lines(spark, sf_dir):
    """Export rows as JSON lines with their stream order: value, ord.

    Every 31st line is cut short, every 37th is empty, every 29th hides its sugars behind a
    top-level null, even codes are numbers and some tag lists are arrays.
    """
    rows = spread(spark, sf_dir, "raw_rows", "seq")
    nutriments = F.struct(
        *[
            (F.col(source) / divisor).alias(f"{field}{suffix}")
            for suffix, divisor in (("_100g", 1), ("_serving", 4))
            for field, source in [
                ("energy-kcal", "energy_kcal"), ("proteins", "proteins"), ("carbohydrates", "carbohydrates"),
                ("sugars", "sugars"), ("fat", "fat"), ("saturated-fat", "saturated_fat"),
                ("trans-fat", "trans_fat"), ("fiber", "fiber"), ("sodium", "sodium"),
            ]
        ]
    )
    number = (F.col("k") % 2 == 0) & ~F.col("code").startswith("0")
    code = F.when(number, F.col("code")).otherwise(F.concat(F.lit('"'), F.col("code"), F.lit('"')))
    listed = (F.col("k") % 8).isin(0, 3)
    tags = F.when(
        listed, F.concat(F.lit('"categories_tags":'), F.to_json(F.split("categories_tags", ",")), F.lit(","))
    ).otherwise("")
    rest = F.to_json(
        F.struct(
            "product_name", "brands", "countries_tags",
            F.when(~listed, F.col("categories_tags")).alias("categories_tags"),
            "nutrition_data_per", "serving_size", "serving_quantity", "product_quantity",
            "product_quantity_unit", "ingredients_text", nutriments.alias("nutriments"),
        )
    )
    shadow = F.when(F.col("k") % 29 == 0, '"sugars_100g":null,').otherwise("")
    line = F.concat(
        F.lit('{"code":'), code, F.lit(","), tags, shadow, F.substring(rest, F.lit(2), F.length(rest))
    )
    value = (
        F.when(F.col("k") % 37 == 0, "")
        .when(F.col("k") % 31 == 0, F.substring(line, F.lit(1), F.length(line) - 5))
        .otherwise(line)
    )
    # A generator stands for the file: filters on the text stop here.
    return rows.select(F.explode_outer(F.array(value)).alias("value"), F.col("seq").alias("ord"))


def records(spark, sf_dir):
    """Product records with rid and path, nested from label_rows."""
    rows = spread(spark, sf_dir, "label_rows", "rid")
    columns = {
        "energy_kcal": "kcal", "energy_kj": "kj", "protein_g": "protein", "carbohydrate_g": "carbohydrate",
        "sugars_g": "sugars", "added_sugars_g": "added", "fat_g": "fat", "saturated_fat_g": "saturated",
        "trans_fat_g": "trans", "fibre_g": "fibre", "sodium_mg": "sodium",
    }
    values = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    only_sugars = F.struct(
        *[(F.col("sugars1") if n == "sugars_g" else F.lit(None).cast("double")).alias(n) for n in columns]
    )
    quantity = F.when(
        F.col("serving_value").isNotNull(),
        F.struct(F.col("serving_value").alias("value"), F.col("serving_unit").alias("unit")),
    )
    serving = F.when(
        F.col("serving_description").isNotNull(),
        F.struct(F.col("serving_description").alias("description"), quantity.alias("quantity")),
    )
    nd = F.when(F.col("nd") == 1, F.array(F.lit("added_sugars_g"), F.lit("sugars_g"))).when(
        F.col("nd") == 2, F.array(F.lit("trans_fat_g"))
    )
    first = F.struct(
        F.col("basis0").alias("basis"), serving.alias("serving"), values.alias("values"), nd.alias("not_declared")
    ).cast(schemas.PANEL)
    second = F.struct(
        F.col("basis1").alias("basis"), F.lit(None).alias("serving"), only_sugars.alias("values"),
        F.lit(None).alias("not_declared"),
    ).cast(schemas.PANEL)
    nutrition = F.when(F.col("basis1").isNotNull(), F.array(first, second)).when(
        F.col("basis0").isNotNull(), F.array(first)
    )
    tree = F.when(
        F.col("tree") == 1,
        F.format_string(
            '[{"raw":"Wheat flour","canonical":"wheat-flour","percentage":%d},{"raw":"Oil","percentage":%d,'
            '"children":[{"raw":"Palm","canonical":"palm-oil","percentage":%d},'
            '{"raw":"Mix","canonical":"oil-mix","children":[{"raw":"Rape"}]}]},{"raw":"Salt"}]',
            "wheat_pct", "oil_pct", "palm_pct",
        ),
    )

    def source(name):
        return F.struct(
            F.lit(name).alias("id"), F.lit("packaging").alias("type"), F.lit(None).cast("string").alias("url"),
            F.lit("2026-01-01").alias("retrieved_at"), F.lit(None).cast("string").alias("licence"),
            F.lit(None).cast("string").alias("note"),
        )

    k = F.col("k")

    def entry(path, present, source_id="s1", confidence="high"):
        evidence = F.struct(
            F.lit(source_id).alias("source"),
            (confidence if not isinstance(confidence, str) else F.lit(confidence)).alias("confidence"),
            F.lit(None).cast("string").alias("note"),
        )
        return F.when(present, F.struct(F.lit(path).alias("key"), evidence.alias("value")))

    yes = F.lit(True)
    provenance = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("name", yes, confidence=F.when(k % 33 == 0, "low").otherwise("high")),
                entry("brand", k % 21 != 0),
                entry("category", yes),
                entry("package", k % 22 != 0),
                entry("ingredients_raw", yes),
                entry("ingredients", yes),
                entry("nutrition", k % 16 != 0),
                entry("nutrition[0]", k % 16 == 0),
                entry("ghost.path", k % 25 == 0, "s9"),
            )
        )
    )
    conflict = F.array(
        F.struct(
            F.lit("name").alias("path"),
            F.lit(None).alias("values"),
            F.when(k % 2 == 0, "unresolved").otherwise("human_decision").alias("resolution"),
        )
    )
    package = F.struct(
        F.struct(F.col("package_value").alias("value"), F.col("package_unit").alias("unit")).alias("quantity"),
        F.col("multipack").alias("multipack_count"),
    )
    made = {
        "barcode_printed": F.col("printed"),
        "barcode_format": F.col("format"),
        "names": F.lit(None),
        "countries": F.array_compact(F.array(F.lit("IN"), "country2")),
        "package": F.when(F.col("package_value").isNotNull(), package),
        "nutrition": nutrition,
        "ingredients": tree,
        "sources": F.when(k % 5 == 1, F.array(source("s1"), source("s2"))).otherwise(F.array(source("s1"))),
        "provenance": provenance,
        "conflicts": F.when(k % 35 == 0, conflict),
        "verification": F.struct("status", "last_verified"),
        "schema_version": F.lit(1),
    }
    columns = [F.col("rid"), F.col("path")]
    columns += [made.get(n, F.col(n)).cast(kind).alias(n) for n, kind in schemas.PRODUCT_FIELDS]
    # As a columnar file would give them.
    return settled(rows.select(*columns))


def ids(spark, sf_dir):
    """Dimensions the records refer to; some references have none."""
    return {
        "brand": table(spark, sf_dir, "brand_names"),
        "category": table(spark, sf_dir, "category_names"),
        "country": table(spark, sf_dir, "country_codes"),
        "ingredient": table(spark, sf_dir, "dictionary_names"),
    }
