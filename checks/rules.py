"""Data-quality rules over label records made from lineitem."""

from pyspark.sql import functions as F

from checks.bindings import TODAY, ids, oracle, records, table
from checks.registry import register
from larder.operators import dedup, ingredients, quality, report, tables, upsert
from larder.operators.sizes import written
from larder.plans import validating
from larder.schemas import PRODUCT_COLUMNS


def row(spark, d, codes=None):
    return quality.row_findings(records(spark, d), TODAY, "rid", path="path", codes=codes)


def brief(df):
    return df.select("rid", "severity", "code", "pointer")


# Panels in long form, as the rules see them.
PANELS = "select *, concat('/nutrition/', block_index) as spot from {typed_nutrition}"


def rule(code, severity, pointer, condition, source):
    return (
        f"select rid, '{severity}' as severity, '{code}' as code, {pointer} as pointer from {source} r "
        f"where {condition}"
    )


MASS = (
    "coalesce(protein_g, 0) + coalesce(carbohydrate_g, 0) + coalesce(fat_g, 0) + "
    "case when carbohydrate_g is null then coalesce(fibre_g, 0) else 0 end"
)
WORKED = (
    "coalesce(protein_g, 0) * 4 + coalesce(carbohydrate_g, 0) * 4 + coalesce(fat_g, 0) * 9 + "
    "case when carbohydrate_g is null then coalesce(fibre_g, 0) * 2 else 0 end"
)
PER_100 = "basis in ('per_100g', 'per_100ml')"
P, L = f"({PANELS})", "{label_rows}"
PANEL_RULES = {
    "0401": ("error", "concat(spot, '/values/saturated_fat_g')", "saturated_fat_g > fat_g + 0.1"),
    "0402": ("error", "concat(spot, '/values/sugars_g')", "sugars_g > carbohydrate_g + 0.1"),
    "0403": ("error", "concat(spot, '/values/added_sugars_g')", "added_sugars_g > sugars_g + 0.1"),
    "0404": ("error", "concat(spot, '/values/trans_fat_g')", "trans_fat_g > fat_g + 0.1"),
    "0405": ("error", "concat(spot, '/values')", f"{PER_100} and {MASS} > 101"),
    "0406": (
        "warning", "concat(spot, '/values/energy_kcal')",
        f"energy_kcal > 0 and coalesce(protein_g, carbohydrate_g, fat_g) is not null and {WORKED} > 0 "
        f"and abs(energy_kcal - ({WORKED})) / ({WORKED}) > 0.2e0",
    ),
    "0407": (
        "warning", "concat(spot, '/values/energy_kj')",
        "energy_kcal > 0 and abs(energy_kj - energy_kcal * 4.184e0) / (energy_kcal * 4.184e0) > 0.05e0",
    ),
    "0409": ("warning", "concat(spot, '/serving')", "basis = 'per_serving' and serving_value is null"),
    "0411": (
        "warning", "concat(spot, '/values/sodium_mg')",
        f"{PER_100} and coalesce(category, '') <> 'salt' and sodium_mg > 10000",
    ),
}
LABEL_RULES = {
    "0301": ("error", "'/barcode_printed'", "rid % 17 = 0"),
    "0302": ("error", "'/gtin'", "rid % 17 <> 0 and lpad(printed, 14, '0') <> gtin"),
    "0303": ("warning", "'/barcode_format'", "rid % 17 <> 0 and format = 'EAN-8'"),
    "0103": ("error", "'/gtin'", "path <> concat('data/products/890/', gtin, '.json')"),
    "0408": ("error", "'/nutrition/1/basis'", "basis1 = basis0"),
    "0410": ("error", "'/nutrition/0/not_declared/0'", "(nd = 1 and added is not null) or (nd = 2 and trans is not null)"),
    "0501": (
        "error", "'/brand'", "rid % 21 = 0 and brand is not null",
    ),
    "0502": ("error", "'/provenance/ghost.path'", "rid % 25 = 0"),
    "0504": ("info", "'/sources'", "rid % 5 = 1"),
    "0505": ("error", "'/provenance/name'", "status = 'verified' and rid % 33 = 0"),
    "0506": ("error", "'/verification/status'", "status = 'verified' and rid % 35 = 0 and rid % 2 = 0"),
    "0601": ("error", "'/ingredients'", "tree = 1 and ingredients_raw is null"),
    "0603": ("warning", "'/ingredients'", "tree = 1 and wheat_pct + oil_pct > 100.5"),
    "0801": ("error", "'/verification/last_verified'", f"try_cast(last_verified as date) > date '{TODAY}'"),
    "0802": (
        "info", "'/verification/last_verified'",
        f"try_cast(last_verified as date) + interval 365 day < date '{TODAY}'",
    ),
}
# Rules that can name a second place in the same record.
MORE = [
    rule("0410", "error", "'/nutrition/0/not_declared/1'", "nd = 1 and sugars is not null", L),
    rule("0501", "error", "'/package'", "rid % 22 = 0 and package_value is not null", L),
    rule("0501", "error", "'/nutrition/1'", "rid % 16 = 0 and basis1 is not null", L),
    rule("0603", "warning", "'/ingredients/1/children'", "tree = 1 and palm_pct > 100.5", L),
]
EACH = {code: rule(code, *parts, P) for code, parts in PANEL_RULES.items()}
EACH |= {code: rule(code, *parts, L) for code, parts in LABEL_RULES.items()}
ALL_ROW = " union all ".join([*EACH.values(), *MORE])

register("row_findings", lambda spark, d: brief(row(spark, d)), oracle(ALL_ROW))
for _name, _codes in {
    "saturated_above_fat": ["0401"],
    "sugars_above_carbohydrate": ["0402"],
    "added_above_sugars": ["0403"],
    "trans_above_fat": ["0404"],
    "duplicate_basis": ["0408"],
    "not_declared_but_present": ["0410"],
    "serving_without_mass": ["0409"],
    "wrong_location": ["0103"],
    "identity_findings": ["0301", "0302", "0303"],
    "verification_findings": ["0801", "0802"],
    "percentages_exceed": ["0603"],
    "parsed_without_raw": ["0601"],
    "uncovered_values": ["0501"],
    "provenance_findings": ["0501", "0502", "0504", "0505", "0506"],
}.items():
    _sql = " union all ".join(
        [EACH[c] for c in _codes] + [m for m in MORE if any(f"'{c}' as code" in m for c in _codes)]
    )
    register(_name, lambda spark, d, codes=_codes: brief(quality.only(row(spark, d, codes), *codes)), oracle(_sql))


def one(x):
    """DuckDB text of a number with at most one decimal."""
    return f"rtrim(rtrim(cast(round(cast({x} as decimal(30,10)), 1) as decimal(30,1))::varchar, '0'), '.')"


def whole(x):
    return f"cast(round(cast({x} as decimal(30,10)), 0) as decimal(30,0))::varchar"


def messages(code):
    return lambda spark, d: quality.only(row(spark, d, [code]), code).select("rid", "pointer", "message")


register(
    "macros_exceed_basis", messages("0405"),
    oracle(
        f"select rid, concat(spot, '/values') as pointer, concat('Macronutrients of ', {one(MASS)}, ' g do not fit into ', "
        f"case when basis = 'per_100g' then '100 g' else '100 ml' end, '.') as message from {P} r where {PANEL_RULES['0405'][2]}"
    ),
)
register(
    "energy_disagrees", messages("0406"),
    oracle(
        f"select rid, concat(spot, '/values/energy_kcal') as pointer, concat('Energy of ', {one('energy_kcal')}, ' kcal is ', "
        f"{whole(f'abs(energy_kcal - ({WORKED})) / ({WORKED}) * 100')}, '% away from the ', {one(WORKED)}, "
        f"' kcal of its macronutrients.') as message from {P} r where {PANEL_RULES['0406'][2]}"
    ),
)
register(
    "energy_units_disagree", messages("0407"),
    oracle(
        f"select rid, concat(spot, '/values/energy_kj') as pointer, concat('Energy of ', {one('energy_kj')}, ' kJ does not "
        f"match ', {one('energy_kcal')}, ' kcal, which are ', {whole('energy_kcal * 4.184e0')}, ' kJ.') as message "
        f"from {P} r where {PANEL_RULES['0407'][2]}"
    ),
)
register(
    "sodium_implausible", messages("0411"),
    oracle(
        f"select rid, concat(spot, '/values/sodium_mg') as pointer, concat('Sodium of ', {whole('sodium_mg')}, ' mg in 100 "
        f"means ', {one('sodium_mg * 2.54e0 / 1000')}, ' g of salt.') as message from {P} r where {PANEL_RULES['0411'][2]}"
    ),
)

# ------------------------------------------------------------------ other records
NODES = """
nodes as (
  select rid, gtin, unnest([0, 1, 2, 3, 4, 5]) as ordinal, unnest([null, null, 1, 1, 3, null]) as parent_ordinal,
    unnest(['Wheat flour', 'Oil', 'Palm', 'Mix', 'Rape', 'Salt']) as raw,
    unnest(['wheat-flour', null, 'palm-oil', 'oil-mix', null, null]) as canonical_id,
    unnest([cast(wheat_pct as double), cast(oil_pct as double), cast(palm_pct as double), null, null, null])
      as percentage
  from label_rows where tree = 1
)
"""


def with_nodes(body):
    chain = oracle("select 1 from {label_rows}")
    return chain.rsplit(" select 1 from label_rows", 1)[0] + ", " + NODES.strip() + " " + body


def missing(column, ids_table, key, code, pointer):
    return (
        f"select rid, 'warning' as severity, '{code}' as code, {pointer} as pointer from {{label_rows}} r where "
        f"{column} is not null and {column} not in (select {key} from {{{ids_table}}})"
    )


BRAND = missing("brand", "brand_names", "id", "0702", "'/brand'")
CATEGORY = missing("category", "category_names", "id", "0703", "'/category'")
COUNTRY = missing("country2", "country_codes", "code", "0704", "'/countries/1'")
INGREDIENT = (
    "select rid, 'info' as severity, '0602' as code, '/ingredients/1/children/1/canonical' as pointer "
    "from {label_rows} r where tree = 1"
)
register(
    "unknown_brand", lambda spark, d: brief(quality.unknown_brands(records(spark, d), ids(spark, d)["brand"], "rid")),
    oracle(BRAND),
)
register(
    "unknown_category",
    lambda spark, d: brief(quality.unknown_categories(records(spark, d), ids(spark, d)["category"], "rid")),
    oracle(CATEGORY),
)
register(
    "unknown_country",
    lambda spark, d: brief(quality.unknown_countries(records(spark, d), ids(spark, d)["country"], "rid")),
    oracle(COUNTRY),
)
register(
    "unmatched_ingredient",
    lambda spark, d: brief(quality.unmatched_ingredients(records(spark, d), ids(spark, d)["ingredient"], "rid")),
    oracle(INGREDIENT),
)
FIRSTS = "select *, min(path) over (partition by gtin) as first_path, count(*) over (partition by gtin) as n from {label_rows}"
register(
    "duplicate_keys",
    lambda spark, d: dedup.duplicate_keys(records(spark, d), "gtin", "path"),
    oracle(f"select gtin, path, first_path from ({FIRSTS}) f where path > first_path"),
)


def cross(spark, d):
    return quality.cross_findings(records(spark, d), ids(spark, d), "rid")


register("cross_findings", lambda spark, d: brief(cross(spark, d)), oracle(" union all ".join([BRAND, CATEGORY, COUNTRY, INGREDIENT])))


def everything(spark, d):
    return validating.findings(records(spark, d), ids(spark, d), TODAY, "rid")


NO_PATH = [s for c, s in EACH.items() if c != "0103"]
ALL = " union all ".join([*NO_PATH, *MORE, BRAND, CATEGORY, COUNTRY, INGREDIENT])
# Written before they are ordered: the ranges of an order are found by a run of their own.
register("findings", lambda spark, d: brief(quality.ordered(written(everything(spark, d)), "rid")), oracle(ALL))
register(
    "findings_summary",
    lambda spark, d: report.findings_summary(everything(spark, d), strict=True),
    oracle(
        "select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, "
        f"count(*) filter (severity = 'info') as notes, true as blocked from ({ALL}) a"
    ),
)
ERRORS = f"select distinct rid from ({' union all '.join([*EACH.values(), *MORE])}) e where severity = 'error'"
register(
    "prune_invalid",
    lambda spark, d: upsert.prune_invalid(records(spark, d), row(spark, d), "rid").select("rid", "gtin"),
    oracle(f"select rid, gtin from {{label_rows}} r where rid not in ({ERRORS})"),
)
FIELD_ORDER = ", ".join(f"'{c}'" for c in PRODUCT_COLUMNS)
FIRST_ERROR = (
    f"select rid, code from ({' union all '.join([*EACH.values(), *MORE])}) e where severity = 'error' "
    "qualify row_number() over (partition by rid order by "
    f"coalesce(list_position([{FIELD_ORDER}], regexp_extract(pointer, '^/([^/]*)', 1)), 0), "
    "coalesce(try_cast(regexp_extract(pointer, '^/[^/]*/([0-9]+)', 1) as int), -1), pointer, code) = 1"
)
register(
    "prune_broken",
    lambda spark, d: upsert.prune_broken(records(spark, d), TODAY).select("rid", "gtin"),
    oracle(
        "select rid, gtin from {label_rows} r where rid not in (select rid from ("
        f"{' union all '.join([*NO_PATH, *MORE])}) e where severity = 'error')"
    ),
)
register(
    "rejections",
    lambda spark, d: upsert.rejections(row(spark, d), "rid").select("rid", "code"),
    oracle(FIRST_ERROR),
)
register(
    "rejection_sample",
    lambda spark, d: upsert.rejection_sample(row(spark, d), "rid").select("rid", "code"),
    oracle(f"select * from ({FIRST_ERROR}) f order by rid limit 50"),
)


def stale(spark, d):
    """Records with their own JSON text, so that provenance paths can be resolved."""
    base = records(spark, d)
    body = F.to_json(F.struct(*[c for c in base.columns if c not in ("rid", "path")]))
    texts = base.withColumn("raw", body)
    return brief(quality.only(quality.row_findings(texts, TODAY, "rid", raw="raw", codes=["0503"]), "0503"))


register(
    "stale_paths", stale,
    oracle(
        "select rid, 'warning' as severity, '0503' as code, concat('/provenance/', p) as pointer from ("
        "select rid, unnest([case when brand is null and rid % 21 <> 0 then 'brand' end, case when category is null then "
        "'category' end, case when package_value is null and rid % 22 <> 0 then 'package' end, case when "
        "ingredients_raw is null then 'ingredients_raw' end, case when tree = 0 then 'ingredients' end, case when "
        "basis0 is null and rid % 16 <> 0 then 'nutrition' end, case when basis0 is null and rid % 16 = 0 then "
        "'nutrition[0]' end, case when rid % 25 = 0 then 'ghost.path' end]) as p from {label_rows}) s "
        "where p is not null"
    ),
)
register(
    "declared_fields",
    lambda spark, d: tables.panels(records(spark, d), "rid").select(
        "rid", "block_index", F.array_join(quality.declared_fields(F.col("panel.values")), ",").alias("fields")
    ),
    oracle(
        "select rid, block_index, concat_ws(',', "
        + ", ".join(
            f"case when {n} is not null then '{n}' end"
            for n in [
                "energy_kcal", "energy_kj", "protein_g", "carbohydrate_g", "sugars_g", "added_sugars_g", "fat_g",
                "saturated_fat_g", "trans_fat_g", "fibre_g", "sodium_mg",
            ]
        )
        + ") as fields from {typed_nutrition}"
    ),
)
register(
    "flatten_ingredients",
    lambda spark, d: ingredients.flatten_ingredients(records(spark, d), "rid").drop("pointer"),
    with_nodes("select rid, ordinal, parent_ordinal, raw, canonical_id, percentage from nodes"),
)


NESTED_FAULTS = [
    ("rid % 31 = 0", r'("package":\{"quantity":\{"value":[0-9.]+,"unit":)"[a-z]+"', '$1"furlong"'),
    ("rid % 30 = 0", r'"verification":\{', '"verification":{"seen":1,'),
    ("rid % 27 = 0", r'"sources":\[\{', '"sources":[{"colour":"red",'),
    ("rid % 19 = 0", r'"not_declared":\["trans_fat_g"\]', '"not_declared":["trans_fat_g","sugar_g"]'),
]
PLAIN = "rid % 50 <> 0 and rid % 47 <> 0 and rid % 43 <> 0"


def record_texts(spark, d):
    """Record files: every 50th is cut short, every 47th has an unknown member, every 43rd no sources.

    Of the others every 31st has a strange unit in its package, every 30th a strange member in
    its verification and every 27th one in its first source; some lists name an unknown nutrient.
    """
    base = records(spark, d)
    columns = [c for c in base.columns if c not in ("rid", "path", "ingredients", "conflicts")]
    body = F.to_json(F.struct(*columns))
    odd = F.when(F.col("rid") % 47 == 0, F.concat(F.lit('{"colour":"red",'), F.substring(body, F.lit(2), F.length(body))))
    empty = F.when(
        F.col("rid") % 43 == 0, F.regexp_replace(body, r'"sources":\[[^\]]*\]', '"sources":[]')
    )
    changed = body
    for when, old, new in NESTED_FAULTS:
        changed = F.when(F.expr(when), F.regexp_replace(changed, old, new)).otherwise(changed)
    text = F.when(F.col("rid") % 50 == 0, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(
        F.coalesce(odd, empty, changed)
    )
    return base.select("rid", text.alias("text"))


register(
    "schema_findings",
    lambda spark, d: quality.text_findings(record_texts(spark, d), "rid").select("rid", "severity", "code", "pointer"),
    oracle(
        "select rid, 'error' as severity, code, pointer from ("
        "select rid, '0101' as code, '' as pointer from {label_rows} where rid % 50 = 0 union all "
        "select rid, '0201', '/colour' from {label_rows} where rid % 50 <> 0 and rid % 47 = 0 union all "
        "select rid, '0201', '/sources' from {label_rows} where rid % 50 <> 0 and rid % 47 <> 0 and rid % 43 = 0 "
        "union all select rid, '0201', '/verification/last_verified' from {label_rows} where rid % 50 <> 0 and "
        "last_verified = 'not a date' union all "
        "select rid, '0201', '/nutrition/0/serving' from {label_rows} where rid % 50 <> 0 and basis0 = 'per_serving' "
        "and serving_description is null union all "
        "select rid, '0201', '/nutrition/1/serving' from {label_rows} where rid % 50 <> 0 and basis1 = 'per_serving' "
        "union all select rid, '0201', '/countries/1' from {label_rows} where rid % 50 <> 0 and country2 like 'C%' "
        f"union all select rid, '0201', '/package/quantity/unit' from {{label_rows}} where {PLAIN} and rid % 31 = 0 and "
        "package_value is not null "
        f"union all select rid, '0201', '/verification/seen' from {{label_rows}} where {PLAIN} and rid % 30 = 0 "
        f"union all select rid, '0201', '/sources/0/colour' from {{label_rows}} where {PLAIN} and rid % 27 = 0 "
        f"union all select rid, '0201', '/nutrition/0/not_declared/1' from {{label_rows}} where {PLAIN} and rid % 19 = 0 "
        "and nd = 2 and basis0 is not null"
        ") s"
    ),
)
