"""Explicit schemas.  Nothing in the library infers a schema from data."""

from larder.vocab import NUTRIENT_IDS

VALUES = "struct<" + ",".join(f"{n}:double" for n in NUTRIENT_IDS) + ">"
QUANTITY = "struct<value:double,unit:string>"
SERVING = f"struct<description:string,quantity:{QUANTITY}>"
PANEL = f"struct<basis:string,serving:{SERVING},values:{VALUES},not_declared:array<string>>"
SOURCE = "struct<id:string,type:string,url:string,retrieved_at:string,licence:string,note:string>"
EVIDENCE = "struct<source:string,confidence:string,note:string>"
CONFLICT = (
    "struct<path:string,values:array<struct<source:string,value:string,note:string>>,"
    "resolution:string>"
)

# The product record.  `ingredients` stays JSON text because Spark has no
# recursive type; operators.ingredients flattens it.
PRODUCT_FIELDS = [
    ("gtin", "string"),
    ("barcode_printed", "string"),
    ("barcode_format", "string"),
    ("name", "string"),
    ("names", "map<string,string>"),
    ("brand", "string"),
    ("category", "string"),
    ("countries", "array<string>"),
    ("package", f"struct<quantity:{QUANTITY},multipack_count:int>"),
    ("nutrition", f"array<{PANEL}>"),
    ("ingredients_raw", "string"),
    ("ingredients", "string"),
    ("sources", f"array<{SOURCE}>"),
    ("provenance", f"map<string,{EVIDENCE}>"),
    ("conflicts", f"array<{CONFLICT}>"),
    ("verification", "struct<status:string,last_verified:string>"),
    ("schema_version", "int"),
]
PRODUCT_COLUMNS = [name for name, _ in PRODUCT_FIELDS]
PRODUCT = ", ".join(f"{name} {kind}" for name, kind in PRODUCT_FIELDS)

FINDING = "struct<severity:string,code:string,pointer:string,message:string>"

BRAND = (
    f"id string, name string, owner string, countries array<string>, "
    f"sources array<{SOURCE}>, provenance map<string,{EVIDENCE}>, schema_version int"
)
CATEGORY = (
    "id string, name string, parent string, substitutable_with array<string>, "
    "relevant_nutrients array<string>, typical_basis string, schema_version int"
)
COUNTRY = (
    "code string, name string, default_nutrition_basis string, sodium_declared_as string, "
    "schema_version int"
)
INGREDIENT = (
    "ordinal int, id string, name string, category string, explanation string, "
    f"aliases array<string>, flags array<string>, sources array<{SOURCE}>, "
    f"provenance map<string,{EVIDENCE}>, schema_version int"
)
BAND = (
    "rule_id string, version string, title string, summary string, basis string, form string, "
    "nutrient string, display string, unit string, derived_from string, multiply_by double, "
    "derived_note string, lower_at_or_below double, higher_above double, "
    "portion_higher_above double, portion_applies_above double, "
    "source_title string, source_url string, source_locator string, source_retrieved_at string"
)

# Columns of the catalogue tables, in order.
TABLES = {
    "meta": "key string, value string",
    "product": (
        "gtin string, barcode_printed string, barcode_format string, name string, "
        "brand_id string, category_id string, package_value double, package_unit string, "
        "multipack_count int, ingredients_raw string, verification_status string, "
        "last_verified string, is_complete int"
    ),
    "product_country": "gtin string, country string",
    "nutrition": (
        "gtin string, block_index int, basis string, serving_description string, "
        "serving_value double, serving_unit string, "
        + ", ".join(f"{n} double" for n in NUTRIENT_IDS)
    ),
    "nutrition_not_declared": "gtin string, block_index int, field string",
    "ingredient_item": (
        "gtin string, ordinal int, parent_ordinal int, raw string, canonical_id string, "
        "percentage double"
    ),
    "ingredient": "id string, name string, category string, explanation string",
    "ingredient_alias": "ingredient_id string, alias string",
    "ingredient_flag": "ingredient_id string, flag string",
    "category_peer_stat": (
        "category_id string, basis string, nutrient string, peer_count bigint, "
        "lower_value double, higher_value double, rule_id string, rule_version string"
    ),
    "brand": "id string, name string, owner string",
    "category": "id string, name string, parent_id string, typical_basis string",
    "category_substitute": "category_id string, substitute_id string",
    "category_nutrient": "category_id string, field string",
    "country": "code string, name string, default_basis string, sodium_declared_as string",
    "source": (
        "gtin string, source_id string, type string, url string, retrieved_at string, "
        "licence string"
    ),
    "provenance": "gtin string, path string, source_id string, confidence string",
    "product_search": "name string, brand string, gtin string",
}
