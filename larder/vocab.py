"""Fixed values shared by the operators.

Everything here is a fixed value that decides results: closed vocabularies,
the nutrient list, the category mapping, accent tables and drop reasons.
"""

# Closed vocabularies, in order.
BASES = ["per_100g", "per_100ml", "per_serving", "per_package"]
UNITS = ["g", "kg", "ml", "l", "piece"]
BARCODE_FORMATS = ["EAN-13", "EAN-8", "UPC-A", "UPC-E", "GTIN-14", "ITF-14"]
SOURCE_TYPES = ["packaging", "manufacturer", "regulator", "open_database", "retailer", "community"]
CONFIDENCES = ["high", "medium", "low"]
STATUSES = ["verified", "unverified", "disputed"]
RESOLUTIONS = ["unresolved", "preferred_source", "human_decision"]

# Nutrients in panel order with display name and unit.
NUTRIENTS = [
    ("energy_kcal", "Energy", "kcal"),
    ("energy_kj", "Energy", "kJ"),
    ("protein_g", "Protein", "g"),
    ("carbohydrate_g", "Carbohydrate", "g"),
    ("sugars_g", "Sugars", "g"),
    ("added_sugars_g", "Added sugars", "g"),
    ("fat_g", "Fat", "g"),
    ("saturated_fat_g", "Saturated fat", "g"),
    ("trans_fat_g", "Trans fat", "g"),
    ("fibre_g", "Fibre", "g"),
    ("sodium_mg", "Sodium", "mg"),
]
NUTRIENT_IDS = [n[0] for n in NUTRIENTS]

# Export column stem and multiplier for each stored nutrient.
EXPORT_NUTRIENTS = [
    ("energy_kcal", "energy-kcal", 1),
    ("energy_kj", "energy-kj", 1),
    ("protein_g", "proteins", 1),
    ("carbohydrate_g", "carbohydrates", 1),
    ("sugars_g", "sugars", 1),
    ("fat_g", "fat", 1),
    ("saturated_fat_g", "saturated-fat", 1),
    ("trans_fat_g", "trans-fat", 1),
    ("fibre_g", "fiber", 1),
    ("sodium_mg", "sodium", 1000),
]

# Why an export row is dropped.
DROP_MALFORMED = "the source line is not valid JSON"
DROP_BARCODE = "barcode is missing, malformed, or fails its check digit"
DROP_REGION = "not sold in India and not an Indian barcode"
DROP_NAME = "no product name"

# Characters counted as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Accents folded in slugs (38) and in label text (25).
SLUG_ACCENTS = ("áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿšžø", "aaaaaaaeeeeeiiiiioooooouuuuuncyyszo")
SLUG_LIGATURES = [("æ", "ae"), ("œ", "oe"), ("ß", "ss")]
PHRASE_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")

# Export category tag and catalogue category, most specific first.
CATEGORY_MAP = [
    ("en:cream-biscuits", "cream-biscuits"),
    ("en:marie-biscuits", "marie-biscuits"),
    ("en:digestive-biscuits", "digestive-biscuits"),
    ("en:dry-biscuits", "biscuits"),
    ("en:crackers", "crackers"),
    ("en:cookies", "cookies"),
    ("en:biscuits-and-crackers", "biscuits"),
    ("en:biscuits", "biscuits"),
    ("en:cakes", "cakes"),
    ("en:rusks", "rusk"),
    ("en:breads", "bread"),
    ("en:chips-and-fries", "chips"),
    ("en:crisps", "chips"),
    ("en:extruded-snacks", "extruded-snacks"),
    ("en:namkeen", "namkeen"),
    ("en:salty-snacks", "namkeen"),
    ("en:chocolates", "chocolate"),
    ("en:chocolate-bars", "chocolate"),
    ("en:candies", "candy"),
    ("en:sweets", "candy"),
    ("en:ice-creams", "ice-cream"),
    ("en:yogurts", "yogurt"),
    ("en:cheeses", "cheese"),
    ("en:butters", "butter"),
    ("en:ghee", "ghee"),
    ("en:milks", "milk"),
    ("en:milk-powders", "milk-powder"),
    ("en:vegetable-oils", "edible-oil"),
    ("en:olive-oils", "edible-oil"),
    ("en:flours", "flour"),
    ("en:wheat-flours", "flour"),
    ("en:rices", "rice"),
    ("en:legumes", "pulses"),
    ("en:lentils", "pulses"),
    ("en:pasta", "pasta"),
    ("en:noodles", "noodles"),
    ("en:instant-noodles", "noodles"),
    ("en:breakfast-cereals", "breakfast-cereal"),
    ("en:oatmeals", "oats"),
    ("en:sugars", "sugar"),
    ("en:salts", "salt"),
    ("en:spices", "spices"),
    ("en:masalas", "spices"),
    ("en:teas", "tea"),
    ("en:coffees", "coffee"),
    ("en:sodas", "soft-drink"),
    ("en:energy-drinks", "energy-drink"),
    ("en:fruit-juices", "fruit-juice"),
    ("en:fruit-based-beverages", "fruit-drink"),
    ("en:waters", "water"),
    ("en:jams", "jam"),
    ("en:honeys", "honey"),
    ("en:peanut-butters", "nut-butter"),
    ("en:ketchup", "ketchup"),
    ("en:sauces", "sauce"),
    ("en:pickles", "pickle"),
    ("en:baby-foods", "baby-food"),
    ("en:protein-powders", "protein-supplement"),
    ("en:nuts", "nuts"),
    ("en:dried-fruits", "dried-fruit"),
    ("en:ready-made-meals", "ready-to-eat"),
    ("en:soups", "soup"),
]

# Default licence line of the open database export.
EXPORT_LICENCE = "ODbL-1.0 (database), DbCL-1.0 (contents)"
