"""Data-quality rules as one findings table.

A finding is (key, severity, code, pointer, message).  Codes are the numeric part of the
published rule table, for example 0401.
"""

from functools import reduce

from pyspark.sql import functions as F

from larder import vocab
from larder.functions.barcodes import (
    expected_length,
    has_valid_check_digit,
    normalize_gtin,
    record_path,
)
from larder.functions.dates import as_day, parse_day
from larder.functions.nutrients import declared_fields
from larder.functions.numbers import show_one, show_whole
from larder.functions.pointers import covers, pointer_of, resolves
from larder.operators.dedup import duplicate_keys
from larder.operators.ingredients import flatten_ingredients, level_totals, node_pointer, tree_nodes
from larder.operators.sizes import broadcast_if_small
from larder.schemas import FINDING
from larder.sources.export import settled

FINDINGS = f"array<{FINDING}>"

# Tolerances and factors of the arithmetic rules.
MASS_TOLERANCE_G = 0.1
MASS_BUDGET_G = 101.0
ENERGY_TOLERANCE = 0.20
ENERGY_UNIT_TOLERANCE = 0.05
SODIUM_LIMIT_MG = 10_000.0
KJ_PER_KCAL = 4.184
SALT_PER_SODIUM = 2.54
PERCENT_LIMIT = 100.5
STALE_AFTER_DAYS = 365

# Order of severities.
SEVERITY_RANK = {"info": 0, "warning": 1, "error": 2}


def finding(condition, severity, code, pointer, message):
    def text(x):
        return F.lit(x) if isinstance(x, str) else x

    return F.when(
        condition,
        F.struct(
            F.lit(severity).alias("severity"),
            F.lit(code).alias("code"),
            text(pointer).alias("pointer"),
            text(message).alias("message"),
        ),
    )


def _chosen(rules, codes):
    """The rules, a dict by code, whose code is wanted; codes None wants all."""
    return [rule for code, rule in rules.items() if codes is None or code in codes]


def _some(array):
    """A findings array that is never null."""
    return F.coalesce(array, F.array().cast(FINDINGS))


# ------------------------------------------------------------------ panel rules


def consistency_rules(panel, index, category):
    """Arithmetic rules of one panel, as nullable findings by code."""
    v = panel["values"]
    basis = panel["basis"]
    at = F.concat(F.lit("/nutrition/"), index.cast("string"))
    per_100 = basis.isin("per_100g", "per_100ml")

    def part(small, large, code, text):
        return finding(
            v[small] > v[large] + MASS_TOLERANCE_G, "error", code, F.concat(at, F.lit(f"/values/{small}")),
            F.format_string(text, show_one(v[small]), show_one(v[large])),
        )

    def grams(name):
        return F.coalesce(v[name], F.lit(0.0))

    # Fibre counts only when carbohydrate is missing, because labels often declare both.
    fibre = F.when(v["carbohydrate_g"].isNull(), grams("fibre_g")).otherwise(0.0)
    mass = grams("protein_g") + grams("carbohydrate_g") + grams("fat_g") + fibre
    kcal, kj, sodium = v["energy_kcal"], v["energy_kj"], v["sodium_mg"]
    worked = grams("protein_g") * 4 + grams("carbohydrate_g") * 4 + grams("fat_g") * 9 + fibre * 2
    some_macro = F.coalesce(v["protein_g"], v["carbohydrate_g"], v["fat_g"]).isNotNull()
    drift = F.abs(kcal - worked) / F.when(worked > 0, worked)
    expected_kj = kcal * KJ_PER_KCAL
    rules = [
        part("saturated_fat_g", "fat_g", "0401", "Saturated fat of %s g exceeds fat of %s g."),
        part("trans_fat_g", "fat_g", "0404", "Trans fat of %s g exceeds fat of %s g."),
        part("sugars_g", "carbohydrate_g", "0402", "Sugars of %s g exceed carbohydrate of %s g."),
        part("added_sugars_g", "sugars_g", "0403", "Added sugars of %s g exceed sugars of %s g."),
        finding(
            per_100 & (mass > MASS_BUDGET_G), "error", "0405", F.concat(at, F.lit("/values")),
            F.format_string(
                "Macronutrients of %s g do not fit into %s.",
                show_one(mass), F.when(basis == "per_100g", "100 g").otherwise("100 ml"),
            ),
        ),
        finding(
            (kcal > 0) & some_macro & (drift > ENERGY_TOLERANCE), "warning", "0406",
            F.concat(at, F.lit("/values/energy_kcal")),
            F.format_string(
                "Energy of %s kcal is %s%% away from the %s kcal of its macronutrients.",
                show_one(kcal), show_whole(drift * 100), show_one(worked),
            ),
        ),
        finding(
            (kcal > 0) & (F.abs(kj - expected_kj) / expected_kj > ENERGY_UNIT_TOLERANCE), "warning", "0407",
            F.concat(at, F.lit("/values/energy_kj")),
            F.format_string(
                "Energy of %s kJ does not match %s kcal, which are %s kJ.",
                show_one(kj), show_one(kcal), show_whole(expected_kj),
            ),
        ),
        finding(
            per_100 & ~category.eqNullSafe("salt") & (sodium > SODIUM_LIMIT_MG), "warning", "0411",
            F.concat(at, F.lit("/values/sodium_mg")),
            F.format_string(
                "Sodium of %s mg in 100 means %s g of salt.",
                show_whole(sodium), show_one(sodium * SALT_PER_SODIUM / 1000),
            ),
        ),
    ]
    return dict(zip(("0401", "0404", "0402", "0403", "0405", "0406", "0407", "0411"), rules, strict=True))


def panel_findings(panel, index, category, bases, codes=None):
    """All findings of one panel, or those of codes.  bases is the list of bases of its record."""
    at = F.concat(F.lit("/nutrition/"), index.cast("string"))
    first = F.array_position(bases, panel["basis"]).cast("int") - 1
    repeated = finding(
        first < index, "error", "0408", F.concat(at, F.lit("/basis")),
        F.format_string(
            "A panel %s comes earlier, at index %d; a basis may be declared once.",
            panel["basis"], first,
        ),
    )
    weightless = finding(
        (panel["basis"] == "per_serving") & panel["serving"]["quantity"].isNull(), "warning", "0409",
        F.concat(at, F.lit("/serving")),
        "The serving has no size, so its figures have no common measure with those of other products.",
    )
    declared = declared_fields(panel["values"])
    contradictions = F.transform(
        panel["not_declared"],
        lambda field, i: finding(
            F.array_contains(declared, field), "error", "0410",
            F.concat(at, F.lit("/not_declared/"), i.cast("string")),
            F.concat(
                field,
                F.lit(" has a value although the panel lists it among the fields without one."),
            ),
        ),
    )
    rules = {"0408": repeated, "0409": weightless, **consistency_rules(panel, index, category)}
    fixed = F.array(*_chosen(rules, codes)).cast(FINDINGS)
    if codes is not None and "0410" not in codes:
        return fixed
    return F.when(
        F.coalesce(F.size(panel["not_declared"]) > 0, F.lit(False)), F.concat(fixed, _some(contradictions))
    ).otherwise(fixed)


# ------------------------------------------------------------------ record rules


def identity_rules():
    """Rules of the printed code; `_valid` and `_canonical` of prepared say what it is."""
    printed, gtin, shape = F.col("barcode_printed"), F.col("gtin"), F.col("barcode_format")
    valid, canonical = F.col("_valid"), F.col("_canonical")
    digits = expected_length(shape)
    return {
        "0301": finding(
            ~valid, "error", "0301", "/barcode_printed",
            F.format_string(
                "The last digit of %s does not fit the others: a digit was read or typed wrongly.",
                printed,
            ),
        ),
        "0302": finding(
            valid & (canonical != gtin), "error", "0302", "/gtin",
            F.format_string(
                "The key of this code is %s: the printed digits with zeros before them, 14 in all.",
                canonical,
            ),
        ),
        "0303": finding(
            valid & (F.length(printed) != digits), "warning", "0303", "/barcode_format",
            F.format_string(
                "Codes of the format %s have %d digits; this one has %d.",
                shape, digits, F.length(printed),
            ),
        ),
    }


def location_rule(path):
    """0103 for a record under data/ that is not where its key implies."""
    expected = F.col("_place")
    return finding(
        path.startswith("data/") & (path != expected), "error", "0103", "/gtin",
        F.format_string(
            "Lookups read this key from %s only.", expected
        ),
    )


def verification_rules(today):
    day = as_day(today)
    checked = F.col("_checked")
    at = "/verification/last_verified"
    return {
        "0801": finding(
            checked > day, "error", "0801", at,
            F.format_string("The check is dated %s, a day still to come.", checked.cast("string")),
        ),
        "0802": finding(
            F.date_add(checked, STALE_AFTER_DAYS) < day, "info", "0802", at,
            F.format_string(
                "The last check, of %s, is more than a year old.",
                checked.cast("string"),
            ),
        ),
    }


def ingredient_rules():
    tree = F.col("ingredients")
    return {
        "0601": finding(
            tree.rlike(r"^\s*\[\s*\{") & (F.trim(F.coalesce("ingredients_raw", F.lit(""))) == ""),
            "error", "0601", "/ingredients",
            "There is an ingredient tree but not the printed text it was parsed from.",
        )
    }


def percentage_findings():
    """0603 per list of a tree whose declared percentages exceed the limit."""
    over = F.filter(level_totals(F.col("_nodes")), lambda t: t["total"] > PERCENT_LIMIT)
    return F.transform(
        over,
        lambda t: finding(
            F.lit(True), "warning", "0603", t["pointer"],
            F.format_string("Shares on one level make %s%% in all.", show_one(t["total"])),
        ),
    )


def required_pointers():
    """Pointers of a product that need provenance: claims that say something, and each panel.

    Those whose name is itself a path of the provenance are covered and left out here.
    """

    def claim(name, present):
        return F.when(present, F.lit(f"/{name}"))

    claims = F.array_compact(
        F.array(
            claim("name", F.col("name") != ""),
            claim("names", F.size("names") > 0),
            claim("brand", F.col("brand") != ""),
            claim("category", F.col("category") != ""),
            claim("package", F.col("package").isNotNull()),
            claim("ingredients_raw", F.col("ingredients_raw") != ""),
            claim("ingredients", ~F.col("ingredients").rlike(r"^\s*(\[\s*\])?\s*$")),
        )
    )
    count = F.coalesce(F.size("nutrition"), F.lit(0))
    named = F.array_contains(F.map_keys("provenance"), "nutrition")
    panels = F.transform(
        F.when((count > 0) & ~named, F.sequence(F.lit(0), count - 1)),
        lambda i: F.concat(F.lit("/nutrition/"), i.cast("string")),
    )
    return F.concat(unnamed(claims), F.coalesce(panels, F.array().cast("array<string>")))


def unnamed(claims):
    """Claims (pointers of one step) without a provenance path of just their name."""
    named = F.concat(F.lit("/"), F.array_join(F.map_keys("provenance"), "\0/"))
    return F.array_except(claims, F.split(named, "\0"))


def uncovered(required, covered):
    """Required pointers no covered pointer equals or lies above."""
    return F.when(F.size(required) > 0, F.filter(required, lambda r: ~F.exists(covered, lambda c: covers(c, r))))


def prepared(records, required, needed=True, raw=None, tree=False, canonical=False):
    """Adds what the record rules look at repeatedly: _required, _covered, _document and, for
    products with their tree, _nodes, _valid, _canonical, _place and _checked.

    They are columns because a lambda or a second rule would work them out again, and settled because
    Spark would put a column that is mentioned once back into the lambda that mentions it.
    """
    wanted = F.lit(needed) if isinstance(needed, bool) else needed
    columns = {
        "_required": F.when(wanted, required),
        "_used": F.when(wanted, F.map_values("provenance")["source"]),
    }
    if tree:
        # A tree without a percentage cannot exceed anything; skip the walk.
        stated = F.col("ingredients").contains('"percentage"')
        if canonical:
            stated = stated | F.col("ingredients").contains('"canonical"')
        columns["_nodes"] = F.when(wanted & stated, tree_nodes(F.col("ingredients")))
        columns["_valid"] = F.when(wanted, has_valid_check_digit(F.col("barcode_printed")))
        columns["_canonical"] = F.when(wanted, normalize_gtin(F.col("barcode_printed")))
        columns["_place"] = F.when(wanted, F.concat(F.lit("data/"), record_path(F.col("gtin"))))
        columns["_checked"] = F.when(wanted, parse_day(F.col("verification.last_verified")))
    if raw is not None:
        columns["_document"] = F.when(wanted, F.try_parse_json(F.col(raw)))
    covered = F.when(F.size("_required") > 0, F.transform(F.map_keys("provenance"), pointer_of))
    return settled(records.withColumns(columns).withColumn("_covered", covered))


def provenance_findings(document=None, verified=None, conflicts=None, codes=None):
    """Source coverage of a prepared record, as a findings array; of codes alone, if given.

    document is the record as a variant; without it stale paths are not looked for.
    """
    entries = F.map_entries(F.col("provenance"))
    ids = F.col("sources.id")
    used = F.col("_used")

    def at(entry):
        return F.concat(F.lit("/provenance/"), entry["key"])

    def lacks(some, others):
        """Is there one of some that is not among the others?  Says without a lambda if any is looked for."""
        return F.size(F.array_except(some, others)) > 0

    parts = {
        "0502": F.transform(
            F.when(lacks(used, ids), entries),
            lambda e: finding(
                ~F.array_contains(ids, e["value"]["source"]), "error", "0502", at(e),
                F.format_string(
                    "The record has no source named '%s'.", e["value"]["source"]
                ),
            ),
        ),
        "0501": F.transform(
            uncovered(F.col("_required"), F.col("_covered")),
            lambda r: finding(
                F.lit(True), "error", "0501", r,
                F.format_string(
                    "No provenance entry stands for '%s' or for a path above it.",
                    r,
                ),
            ),
        ),
        "0504": F.transform(
            F.when(lacks(ids, used), F.filter(ids, lambda i: ~F.array_contains(used, i))),
            lambda i: finding(
                F.lit(True), "info", "0504", "/sources",
                F.format_string("No entry uses the source '%s'.", i),
            ),
        ),
    }
    if document is not None:
        parts["0503"] = F.transform(
            F.filter(entries, lambda e: ~resolves(document, pointer_of(e["key"]))),
            lambda e: finding(
                F.lit(True), "warning", "0503", at(e),
                F.format_string(
                    "The record has nothing at '%s' that this entry could stand for.",
                    e["key"],
                ),
            ),
        )
    if verified is not None:
        low = F.array_contains(F.map_values("provenance")["confidence"], "low")
        parts["0505"] = F.transform(
            F.when(verified & low, F.filter(entries, lambda e: e["value"]["confidence"] == "low")),
            lambda e: finding(
                F.lit(True), "error", "0505", at(e),
                "The record is marked verified while this entry's confidence is low.",
            ),
        )
        parts["0506"] = F.array(
            finding(
                verified & F.array_contains(conflicts["resolution"], "unresolved"),
                "error", "0506", "/verification/status",
                "The record is marked verified while its sources still disagree.",
            )
        )
    return F.concat(F.array().cast(FINDINGS), *[_some(p.cast(FINDINGS)) for p in _chosen(parts, codes)])


# ------------------------------------------------------------------ jobs


def row_findings(products, today, key="gtin", path=None, raw=None, codes=None):
    """Every row-local rule in one scan.

    inline_outer, because inline makes Spark infer a size filter that repeats the rules.
    The record is exploded once into slot 0 (the record's own rules) and one slot per
    panel, so the panel arithmetic runs on plain columns.  path is the column with the
    record's path (rule 0103) and raw the column with its JSON text (rule 0503).  codes
    are the rules that the caller keeps: Spark cannot push a filter on the code below the
    explode, so the others would be worked out for every record and thrown away.
    """
    slotted, found = _slotted(products, today, path, raw, codes=codes)
    return exploded(slotted, [key], found)


# Rules of severity error; a test compares them with what the rules themselves say.
ERROR_CODES = {
    "0103", "0301", "0302", "0401", "0402", "0403", "0404", "0405", "0408", "0410", "0501", "0502", "0505", "0506",
    "0601", "0801",
}
# Rules that look at a panel; all others look at the record.
PANEL_CODES = {"0401", "0402", "0403", "0404", "0405", "0406", "0407", "0408", "0409", "0410", "0411"}


def _slotted(products, today, path=None, raw=None, canonical=False, codes=None):
    """products, prepared, a row per slot that has rules to run, and the findings of a slot as an array."""
    of_panel = panel_findings(F.col("_panel"), F.col("_slot") - 1, F.col("category"), F.col("nutrition.basis"), codes)
    if codes is not None and PANEL_CODES.issuperset(codes):
        return products.select("*", F.posexplode("nutrition").alias("_at", "_panel")).withColumn("_slot", F.col("_at") + 1), of_panel
    own = record_findings(today, path, raw, codes)
    if codes is not None and PANEL_CODES.isdisjoint(codes):
        return prepared(products, required_pointers(), True, raw, tree=True, canonical=canonical), own
    panel_type = products.schema["nutrition"].dataType.simpleString()
    slots = F.concat(
        F.array(F.lit(None)).cast(panel_type), F.coalesce("nutrition", F.array().cast(panel_type))
    )
    slotted = prepared(
        products.select("*", F.posexplode(slots).alias("_slot", "_panel")), required_pointers(),
        F.col("_slot") == 0, raw, tree=True, canonical=canonical,
    )
    return slotted, F.when(F.col("_slot") == 0, own).otherwise(of_panel)


def record_findings(today, path=None, raw=None, codes=None):
    """Findings of a record's own fields, as an array of nullable findings; of codes alone, if given."""
    rules = {**identity_rules(), **ingredient_rules(), **verification_rules(today)}
    if path is not None:
        rules["0103"] = location_rule(F.col(path))
    document = F.col("_document") if raw is not None else None
    shares = {"0603": _some(percentage_findings().cast(FINDINGS))}
    return F.concat(
        F.array(*_chosen(rules, codes)).cast(FINDINGS),
        *_chosen(shares, codes),
        provenance_findings(
            document, F.col("verification.status") == "verified", F.col("conflicts"), codes
        ),
    )


def with_row_error(products, today, flag):
    """Adds flag: does the product break a row-local rule of severity error?

    No explode and no join, so the row stays where it is.  Rules of other severities cannot set
    it and are not worked out.
    """
    codes = ERROR_CODES
    of_panels = F.flatten(
        F.transform(
            "nutrition",
            lambda p, i: panel_findings(p, i, F.col("category"), F.col("nutrition.basis"), codes),
        )
    )
    found = F.concat(record_findings(today, codes=codes), _some(of_panels))
    broken = F.exists("_found", lambda f: F.coalesce(f["severity"] == "error", F.lit(False)))
    judged = prepared(products, required_pointers(), tree=True).select(*products.columns, found.alias("_found"))
    # Put into the lambda, the rules would be interpreted.
    return settled(judged).select(*products.columns, broken.alias(flag))


def exploded(rows, keys, found):
    """keys and the findings of each row, an array of nullable findings.

    The array is a column before it is exploded, and no lambda goes over it as a whole: inside a
    generator or a lambda Spark interprets what it compiles in a projection.
    """
    listed = rows.select(*keys, found.alias("_found"))
    return listed.select(*keys, F.inline_outer("_found")).where(F.col("code").isNotNull())


def only(findings, *codes):
    return findings.where(F.col("code").isin(*codes))


def _missing(references, known, severity, code, key, message):
    """References whose value has no record; null and empty values are no reference."""
    ids = known.select(F.col(known.columns[0]).alias("value")).distinct()
    lost = references.where(F.col("value") != "").join(broadcast_if_small(ids), "value", "left_anti")
    return lost.select(
        key,
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        "pointer",
        message(F.col("value")).alias("message"),
    )


def _no_record(noun, folder):
    return lambda value: F.format_string(
        f"The {noun} '%s' has no record; data/{folder}/%s.json would hold it.", value, value,
    )


def unknown_brands(products, brand_ids, key="gtin"):
    refs = products.select(key, F.col("brand").alias("value"), F.lit("/brand").alias("pointer"))
    return _missing(refs, brand_ids, "warning", "0702", key, _no_record("brand", "brands"))


def unknown_categories(products, category_ids, key="gtin"):
    refs = products.select(key, F.col("category").alias("value"), F.lit("/category").alias("pointer"))
    return _missing(refs, category_ids, "warning", "0703", key, _no_record("category", "categories"))


def unknown_countries(products, country_codes, key="gtin"):
    refs = products.select(key, F.posexplode("countries").alias("_i", "value")).withColumn(
        "pointer", F.concat(F.lit("/countries/"), F.col("_i").cast("string"))
    )
    return _missing(refs, country_codes, "warning", "0704", key, _no_record("country", "countries"))


def unmatched_ingredients(products, ingredient_ids, key="gtin"):
    named = products.where(F.col("ingredients").contains('"canonical"'))
    refs = flatten_ingredients(named, key).select(
        key, F.col("canonical_id").alias("value"), F.concat("pointer", F.lit("/canonical")).alias("pointer")
    )
    return _missing(
        refs, ingredient_ids, "info", "0602", key,
        lambda value: F.format_string("The ingredient '%s' has no record.", value),
    )


def duplicate_gtins(products, key, path):
    """0701 for the second and later record of a gtin; key is the record key to report."""
    repeats = duplicate_keys(products.select(F.col("gtin"), F.col(path)), "gtin", path)
    return repeats.select(
        F.col(path if key == path else "gtin").alias(key),
        F.lit("error").alias("severity"),
        F.lit("0701").alias("code"),
        F.lit("/gtin").alias("pointer"),
        F.format_string(
            "The code %s also stands in %s, which comes first.",
            F.col("gtin"), F.col("first_path"),
        ).alias("message"),
    )


def _references():
    """What a prepared record refers to, as findings whose message is the name referred to."""

    def reference(value, severity, code, pointer):
        return finding(value != "", severity, code, pointer, value)

    countries = F.transform(
        "countries", lambda c, i: reference(c, "warning", "0704", F.concat(F.lit("/countries/"), i.cast("string")))
    )
    named = F.filter("_nodes", lambda n: n["canonical"].isNotNull())
    ingredients = F.transform(
        named,
        lambda n: reference(
            n["canonical"], "info", "0602", F.concat(node_pointer(n["path"]), F.lit("/canonical"))
        ),
    )
    own = F.array(
        reference(F.col("brand"), "warning", "0702", "/brand"),
        reference(F.col("category"), "warning", "0703", "/category"),
    )
    return F.concat(own.cast(FINDINGS), _some(countries.cast(FINDINGS)), _some(ingredients.cast(FINDINGS)))


def _without_known(findings, dims):
    """findings less those references whose name has a record; the others get their message.

    Other findings have codes that no dimension has, so one join serves all.
    """
    codes = {"0702": "brand", "0703": "category", "0704": "country", "0602": "ingredient"}
    known = reduce(
        lambda a, b: a.unionByName(b),
        [
            dims[d].select(F.lit(code).alias("code"), F.col(dims[d].columns[0]).cast("string").alias("message"))
            for code, d in codes.items()
        ],
    ).distinct()
    lost = findings.join(broadcast_if_small(known), ["code", "message"], "left_anti")
    value, code = F.col("message"), F.col("code")
    message = (
        F.when(code == "0702", _no_record("brand", "brands")(value))
        .when(code == "0703", _no_record("category", "categories")(value))
        .when(code == "0704", _no_record("country", "countries")(value))
        .when(code == "0602", F.format_string("The ingredient '%s' has no record.", value))
        .otherwise(value)
    )
    return lost.withColumn("message", message)


def cross_findings(products, dims, key="gtin", path=None):
    """Rules that look at other records, in one scan.  dims: brand, category, country, ingredient."""
    named = F.col("ingredients").contains('"canonical"')
    nodes = products.withColumn("_nodes", F.when(named, tree_nodes(F.col("ingredients"))))
    found = _without_known(exploded(nodes, [key], _references()), dims)
    found = found.select(key, "severity", "code", "pointer", "message")
    return found if path is None else found.unionByName(duplicate_gtins(products, key, path))


def all_findings(products, dims, today, key="gtin", path=None, raw=None):
    """Row-local and cross-record findings, in one scan of the records and one join."""
    slotted, found = _slotted(products, today, path, raw, canonical=True)
    # No lambda over it as a whole: see exploded.
    both = F.concat(found, F.when(F.col("_slot") == 0, _references()).otherwise(F.array().cast(FINDINGS)))
    found = _without_known(exploded(slotted, [key], both), dims)
    found = found.select(key, "severity", "code", "pointer", "message")
    return found if path is None else found.unionByName(duplicate_gtins(products, key, path))


def reference_findings(records, key, claims):
    """Provenance rules of brand (name, owner) or ingredient (aliases, flags, explanation) records."""
    kinds = dict(records.dtypes)

    def present(name):
        return F.size(name) > 0 if kinds[name].startswith(("array", "map")) else F.col(name) != ""

    required = F.array_compact(F.array(*[F.when(present(c), F.lit(f"/{c}")) for c in claims]))
    return exploded(prepared(records, unnamed(required)), [key], provenance_findings())


def ordered(findings, key="gtin"):
    """Report order: record, severity descending, pointer, code."""
    rank = reduce(
        lambda chain, item: chain.when(F.col("severity") == item[0], item[1]), SEVERITY_RANK.items(), F
    )
    return findings.orderBy(key, F.desc(rank), "pointer", "code")


# ------------------------------------------------------------------ record text

# Shape of a product record.
REQUIRED = [
    "schema_version", "gtin", "barcode_printed", "barcode_format", "name",
    "countries", "sources", "provenance", "verification",
]
OPTIONAL = [
    "names", "brand", "category", "package", "nutrition", "ingredients_raw", "ingredients", "conflicts",
]
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


# The members of nested objects; no others are allowed.
MEMBERS = {
    "package": ["quantity", "multipack_count"],
    "quantity": ["value", "unit"],
    "panel": ["basis", "serving", "values", "not_declared"],
    "serving": ["description", "quantity"],
    "source": ["id", "type", "url", "retrieved_at", "licence", "note"],
    "evidence": ["source", "confidence", "note"],
    "conflict": ["path", "values", "resolution"],
    "verification": ["status", "last_verified"],
}
OBJECT = "map<string,variant>"


def _strange(node, kind, at):
    """0201 for each member of a parsed object that its kind does not have."""
    names = F.filter(F.map_keys(node), lambda n: ~n.isin(*MEMBERS[kind]))
    return _some(
        F.transform(
            names,
            lambda n: finding(
                F.lit(True), "error", "0201", F.concat(at, F.lit("/"), n),
                F.format_string(f"member %s is not part of a {kind}", n),
            ),
        ).cast(FINDINGS)
    )


def _each(items, rule):
    """The findings of a rule on every item of an array, given its index."""
    return _some(F.flatten(F.transform(items, rule)).cast(FINDINGS))


def _nested_shape():
    """Findings inside nested objects of `doc`: member sets and closed values.

    A rule names the innermost place that fails.
    """

    def get(path, kind):
        return F.try_variant_get(F.col("doc"), path, kind)

    def inside(node, name, kind=OBJECT):
        return F.try_variant_get(F.element_at(node, name), "$", kind)

    def wrong(value, good, at, message):
        bad = F.coalesce(value.isNotNull() & ~good, F.lit(False))
        return F.array(finding(bad, "error", "0201", at, message)).cast(FINDINGS)

    def amount(node, at):
        quantity, place = inside(node, "quantity"), F.concat(at, F.lit("/quantity"))
        unit = inside(quantity, "unit", "string")
        return F.concat(
            _strange(quantity, "quantity", place),
            wrong(unit, unit.isin(*vocab.UNITS), F.concat(place, F.lit("/unit")), "unknown unit"),
        )

    def at(path, i):
        return F.concat(F.lit(f"/{path}/"), i.cast("string"))

    def panel(p, i):
        place = at("nutrition", i)
        serving = inside(p, "serving")
        absent = inside(p, "not_declared", "array<string>")
        return F.concat(
            _strange(p, "panel", place),
            _strange(serving, "serving", F.concat(place, F.lit("/serving"))),
            amount(serving, F.concat(place, F.lit("/serving"))),
            _each(
                absent,
                lambda n, j: wrong(
                    n, n.isin(*vocab.NUTRIENT_IDS),
                    F.concat(place, F.lit("/not_declared/"), j.cast("string")), "not a nutrient",
                ),
            ),
        )

    def conflict(c, i):
        resolution = inside(c, "resolution", "string")
        return F.concat(
            _strange(c, "conflict", at("conflicts", i)),
            wrong(
                resolution, resolution.isin(*vocab.RESOLUTIONS),
                F.concat(at("conflicts", i), F.lit("/resolution")), "unknown resolution",
            ),
        )

    return F.concat(
        _strange(get("$.package", OBJECT), "package", F.lit("/package")),
        amount(get("$.package", OBJECT), F.lit("/package")),
        _strange(get("$.verification", OBJECT), "verification", F.lit("/verification")),
        _each(
            get("$.countries", "array<string>"),
            lambda c, i: wrong(c, c.rlike("^[A-Z]{2}$"), at("countries", i), "not a country code"),
        ),
        _each(get("$.nutrition", f"array<{OBJECT}>"), panel),
        _each(get("$.sources", f"array<{OBJECT}>"), lambda s, i: _strange(s, "source", at("sources", i))),
        _each(get("$.conflicts", f"array<{OBJECT}>"), conflict),
        _each(
            F.map_entries(get("$.provenance", f"map<string,{OBJECT}>")),
            lambda e, i: _strange(e["value"], "evidence", F.concat(F.lit("/provenance/"), e["key"])),
        ),
    )


def text_findings(records, key="path", text="text"):
    """0101 for text that is not JSON and 0201 for records that break the record shape.

    Shape rules: required members, closed member sets at every level, allowed values,
    patterns and minima.
    """
    doc = F.try_parse_json(F.col(text))
    parsed = records.select(key, doc.alias("doc"), F.col(text).alias("text"))

    def get(path, kind="string"):
        return F.try_variant_get(F.col("doc"), path, kind)

    def broken(condition, pointer, message):
        return finding(F.coalesce(condition, F.lit(False)), "error", "0201", pointer, message)

    names = F.json_object_keys(F.col("text"))
    rules = [
        broken(get(f"$.{m}", "variant").isNull(), f"/{m}", f"required member {m} is missing")
        for m in REQUIRED
    ]
    rules += [
        broken(get("$.gtin") .rlike("^[0-9]{14}$") == F.lit(False), "/gtin", "gtin is not 14 digits"),
        broken(~get("$.barcode_printed").rlike("^[0-9]{6,14}$"), "/barcode_printed", "barcode_printed is not digits"),
        broken(~get("$.barcode_format").isin(*vocab.BARCODE_FORMATS), "/barcode_format", "unknown barcode_format"),
        broken(get("$.schema_version", "int") != 1, "/schema_version", "schema_version is not 1"),
        broken(F.trim(get("$.name")) == "", "/name", "name is empty"),
        broken(~get("$.brand").rlike(SLUG), "/brand", "brand is not a slug"),
        broken(~get("$.category").rlike(SLUG), "/category", "category is not a slug"),
        broken(F.size(get("$.countries", "array<variant>")) < 1, "/countries", "countries is empty"),
        broken(F.size(get("$.sources", "array<variant>")) < 1, "/sources", "sources is empty"),
        broken(~get("$.verification.status").isin(*vocab.STATUSES), "/verification/status", "unknown status"),
        broken(
            ~get("$.verification.last_verified").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
            "/verification/last_verified", "last_verified is not a date",
        ),
    ]
    extra = F.transform(
        F.filter(names, lambda n: ~n.isin(*REQUIRED, *OPTIONAL)),
        lambda n: finding(
            F.lit(True), "error", "0201", F.concat(F.lit("/"), n),
            F.format_string("member %s is not part of the record", n),
        ),
    )
    panels = F.transform(
        get("$.nutrition", "array<struct<basis:string,serving:variant,values:map<string,variant>>>"),
        _panel_shape,
    )
    sources = F.transform(
        get("$.sources", "array<struct<type:string>>"),
        lambda s, i: broken(
            ~s["type"].isin(*vocab.SOURCE_TYPES),
            F.concat(F.lit("/sources/"), i.cast("string"), F.lit("/type")), "unknown source type",
        ),
    )
    evidence = F.transform(
        F.map_entries(get("$.provenance", "map<string,struct<confidence:string>>")),
        lambda e: broken(
            ~e["value"]["confidence"].isin(*vocab.CONFIDENCES),
            F.concat(F.lit("/provenance/"), e["key"], F.lit("/confidence")), "unknown confidence",
        ),
    )
    unreadable = F.array(
        finding(F.lit(True), "error", "0101", "", "This file is not valid JSON.")
    ).cast(FINDINGS)
    shape = F.concat(
        F.array(*rules).cast(FINDINGS),
        *[_some(a.cast(FINDINGS)) for a in (extra, F.flatten(panels), sources, evidence)],
        _nested_shape(),
    )
    found = F.when(F.col("doc").isNull(), unreadable).otherwise(shape)
    return exploded(parsed, [key], found)


def _panel_shape(panel, i):
    at = F.concat(F.lit("/nutrition/"), i.cast("string"))

    def broken(condition, pointer, message):
        return finding(F.coalesce(condition, F.lit(False)), "error", "0201", pointer, message)

    values = F.map_entries(panel["values"])
    fixed = F.array(
        broken(
            panel["basis"].isNull() | ~panel["basis"].isin(*vocab.BASES),
            F.concat(at, F.lit("/basis")), "basis is missing or unknown",
        ),
        broken(
            (panel["basis"] == "per_serving") & panel["serving"].isNull(),
            F.concat(at, F.lit("/serving")), "per_serving needs a serving",
        ),
        broken(panel["values"].isNull(), F.concat(at, F.lit("/values")), "values is missing"),
    )
    per_value = F.transform(
        values,
        lambda e: broken(
            ~e["key"].isin(*vocab.NUTRIENT_IDS)
            | F.coalesce(F.try_variant_get(e["value"], "$", "double") < 0, F.lit(True)),
            F.concat(at, F.lit("/values/"), e["key"]), "not a nutrient, or not a number of at least 0",
        ),
    )
    return F.concat(fixed.cast(FINDINGS), _some(per_value.cast(FINDINGS)))


def unloadable(typed, key="path"):
    """0104: the text is JSON of the right shape, but a required field does not load."""
    lost = F.col("gtin").isNull() | F.col("name").isNull() | F.col("verification.status").isNull()
    return typed.where(lost).select(
        key,
        F.lit("error").alias("severity"),
        F.lit("0104").alias("code"),
        F.lit("").alias("pointer"),
        F.lit("The text has the right shape, but a required field is lost when it is read.").alias("message"),
    )


def validate_text(records, today, dims=None, key="path", text="text"):
    """All rules over record text: a record with a shape failure gets no other finding.

    The text is parsed to the typed record once its shape is accepted.
    """
    from larder.sources.records import parse_records

    shape = text_findings(records, key, text)
    typed = parse_records(records, key, text).join(shape.select(key).distinct(), key, "left_anti")
    parts = [shape, unloadable(typed, key), row_findings(typed, today, key, path=key, raw="raw")]
    if dims is not None:
        parts.append(cross_findings(typed, dims, key, path=key))
    return reduce(lambda a, b: a.unionByName(b), parts)
