"""Peers, bands, phrases, search, scans and the product view."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bindings import TODAY, oracle, records, table
from checks.expressions import half_away
from checks.imports import with_raw
from checks.registry import register
from larder import schemas
from larder.functions.nutrients import comparable_basis
from larder.operators import bands, peer_views, peers, phrases, scans, search, tables, views
from larder.plans.building import catalogue_peer_stats
from larder.sources.scratch import new_folder
from larder.vocab import NUTRIENT_IDS

PEER_NUTRIENTS = ["sugars_g", "fat_g", "sodium_mg"]
PEER_RULE = {
    "minimum_peers": 30, "lower_percentile": 25, "higher_percentile": 75, "nutrients": PEER_NUTRIENTS,
    "rule_id": "peers", "rule_version": "1.0.0",
}


def peer_input(spark, d):
    return peers.peer_values(table(spark, d, "panel_rows"), PEER_NUTRIENTS)


VALUES = "peer_values as (" + " union all ".join(
    f"select category_id, basis, '{n}' as nutrient, {n} as value from panel_rows where basis in ('per_100g', 'per_100ml') "
    f"and {n} is not null"
    for n in PEER_NUTRIENTS
) + ")"
STATS = (
    "stats as (select category_id, basis, nutrient, n as peer_count, min(value) filter (rn = lo) as lower_value, "
    "min(value) filter (rn = hi) as higher_value, 'peers' as rule_id, '1.0.0' as rule_version from ("
    "select *, greatest(1, least(n, ceil(25 / 100e0 * n))) as lo, greatest(1, least(n, ceil(75 / 100e0 * n))) as hi from ("
    "select *, row_number() over (partition by category_id, basis, nutrient order by value) as rn, "
    "count(*) over (partition by category_id, basis, nutrient) as n from peer_values) r) s where n >= 30 "
    "group by category_id, basis, nutrient, n)"
)


def chain(binding, steps, body):
    head = oracle("select 1 from {%s}" % binding).rsplit(f" select 1 from {binding}", 1)[0]
    return ", ".join([head, *steps]) + " " + body


register(
    "peer_groups", lambda spark, d: peers.peer_groups(peer_input(spark, d), 30),
    chain("panel_rows", [VALUES], "select category_id, basis, nutrient, count(*) as peer_count from peer_values "
          "group by all having count(*) >= 30"),
)


def peer_stats(spark, d):
    return peers.peer_stats(peer_input(spark, d), 30, 25, 75, "peers", "1.0.0")


register("peer_stats", peer_stats, chain("panel_rows", [VALUES, STATS], "select * from stats"))


def maintained(spark, d):
    """Orders as records: some are first seen with other figures, some come later, some go again."""
    rows = table(spark, d, "panel_rows").withColumnRenamed("l_orderkey", "k").drop("l_linenumber")
    early, late, gone = F.expr("k % 3 != 1"), F.expr("k % 5 = 0 or k % 3 = 1"), F.expr("k % 7 = 0")
    first = rows.where(early).withColumn("sugars_g", F.expr("sugars_g + if(k % 5 = 0, 1, 0)"))
    batches = [(first, False), (rows.where(late), False), (rows.where(gone), True)]
    log = reduce(DataFrame.unionByName, [
        b.withColumn("batch", F.lit(i).cast("long")).withColumn("deleted", F.lit(went)) for i, (b, went) in enumerate(batches)
    ])
    root = new_folder(spark, "cut_offs")
    for i in range(len(batches)):
        peer_views.update(spark, root, i, *peer_views.batch_changes(log, i, "k"), PEER_RULE, fold_every=2)
    return peer_views.cut_off_view(spark, root)


register(
    "maintained_peer_stats", maintained,
    chain("panel_rows", [VALUES.replace("is not null", "is not null and l_orderkey % 7 != 0"), STATS], "select * from stats"),
)


def panel_columns(spark, d):
    rows = table(spark, d, "panel_rows").withColumn("block_index", F.lit(0)).withColumn(
        "gtin", F.concat_ws("-", "l_orderkey", "l_linenumber")
    )
    return rows.select(
        "*", *[F.lit(None).cast("double").alias(n) for n in NUTRIENT_IDS if n not in PEER_NUTRIENTS]
    )


def compared(spark, d):
    names = table(spark, d, "part").select(
        F.lower("p_type").alias("name"), F.col("p_type").alias("id")
    ).where("p_type <> 'SMALL'").distinct()
    return peers.peer_comparison(panel_columns(spark, d), peer_stats(spark, d), names).select(
        "gtin", "nutrient", "value", "peer_count", "sentence"
    )


register(
    "peer_comparison", compared,
    chain(
        "panel_rows", [VALUES, STATS],
        "select gtin, s.nutrient, value, peer_count, concat(case s.nutrient when 'sugars_g' then 'Sugars' when 'fat_g' then "
        "'Fat' else 'Sodium' end, ': ', case when value > higher_value then 'more than most' when value < lower_value then "
        "'less than most' else 'about the same as most' end, ' of the ', peer_count, ' products in the ', "
        "lower(s.category_id), ' category that declare a figure.') as sentence from (" + " union all ".join(
            f"select concat(l_orderkey, '-', l_linenumber) as gtin, category_id, basis, '{n}' as nutrient, {n} as value from panel_rows"
            for n in PEER_NUTRIENTS
        ) + ") v join stats s on s.category_id = v.category_id "
        "and s.basis = v.basis and s.nutrient = v.nutrient where value is not null",
    ),
)

# Band rules; the food and drink sugar limits and the salt derivation are the published ones.
BANDS = [
    ("food", "per_100g", "food", "sugars_g", "Sugars", "g", None, None, 5.0, 22.5, 27.0, 100.0),
    ("food", "per_100g", "food", "fat_g", "Fat", "g", None, None, 3.0, 17.5, 21.0, 100.0),
    ("food", "per_100g", "food", "salt_g", "Salt", "g", "sodium_mg", 0.0025, 0.3, 1.5, 1.8, 100.0),
    ("drink", "per_100ml", "drink", "sugars_g", "Sugars", "g", None, None, 2.5, 11.25, 13.5, 150.0),
    ("drink", "per_100ml", "drink", "salt_g", "Salt", "g", "sodium_mg", 0.0025, 0.3, 0.75, 0.9, 150.0),
]


def band_rows(spark):
    rows = [
        (rule, "1.0.0", f"Bands for {form}", "summary", basis, form, nutrient, display, unit, reads, factor,
         "Salt is sodium times 2.5." if reads else None, low, high, portion, above,
         "Published bands", "https://example.org/bands", "table 1", "2026-01-01")
        for rule, basis, form, nutrient, display, unit, reads, factor, low, high, portion, above in BANDS
    ]
    return spark.createDataFrame(rows, schemas.BAND)


def label_panels(spark, d):
    """Label panels with their own key; the record id keeps shared gtins apart."""
    base = records(spark, d).withColumn("gtin", F.col("rid").cast("string"))
    return tables.panel_rows(base, "category").withColumnRenamed("category", "category_id")


NORMAL = """
normal as (
  select *, case when basis = 'per_serving' then 100e0 / amount else 1e0 end as factor, basis = 'per_serving' as calculated,
    case when basis = 'per_100g' or (basis = 'per_serving' and not liquid) then 'food' else 'drink' end as form,
    case when basis = 'per_serving' or (basis = 'per_100ml') = liquid then amount end as portion
  from (
    select *, cast(rid as varchar) as key, case serving_unit when 'g' then serving_value when 'ml' then serving_value
      when 'kg' then serving_value * 1000 end as amount, serving_unit = 'ml' as liquid from typed_nutrition
  ) n
  where basis in ('per_100g', 'per_100ml') or (basis = 'per_serving' and amount > 0)
)
"""
BAND_CTE = "bands as (select * from (values " + ", ".join(
    "(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::double" for v in b) + ")"
    for b in BANDS
) + ") t(rule_id, basis, form, nutrient, display, unit, reads, multiply, low, high, portion_limit, portion_above))"


def two(x):
    r = f"cast(cast({half_away(x)} as decimal(30,2)) as varchar)"
    return f"rtrim(rtrim({r}, '0'), '.')"


register(
    "normalise_basis",
    lambda spark, d: label_panels(spark, d)
    .withColumn(
        "c", comparable_basis(F.col("basis"), F.col("serving_value"), F.col("serving_unit"), F.col("serving_description"))
    )
    .where("c is not null")
    .select(
        "gtin", "block_index", F.col("c.form").alias("form"), F.col("c.factor").alias("factor"),
        F.col("c.calculated").alias("calculated"), F.col("c.serving_amount").alias("portion"),
    ),
    chain(
        "typed_nutrition", [NORMAL.strip()],
        "select key as gtin, block_index, form, factor, calculated, portion from normal",
    ),
)
register(
    "nutrient_bands",
    lambda spark, d: bands.nutrient_bands(label_panels(spark, d), band_rows(spark)).select(
        "gtin", "block_index", "rule_id", "nutrient", "value", "level", "calculated", "statement"
    ),
    chain(
        "typed_nutrition", [NORMAL.strip(), BAND_CTE],
        "select key as gtin, block_index, rule_id, nutrient, value, level, calculated, concat("
        f"{two('value')}, ' ', unit, ' per ', case form when 'drink' then '100 ml' else '100 g' end, ': ', case level "
        f"when 'Lower' then concat('at or below ', {two('low')}, ' ', unit, ', which this rule calls lower') when 'Higher' then "
        f"concat('above ', {two('high')}, ' ', unit, ', which this rule calls higher') else concat('between ', {two('low')}, "
        f"' and ', {two('high')}, ' ', unit, ', which this rule calls moderate') end, '.', case when calculated then concat("
        "' Calculated from the declared serving of ', serving_description, ', not printed on the packet.') else '' end) as "
        "statement from (select *, case when value > high then 'Higher' when portion > portion_above and value * portion / "
        "100e0 > portion_limit then 'Higher' when value <= low then 'Lower' else 'Moderate' end as level from ("
        "select n.*, b.rule_id, b.nutrient, b.unit, b.low, b.high, b.portion_limit, b.portion_above, case b.nutrient when "
        "'sugars_g' then sugars_g * factor when 'fat_g' then fat_g * factor else sodium_mg * factor * multiply end as value "
        "from normal n join bands b on b.form = n.form) v where value is not null) w",
    ),
)
register(
    "nutrient_rows",
    lambda spark, d: bands.nutrient_rows(label_panels(spark, d)).select("gtin", "block_index", "position", "nutrient", "shown"),
    chain(
        "typed_nutrition",
        [
            "cells as (" + " union all ".join(
                f"select cast(rid as varchar) as gtin, block_index, nd, '{n}' as nutrient, {n} as value, {i} as position from typed_nutrition"
                for i, n in enumerate(NUTRIENT_IDS)
            ) + ")"
        ],
        f"select gtin, block_index, position, nutrient, case when value is null then 'Unknown' else concat({two('value')}, ' ', "
        "case nutrient when 'energy_kcal' then 'kcal' when 'energy_kj' then 'kJ' when 'sodium_mg' then 'mg' else 'g' end) end "
        "as shown from cells where value is not null or (nd = 1 and nutrient in ('added_sugars_g', 'sugars_g')) or "
        "(nd = 2 and nutrient = 'trans_fat_g')",
    ),
)


def some_rules(spark, d):
    """One rule per nation; every fourth cites nothing, and every region's first is stated twice."""
    nation = table(spark, d, "nation")
    rule = nation.select(
        F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule_id"), F.lit("sugars_g").alias("nutrient"),
        F.lit("per_100g").alias("basis"), F.lit("food").alias("form"), F.col("n_name").alias("source_title"),
        F.when(F.col("n_nationkey") % 4 != 0, "https://example.org/").alias("source_url"), F.lit("p. 1").alias("source_locator"),
    )
    again = rule.join(nation.where("n_nationkey % 7 = 3").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("rule_id")), "rule_id")
    return rule.unionByName(again)


register(
    "rule_findings", lambda spark, d: bands.rule_findings(some_rules(spark, d)),
    oracle(
        "select concat('r', n_nationkey) as rule_id, 'uncited' as problem from {nation} where n_nationkey % 4 = 0 union all "
        "select concat('r', n_nationkey), 'duplicate' from {nation} where n_nationkey % 7 = 3"
    ),
)

# ------------------------------------------------------------------ phrases
# Frequent words that overlap, so that the longest phrase has to win.
WORDS = [(0, "of-the", "of the", ["the and"], ["maybe"]), (1, "the", "The", None, ["sure"]), (2, "and", "and", ["in a"], None),
         (3, "to", "to", None, ["maybe"])]


def word_list(spark):
    return spark.createDataFrame(
        WORDS, "ordinal int, id string, name string, aliases array<string>, flags array<string>"
    )


def claimed(spark, d):
    return phrases.claimed_phrases(
        table(spark, d, "documents"), word_list(spark), "doc_id", "text", definite="sure", possible="maybe"
    )


# Longest first: 'the and', 'of the', 'in a', then 'the', 'and', 'to' in dictionary order.
FOLDED = "translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüçñ', 'aaaaaaeeeeiiiiooooouuuucn')"


def alias_start(alias):
    """Word position of a phrase in a segment, from 0, or null."""
    before = f"split_part(concat(' ', seg, ' '), ' {alias} ', 1)"
    hit = f"contains(concat(' ', seg, ' '), ' {alias} ')"
    return f"case when {hit} then len({before}) - len(replace({before}, ' ', '')) end"


PHRASE_STEPS = [
    "segments as (select doc_id, i as segment, trim(regexp_replace(part, '[^a-z0-9%.]+', ' ', 'g')) as seg from ("
    f"select doc_id, unnest(parts) as part, unnest(range(1, len(parts) + 1)) as i from (select doc_id, "
    f"string_split_regex({FOLDED}, '[,;()\\[\\]{{}}•|\\n]+') as parts from documents) s) p)",
    "starts as (select doc_id, segment, " + ", ".join(
        f"{alias_start(a)} as {n}" for n, a in [("a", "the and"), ("b", "of the"), ("c", "in a"), ("e", "the"), ("f", "and"), ("g", "to")]
    ) + " from segments where seg <> '')",
    "s1 as (select *, b is not null and not coalesce(b < a + 2 and b + 2 > a, false) as b_ok from starts)",
    "s2 as (select *, c is not null and not coalesce(c < a + 2 and c + 2 > a, false) and not (b_ok and c < b + 2 and c + 2 > b) "
    "as c_ok from s1)",
    "s3 as (select *, e is not null and not coalesce(e < a + 2 and e + 1 > a, false) and not (b_ok and e < b + 2 and e + 1 > b) "
    "and not (c_ok and e < c + 2 and e + 1 > c) as e_ok from s2)",
    "s4 as (select *, g is not null as g_ok from s3)",
    "found as (select doc_id, segment, a as start, 'the and' as alias, 'of-the' as id, 'possible' as kind from s4 where a is "
    "not null union all select doc_id, segment, b, 'of the', 'of-the', 'possible' from s4 where b_ok union all "
    "select doc_id, segment, e, 'the', 'the', 'definite' from s4 where e_ok union all "
    "select doc_id, segment, g, 'to', 'to', 'possible' from s4 where g_ok)",
]


def phrase_sql(body):
    return "with " + ", ".join(PHRASE_STEPS) + " " + body


register(
    "phrase_matches",
    lambda spark, d: phrases.phrase_matches(claimed(spark, d), "doc_id").select(
        "doc_id", "segment", "start", "alias", "id", "kind"
    ),
    phrase_sql("select doc_id, segment, start, alias, id, kind from found"),
)
DETECTED = (
    "judged as (select d.doc_id, coalesce(n_sure, 0) as sure, coalesce(n_maybe, 0) as maybe, trim(d.text) = '' as blank, "
    "first_maybe, case when coalesce(n_sure, 0) > 0 then nullif(regexp_extract(trim(regexp_replace("
    + FOLDED + ", '[^a-z0-9%.]+', ' ', 'g')), 'the[^a-z0-9%]{0,3}([0-9]{1,3}(?:\\.[0-9]+)?)\\s*%', 1), '') end as pct "
    "from documents d left join (select doc_id, count(*) filter (kind = 'definite') as n_sure, count(*) filter (kind = "
    "'possible') as n_maybe, arg_min(alias, segment * 1000 - length(alias) * 10 ) filter (kind = 'possible') as first_maybe "
    "from found group by doc_id) f on f.doc_id = d.doc_id)"
)
register(
    "phrase_detection",
    lambda spark, d: phrases.detect(claimed(spark, d), "doc_id").select(
        "doc_id", "state", "definite_count", "possible_count", "reported_id", "percentage"
    ),
    "with " + ", ".join([*PHRASE_STEPS, DETECTED]) +
    " select doc_id, case when blank then 'NoIngredients' when sure > 0 and p is not null then 'ConfirmedQuantity' when sure > 0 "
    "then 'Present' when maybe > 0 then 'Unknown' else 'NotDetected' end as state, sure as definite_count, maybe as "
    "possible_count, case when sure > 0 then 'the' end as reported_id, p as percentage from (select *, case when "
    "cast(pct as double) > 0 and cast(pct as double) <= 100 then cast(pct as double) end as p from judged) j",
)
PALM = [(0, "palm-oil", "Palm oil", ["palm"], ["palm_derived"]), (1, "vegetable-oil", "Vegetable oil", ["edible vegetable oil"],
        ["may_be_palm_derived"]), (2, "palm-sugar", "Palm sugar", None, None),
        (3, "palm-kernel-oil", "Palm kernel oil", None, ["palm_derived"])]


def palm_list(spark):
    return spark.createDataFrame(PALM, "ordinal int, id string, name string, aliases array<string>, flags array<string>")


def labels(spark, d):
    return phrases.claimed_phrases(
        records(spark, d), palm_list(spark), "rid", "ingredients_raw", tree="ingredients"
    )


PALM_STATE = (
    "case when ingredients_raw is null then 'NoIngredients' when rid % 3 = 1 and tree = 1 then 'ConfirmedQuantity' else 'Present' end"
)
PALM_PCT = "case when rid % 3 = 1 and tree = 1 then cast(palm_pct as double) end"
register(
    "phrase_percentage",
    lambda spark, d: phrases.detect(labels(spark, d), "rid").select("rid", "state", "reported_id", "percentage", "statement"),
    oracle(
        "select rid, state, reported_id, percentage, case state when 'NoIngredients' then 'There is no ingredient list for "
        "this product yet.' when 'ConfirmedQuantity' then concat('Contains palm oil, declared as ', palm_pct, '% on the "
        "label.') else concat('Contains ', replace(reported_id, '-', ' '), '. The label does not say how much.') end as "
        f"statement from (select rid, palm_pct, {PALM_STATE} as state, {PALM_PCT} as percentage, case rid % 3 when 1 then "
        "'palm-oil' when 2 then 'palm-kernel-oil' end as reported_id from {label_rows}) s"
    ),
)
register(
    "alias_table",
    lambda spark, d: phrases.alias_table(
        table(spark, d, "part").select(
            F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_partkey").cast("string").alias("id"),
            F.col("p_name").alias("name"), F.array("p_brand", F.concat(F.lit("É "), "p_type")).alias("aliases"),
            F.lit(None).cast("array<string>").alias("flags"),
        )
    ).select("alias", "ordinal", "position", "id", "size"),
    oracle(
        "select alias, p_partkey as ordinal, position, cast(p_partkey as varchar) as id, length(alias) as size from ("
        "select p_partkey, unnest([replace(lower(p_brand), '#', ' '), concat('e ', lower(p_type)), p_name]) as alias, "
        "unnest([0, 1, 2]) as position from {part}) a qualify row_number() over (partition by alias order by p_partkey, "
        "position) = 1"
    ),
)

# ------------------------------------------------------------------ search
LIMIT = 20


def hits(spark, d):
    product = table(spark, d, "part_products")
    brand = table(spark, d, "brand_names")
    indexed = product.select("name", F.col("brand_id").alias("brand"), "gtin")
    found = search.search_products(product, brand, indexed, table(spark, d, "search_queries"), LIMIT)
    return found.withColumn("score", F.round("score", 6))


SEARCH_STEPS = [
    "idx as (select gtin, name, is_complete, brand_id, list_filter(string_split_regex(concat(lower(name), ' ', brand_id), "
    "'[^a-z0-9]+'), lambda x: x <> '') as words from part_products)",
    "terms as (select * from (values ('q1', 0, 'red', 2), ('q1', 1, 'wid', 2), ('q2', 0, 'ring', 1), ('q3', 0, 'b', 2), "
    "('q3', 1, 'brand', 2), ('q4', 0, 'blues', 1), ('q6', 0, 'small', 2), ('q6', 1, 'small', 2)) t(query_id, no, term, wanted))",
    "tf as (select query_id, no, term, wanted, gtin, is_complete, len(words) as len, len(list_filter(words, lambda x: "
    "starts_with(x, term))) as f from terms, idx)",
    "df as (select query_id, no, count(*) filter (f > 0) as n, count(*) as docs, avg(len) as avg_len from tf group by all)",
    "scored as (select query_id, gtin, is_complete, sum((case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + "
    "0.5) / (n + 0.5)) else 1e-6 end) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) as score from tf join df using "
    "(query_id, no) where f > 0 group by query_id, gtin, is_complete, wanted having count(*) = wanted)",
    "ranked as (select *, row_number() over (partition by query_id order by round(score, 9) desc, is_complete desc, gtin) as "
    "rank from scored)",
]
register(
    "search_products", hits,
    chain(
        "part_products", [oracle("select 1 from {brand_names}").rsplit(" select 1", 1)[0][len("with "):], *SEARCH_STEPS],
        "select query_id, rank, r.gtin, p.name, b.name as brand_name, p.is_complete, round(score, 6) as score from ranked r join "
        f"part_products p on p.gtin = r.gtin left join brand_names b on b.id = p.brand_id where rank <= {LIMIT}",
    ),
)
register(
    "search_terms",
    lambda spark, d: table(spark, d, "documents").select(
        "doc_id", F.array_join(search.search_terms(F.col("text")), " ").alias("terms")
    ),
    "select doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '[\\s\\x0b\\x{85}\\p{Z}]+'), "
    "lambda w: lower(strip_accents(regexp_replace(w, '[^\\p{L}\\p{Nd}]', '', 'g')))), lambda t: t <> ''), ' ') as terms from documents",
)

# ------------------------------------------------------------------ scans
CODED = "event_id % 7 in (0, 1, 2, 6)"


def enriched(spark, d):
    scanned = scans.enrich_scans(table(spark, d, "scan_rows"), table(spark, d, "part_products"), keep=("user_id",))
    return scans.record_scans(scanned, keep=("user_id",))


SCANS = (
    "scans as (select distinct user_id, gtin14 as gtin, scanned_at, p.gtin is not null as found, p.name from scan_rows s left "
    f"join part_products p on p.gtin = s.gtin14 where {CODED})"
)


def scan_sql(body):
    parts = oracle("select 1 from {part_products}").rsplit(" select 1", 1)[0][len("with "):]
    return chain("scan_rows", [parts, SCANS], body)


register("scan_enrichment", enriched, scan_sql("select user_id, gtin, scanned_at, found from scans"))
register(
    "miss_demand", lambda spark, d: scans.miss_demand(enriched(spark, d)),
    scan_sql("select gtin, count(*) as scans from scans where not found group by gtin"),
)
register(
    "recent_scans", lambda spark, d: scans.recent_scans(enriched(spark, d), 3, per="user_id"),
    scan_sql(
        "select user_id, gtin, scanned_at, found, position from (select user_id, gtin, scanned_at, found, row_number() over "
        "(partition by user_id order by scanned_at desc, gtin) as position from scans) r where position <= 3"
    ),
)
register(
    "scan_history_named",
    lambda spark, d: scans.scan_history_named(enriched(spark, d), table(spark, d, "part_products")).select(
        "user_id", "gtin", "scanned_at", "found", "title"
    ),
    scan_sql("select user_id, gtin, scanned_at, found, coalesce(name, gtin) as title from scans"),
)

# ------------------------------------------------------------------ product view


def keyed(spark, d):
    return records(spark, d).withColumn("gtin", F.col("rid").cast("string"))


def view(spark, d):
    base = keyed(spark, d)
    stats = catalogue_peer_stats(base, PEER_RULE)
    whole = views.product_view(
        base, table(spark, d, "brand_names"), table(spark, d, "category_names"), band_rows(spark), stats,
        palm_list(spark), TODAY,
    )
    return whole.select(
        "gtin", "name", "brand_name", "description", "verification", "sources", "freshness", "is_complete",
        "needs_discovery", F.col("state").alias("phrase_state"), F.coalesce(F.size("indicators"), F.lit(0)).alias("indicators"),
        F.array_join(
            F.transform(
                "panels",
                lambda p: F.concat(
                    p["basis_label"], F.lit(" ["),
                    F.array_join(F.transform(p["rows"], lambda r: F.concat(r["nutrient"], F.lit("="), r["shown"])), ";"), F.lit("]"),
                ),
            ),
            " ",
        ).alias("panels"),
        F.array_join(F.transform("peers", lambda p: p["sentence"]), " ").alias("peers"),
    )


def one(x):
    return f"rtrim(rtrim(cast(round(cast({x} as decimal(30,10)), 1) as decimal(30,1))::varchar, '0'), '.')"


LABEL_VALUES = "peer_values as (" + " union all ".join(
    f"select category as category_id, basis, '{n}' as nutrient, {n} as value from typed_nutrition where category is not null "
    f"and basis in ('per_100g', 'per_100ml') and {n} is not null"
    for n in PEER_NUTRIENTS
) + ")"
register(
    "product_view", view,
    chain(
        "typed_nutrition",
        [
            *[oracle("select 1 from {%s}" % n).rsplit(" select 1", 1)[0][len("with "):] for n in ("brand_names", "category_names")],
            NORMAL.strip(), BAND_CTE,
            "levels as (select key, count(*) as n from normal n join bands b on b.form = n.form where case b.nutrient when "
            "'sugars_g' then sugars_g when 'fat_g' then fat_g else sodium_mg end is not null group by key)",
            "dated as (select *, try_cast(last_verified as date) as day from label_rows)",
            "cells as (" + " union all ".join(
                f"select rid, block_index, nd, '{n}' as nutrient, {n} as value, {i} as position from typed_nutrition"
                for i, n in enumerate(NUTRIENT_IDS)
            ) + ")",
            f"shown as (select rid, block_index, string_agg(concat(nutrient, '=', case when value is null then 'Unknown' else "
            f"concat({two('value')}, ' ', case nutrient when 'energy_kcal' then 'kcal' when 'energy_kj' then 'kJ' when "
            "'sodium_mg' then 'mg' else 'g' end) end), ';' order by position) as figures from cells where value is not null or "
            "(nd = 1 and nutrient in ('added_sugars_g', 'sugars_g')) or (nd = 2 and nutrient = 'trans_fat_g') group by all)",
            "panel_texts as (select rid, string_agg(concat(case basis when 'per_100g' then 'Per 100 g' when 'per_100ml' then "
            "'Per 100 ml' when 'per_serving' then 'Per serving' else 'Per package' end, ' [', coalesce(figures, ''), ']'), ' ' "
            "order by block_index) as panels from typed_nutrition left join shown using (rid, block_index) group by rid)",
            LABEL_VALUES, STATS,
            "compared as (select c.rid, string_agg(concat(case c.nutrient when 'sugars_g' then 'Sugars' when 'fat_g' then 'Fat' "
            "else 'Sodium' end, ': ', case when value > higher_value then 'more than most' when value < lower_value then 'less "
            "than most' else 'about the same as most' end, ' of the ', peer_count, ' products in the ', lower(coalesce(g.name, "
            "s.category_id)), ' category that declare a figure.'), ' ' order by c.block_index, c.nutrient) as peers from cells c "
            "join typed_nutrition t on t.rid = c.rid and t.block_index = c.block_index join stats s on s.category_id = "
            "t.category and s.basis = t.basis and s.nutrient = c.nutrient left join category_names g on g.id = s.category_id "
            "where value is not null group by c.rid)",
        ],
        "select cast(r.rid as varchar) as gtin, r.name, coalesce(b.name, brand) as brand_name, concat_ws(' · ', "
        f"coalesce(b.name, brand), case when package_value is not null then trim(concat({one('package_value')}, ' ', case when "
        "package_unit = 'piece' then '' else package_unit end)) end) as description, case status when 'verified' then "
        "'Verified against packaging by a contributor.' when 'disputed' then 'Sources disagree about this product, so treat it "
        "with care.' else 'Community data, not independently verified. Trust the packet over this app.' end as verification, "
        "case when r.rid % 5 = 1 then concat('• Photograph of the packet, retrieved 2026-01-01', chr(10), '• Photograph of the "
        "packet, retrieved 2026-01-01') else '• Photograph of the packet, retrieved 2026-01-01' end as sources, "
        "case when day is null then 'Unknown' when m < 6 then 'Current' when m < 12 then 'ReviewRecommended' else "
        "'PossiblyOutdated' end as freshness, basis0 is not null or ingredients_raw is not null as is_complete, "
        "not (basis0 is not null or ingredients_raw is not null) as needs_discovery, "
        f"{PALM_STATE.replace('rid', 'r.rid')} as phrase_state, coalesce(l.n, 0) as indicators, v.panels, w.peers from (select *, (2026 - "
        "year(day)) * 12 + 6 - month(day) - case when 15 < day(day) then 1 else 0 end as m from dated) r "
        "left join brand_names b on b.id = r.brand left join levels l on l.key = cast(r.rid as varchar) "
        "left join panel_texts v on v.rid = r.rid left join compared w on w.rid = r.rid",
    ),
)


def catalogue_flagship(spark, d):
    """Peer cut-offs of the imported products: scan, map, dedup, unpivot, aggregate and window."""
    from checks.imports import products

    return catalogue_peer_stats(products(spark, d), {**PEER_RULE, "minimum_peers": 5})


IMPORTED = "peer_values as (" + " union all ".join(
    f"select category as category_id, basis, '{n}' as nutrient, {n} as value from products where category is not null "
    f"and basis in ('per_100g', 'per_100ml') and {n} is not null"
    for n in PEER_NUTRIENTS
) + ")"
register(
    "imported_peer_stats", catalogue_flagship,
    with_raw("select * from stats", IMPORTED, STATS.replace("n >= 30", "n >= 5")),
)
