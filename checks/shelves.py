"""Alternatives, category limits, dictionary coverage and the choice between conflicting values."""

import re

from pyspark.sql import functions as F

from checks.bindings import NAME, names_in, oracle, table
from checks.registry import register
from larder.operators import alternatives, conflicts, coverage, limits
from larder.vocab import NUTRIENT_IDS

WITHIN = ("country",)


def chained(body, *steps, recursive=False):
    """DuckDB text: the bindings that the steps and the body name, then the steps, then the body."""
    names = dict.fromkeys(n for text in (*steps, body) for n in names_in(text))
    head = oracle("select 1 from " + ", ".join("{%s}" % n for n in names))
    head = head[: head.rindex("select 1 from ")].strip()
    plain = [re.sub(NAME, r"\1", text) for text in (*steps, body)]
    start = f"{head}, " if head else "with "
    text = start + ", ".join(plain[:-1]) + " " + plain[-1]
    return text.replace("with ", "with recursive ", 1) if recursive else text


def shelf_inputs(spark, d):
    rows = table(spark, d, "shelf_rows")
    none = {n: F.lit(None).cast("double") for n in NUTRIENT_IDS if n not in rows.columns}
    part = table(spark, d, "part").select(F.col("p_type").alias("id")).distinct()
    near = alternatives.neighbourhoods(part, table(spark, d, "shelf_substitutes"))
    return rows.withColumns(none), near, table(spark, d, "shelf_nutrients")


def front(spark, d):
    _, offered = alternatives.points(*shelf_inputs(spark, d), WITHIN)
    group = ["category_id", "basis", *WITHIN]
    found = alternatives.skyline(offered, group)
    same = offered.join(found, [*group, "v"])
    return same.groupBy("category_id", "basis", "country").agg(
        F.countDistinct("v").alias("points"), F.count(F.lit(1)).alias("products"), F.min("gtin").alias("first_gtin")
    )


# The figures of each category's nutrients, by name, turned so that less is better.
VECTOR = (
    "case {c} when 'STANDARD' then [fat_g, sugars_g] when 'SMALL' then [sugars_g] when 'MEDIUM' then [sodium_mg, sugars_g] "
    "else [fat_g, -fibre_g + 0e0, sugars_g] end"
)
NAMES = (
    "case {c} when 'STANDARD' then ['fat_g', 'sugars_g'] when 'SMALL' then ['sugars_g'] when 'MEDIUM' then "
    "['sodium_mg', 'sugars_g'] else ['fat_g', 'fibre_g', 'sugars_g'] end"
)
BEATS = (
    "(list_bool_and(list_transform({a}, lambda x, i: {b}[i] is null or x <= {b}[i])) and "
    "list_bool_or(list_transform({a}, lambda x, i: coalesce(x < {b}[i], false))))"
)
FRONT = [
    "near as (select distinct p_type as category_id, p_type as member_id from {part} union select * from {shelf_substitutes})",
    "offered as (select gtin, n.category_id, basis, country, " + VECTOR.format(c="n.category_id") + " as v from {shelf_rows} s "
    "join near n on s.category_id = n.member_id where basis <> 'per_serving' and n.category_id <> 'LARGE' and "
    "sugars_g is not null)",
    "spots as (select distinct category_id, basis, country, v from offered)",
    "top as (select * from spots q where not exists (select 1 from spots p where p.category_id = q.category_id and p.basis = "
    "q.basis and p.country = q.country and " + BEATS.format(a="p.v", b="q.v") + "))",
    "front as (select o.* from offered o join top using (category_id, basis, country, v))",
]
register(
    "alternative_front", front,
    chained(
        "select category_id, basis, country, count(distinct v) as points, count(*) as products, min(gtin) as first_gtin "
        "from front group by all",
        *FRONT,
    ),
)


def suggested(spark, d):
    found = alternatives.alternatives(*shelf_inputs(spark, d), WITHIN)
    return found.withColumn("better", F.array_join("better", ",")).drop("reasons")


register(
    "alternatives", suggested,
    chained(
        "select gtin, rank::int as rank, alternative, array_to_string(better, ',') as better, improvement from ("
        "select *, row_number() over (partition by gtin order by len(better) desc, improvement desc, alternative) as rank from ("
        "select gtin, alternative, list_filter(list_transform(n, lambda x, i: case when a[i] < v[i] then x end), lambda x: x is not "
        "null) as better, list_sum(list_transform(v, lambda x, i: case when a[i] < x then case when x = 0 then 100 else "
        "floor(100e0 * (x - a[i]) / abs(x)) end else 0 end))::bigint as improvement from pairs) p) r where rank <= 3",
        *FRONT,
        "wanted as (select gtin, category_id, basis, country, " + VECTOR.format(c="category_id") + " as v, "
        + NAMES.format(c="category_id") + " as n from {shelf_rows} where basis <> 'per_serving' and category_id <> 'LARGE' and "
        "(category_id <> 'SMALL' or sugars_g is not null))",
        "firsts as (select * from (select *, row_number() over (partition by category_id, basis, country, v order by gtin) as nth "
        "from front) f where nth <= 3)",
        "pairs as (select w.*, f.gtin as alternative, f.v as a from wanted w join firsts f using (category_id, basis, country) "
        "where " + BEATS.format(a="f.v", b="w.v") + ")",
    ),
)

# ------------------------------------------------------------------ limits


def tree(spark, d):
    return table(spark, d, "category_tree"), table(spark, d, "tree_limits")


WAYS = (
    "way(category_id, place, step, total) as (select id, id, 0, (select count(*) from {{category_tree}}) from category_tree union all "
    "select w.category_id, t.parent_id, step + 1, total from way w join category_tree t on t.id = w.place join category_tree p on "
    "p.id = t.parent_id where step <= total and {stop})"
)
MARKED = "marked as (select distinct category_id as id from {tree_limits})"
NEAREST = "nearest as (select category_id, place as nearest_id from way where place in (select id from marked))"


def recursive(body, *steps):
    return chained(body, *steps, recursive=True)


register(
    "nearest_limits", lambda spark, d: limits.nearest_ancestor(*tree(spark, d)),
    recursive(
        "select c.id as category_id, nearest_id, c.id in (select category_id from walk where step > total) as in_cycle "
        "from category_tree c left join nearest n on n.category_id = c.id",
        MARKED, WAYS.format(stop="w.place not in (select id from marked)"),
        WAYS.format(stop="true").replace("way(", "walk(", 1).replace("from way ", "from walk "), NEAREST,
    ),
)


def limited(spark, d):
    panels = table(spark, d, "tree_panels")
    more = {n: F.lit(None).cast("double") for n in NUTRIENT_IDS if n not in panels.columns}
    panels = panels.withColumns({**more, "block_index": F.lit(0), "serving_description": F.lit(None).cast("string")})
    found = limits.category_limits(panels, *tree(spark, d))
    return found.select("gtin", "category_id", "limit_category", "nutrient", "value", "exceeds")


register(
    "category_limits", limited,
    recursive(
        "select gtin, p.category_id, nearest_id as limit_category, nutrient, value, value > above as exceeds from ("
        "select p.*, l.nearest_id, r.nutrient, r.above, case when r.nutrient = 'sugars_g' then sugars_g * factor else sodium_mg * "
        "factor * multiply_by end as value from (select *, case basis when 'per_serving' then 100e0 / serving_value else 1e0 end as "
        "factor from {tree_panels}) p join nearest l on l.category_id = p.category_id join tree_limits r on r.category_id = "
        "l.nearest_id) p where value is not null",
        MARKED, WAYS.format(stop="w.place not in (select id from marked)"), NEAREST,
    ),
)

# ------------------------------------------------------------------ coverage
KNOWN = ["the", "and", "to", "of", "that"]


def covered(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term"))
    aliases = table(spark, d, "documents").select(F.explode(F.array(*[F.lit(w) for w in KNOWN])).alias("alias"))
    return coverage.term_coverage(coverage.term_counts(words), aliases)


COVERED = (
    "select *, row_number() over (order by mentions desc, term) as place, (sum(mentions) over (order by mentions desc, term rows "
    "unbounded preceding))::bigint as covered, (sum(mentions) over ())::bigint as total, term in ("
    + ", ".join(f"'{w}'" for w in KNOWN) + ") as known from (select term, count(*) as mentions from (select "
    "unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents) w where term <> '' group by term) c"
)
register("term_coverage", covered, COVERED)
register(
    "coverage_marks", lambda spark, d: coverage.coverage_marks(covered(spark, d), [53, 63, 70]),
    f"select share, min(place) as terms from ({COVERED}) c, (select unnest([53, 63, 70])::int as share) s "
    "where covered * 100 >= share * total group by share",
)
register(
    "dictionary_share", lambda spark, d: coverage.dictionary_share(covered(spark, d)),
    "select count(*) as terms, sum(mentions)::bigint as mentions, count(*) filter (known) as known_terms, "
    f"(sum(mentions) filter (known))::bigint as known_mentions from ({COVERED}) c",
)

# ------------------------------------------------------------------ conflicts
CLAIMS = [
    "votes as (select key, path, value, source, max(case type when 'packaging' then 6 when 'manufacturer' then 5 when 'regulator' "
    "then 4 when 'open_database' then 3 when 'retailer' then 2 when 'community' then 1 else 0 end) as rank from {claim_rows} "
    "where value is not null group by key, path, value, source)",
    "w0 as (select source, floor(1000 * max(rank) / 6e0)::bigint as prior, floor(1000 * max(rank) / 6e0)::bigint as weight "
    "from votes group by source)",
]


def judged_by(weights, name):
    return (
        f"{name} as (select *, row_number() over (partition by key, path order by support desc, rank desc, value) = 1 as chosen, "
        "count(*) over (partition by key, path) as n from (select key, path, value, sum(weight)::bigint as support, max(rank) as "
        f"rank, count(*) as n_sources from votes join {weights} using (source) group by key, path, value) s)"
    )


def weighed_by(values, before, name):
    return (
        f"{name} as (select source, prior, floor((10 * prior + 1000 * coalesce(agreed, 0)) / (10e0 + coalesce(n, 0)))::bigint as "
        f"weight from {before} left join (select source, count(*) as n, count(*) filter (chosen) as agreed from votes join "
        f"{values} using (key, path, value) where n > 1 group by source) r using (source))"
    )


TWO_ROUNDS = [
    *CLAIMS, judged_by("w0", "v0"), weighed_by("v0", "w0", "w1"), judged_by("w1", "v1"), weighed_by("v1", "w1", "w2"),
    judged_by("w2", "v2"),
]
register(
    "conflict_choice", lambda spark, d: conflicts.resolve(table(spark, d, "claim_rows"), rounds=2, settled=-1),
    chained(
        "select key, path, value, support, rank, n_sources, chosen, case when n = 1 then 'agreed' when max(support) over i > "
        "max(case when not chosen then support end) over i then 'chosen' else 'unresolved' end as resolution from v2 "
        "window i as (partition by key, path)", *TWO_ROUNDS,
    ),
)
