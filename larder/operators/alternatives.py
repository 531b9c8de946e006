"""Better products of the same shelf: an exact skyline per neighbourhood, then the first few with reasons.

A neighbourhood is a category with its substitutes, on one panel basis (and, where asked for,
in one country or other shelf).  A product beats another when it is at least as good in every
nutrient that matters there and better in one.  The skyline is what nothing beats.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.functions.nutrients import display_name, unit_of
from larder.functions.numbers import show_two
from larder.operators.sizes import broadcast_if_small, written
from larder.vocab import NUTRIENT_IDS

# Of these more is better; of all others less.
MORE = ("protein_g", "fibre_g")
PART_POINTS = 2048
SHRINKS = 0.75


def neighbourhoods(categories, substitutes):
    """category_id, member_id: a category itself and each of its substitutes, once.

    categories: id; substitutes: category_id, substitute_id.
    """
    own = categories.select(F.col("id").alias("category_id"), F.col("id").alias("member_id"))
    return own.union(substitutes.select("category_id", "substitute_id")).where(
        F.col("category_id").isNotNull() & F.col("member_id").isNotNull()
    ).distinct()


def _figures(row, more):
    """The row's figures of its `relevant` nutrients in their order, turned so that less is better."""
    value = F.create_map(*[x for n in NUTRIENT_IDS for x in (F.lit(n), row[n])])
    return F.transform(row["relevant"], lambda n: F.when(n.isin(*more), -value[n]).otherwise(value[n]) + F.lit(0.0))


def points(panels, near, relevant, within=(), more=MORE):
    """(wanted, offered): figures of each product where it may be replaced, and where it may replace.

    panels: gtin, category_id, basis, a column per nutrient, and the columns of `within`.
    relevant: category_id, field.  Only panels per 100 g or 100 ml compare.  A product is
    offered where it declares every relevant nutrient; it is wanted for in its own category
    where it declares one.  Categories without relevant nutrients have no neighbourhood.
    """
    fields = relevant.where(F.col("field").isin(*NUTRIENT_IDS)).groupBy("category_id").agg(
        F.sort_array(F.collect_set("field")).alias("relevant")
    )
    usable = panels.where(F.col("basis").isin("per_100g", "per_100ml") & F.col("category_id").isNotNull())
    usable = usable.select("gtin", "category_id", "basis", *within, *NUTRIENT_IDS)
    keep = ["gtin", "category_id", "basis", *within, "relevant", "v"]
    with_v = lambda rows: rows.withColumn("v", _figures(rows, more)).select(*keep)
    fields = broadcast_if_small(written(fields))
    wanted = with_v(usable.join(fields, "category_id")).where(F.exists("v", lambda x: x.isNotNull()))
    places = near.join(fields, "category_id")
    members = usable.withColumnRenamed("category_id", "member_id").join(
        broadcast_if_small(written(places)), "member_id"
    )
    offered = with_v(members).where(F.forall("v", lambda x: x.isNotNull()))
    return wanted, offered


def beats(a, b):
    """Array a is nowhere above b and somewhere below; places where b has nothing do not count."""
    no_worse = F.zip_with(a, b, lambda x, y: y.isNull() | (x <= y))
    some_better = F.zip_with(a, b, lambda x, y: F.coalesce(x < y, F.lit(False)))
    return F.forall(no_worse, lambda x: x) & F.exists(some_better, lambda x: x)


def _local(rows, keys):
    """Of each group of keys the points that no other point of the group beats.

    Points come by rising sum, and what beats a point has a smaller sum, so one pass against
    the points kept so far is enough.
    """
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    inorder = F.sort_array(F.collect_list(F.struct(total.alias("total"), "v")))
    none = F.array().cast("array<array<double>>")
    kept = F.aggregate(
        "points", none,
        lambda acc, p: F.when(F.exists(acc, lambda a: beats(a, p["v"])), acc).otherwise(F.array_append(acc, p["v"])),
    )
    return rows.groupBy(*keys).agg(inorder.alias("points")).select(*keys, F.explode(kept).alias("v"))


def skyline(rows, group, part_points=PART_POINTS):
    """The distinct points `v` of each group that no point of the group beats.

    Equal points count once.  A group is cut by hash into parts of about part_points, each
    part gives its own skyline, and what is left is cut again, so a hot group is many tasks.
    Once the parts no longer shrink, every point left is held against each part's skyline.
    """
    left = written(rows.select(*group, "v").distinct())
    before = None
    while True:
        sizes = left.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        parts = F.ceil(F.col("_n") / F.lit(part_points)).cast("int")
        sizes = written(sizes.select(*[F.col(c).alias(f"_{c}") for c in group], "_n", parts.alias("_parts")))
        most, total = sizes.agg(F.max("_parts"), F.sum("_n")).first()
        if total is None:
            return left
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
        on = same[0]
        for c in same[1:]:
            on = on & c
        salted = left.join(broadcast_if_small(sizes), on).withColumn(
            "_part", F.pmod(F.xxhash64("v"), F.col("_parts")).cast("int")
        )
        if before is not None and total > SHRINKS * before:
            break
        left, before = written(_local(salted, [*group, "_part"])), total
        if most == 1:
            return left.drop("_part")
        left = left.drop("_part")
    cut = salted.select(*group, "_part", "v")
    blocks = cut.groupBy(*[F.col(c).alias(f"_{c}") for c in group], "_part").agg(F.collect_list("v").alias("_block"))
    beaten = F.exists("_block", lambda a: beats(a, F.col("v")))
    return (
        cut.drop("_part").join(blocks, on)
        .groupBy(*group, "v").agg(F.max(beaten).alias("_beaten")).where(~F.col("_beaten")).select(*group, "v")
    )


def alternatives(panels, near, relevant, within=(), blocked=None, curated=None, most=3, more=MORE):
    """gtin, rank, alternative, better, improvement, reasons: up to `most` better products for each.

    A suggestion stands on the skyline of the product's neighbourhood and beats the product in
    the figures that both declare.  Those better in more nutrients come first, then those with
    the larger sum of whole per cents of improvement, then by gtin.  better lists the nutrients
    that improve, reasons says by how much; there is no other kind of reason.  A product that
    nothing beats has no rows.

    blocked: gtin, blocked: pairs never suggested.  curated: gtin, alternative, reasons: they
    come first, by gtin, unless blocked.  Rows of a gtin repeated in a neighbourhood each look
    for better ones; ties between them are one suggestion.
    """
    group = ["category_id", "basis", *within]
    wanted, offered = points(panels, near, relevant, within, more)
    offered = written(offered.select("gtin", *group, "v").distinct())
    top = written(skyline(offered, group))
    # Of products with the same figures the first few are enough, unless pairs are blocked.
    same = Window.partitionBy(*group, "v").orderBy("gtin")
    front = offered.join(broadcast_if_small(top), [*group, "v"]).withColumn("_nth", F.row_number().over(same))
    front = front.select(*group, F.col("gtin").alias("alternative"), F.col("v").alias("_offer"), "_nth")
    if blocked is not None:
        blocked = written(blocked.select("gtin", "blocked").where("gtin is not null and blocked is not null").distinct())
        owners = blocked.select("gtin", F.col("gtin").alias("_owner")).distinct()
        wanted = wanted.join(broadcast_if_small(owners), "gtin", "left")
    else:
        wanted = wanted.withColumn("_owner", F.lit(None).cast("string"))
        front = front.where(F.col("_nth") <= most)
    front = written(front)
    # Products with equal figures are looked up once; one with blocked pairs is looked up for itself.
    wanted = written(wanted)
    asked = wanted.select(*group, "relevant", "v", "_owner").distinct().join(broadcast_if_small(front), group)
    asked = asked.where((F.col("_owner").isNotNull() | (F.col("_nth") <= most)) & beats(F.col("_offer"), F.col("v")))
    if blocked is not None:
        named = broadcast_if_small(blocked.select(F.col("gtin").alias("_owner"), F.col("blocked").alias("alternative")))
        asked = asked.join(named, ["_owner", "alternative"], "left_anti")
    gains = F.filter(F.transform("relevant", _gain), lambda g: g["gain"].isNotNull())
    scored = asked.withColumn("_gains", gains).withColumn(
        "improvement", F.aggregate("_gains", F.lit(0).cast("long"), lambda s, g: s + g["gain"])
    )
    order = [F.size("_gains").desc(), F.desc("improvement"), "alternative"]
    one = Window.partitionBy(*group, "v", "_owner").orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(one)).where(F.col("rank") <= most)
    first = first.select(
        *group, "v", "_owner", "rank", "alternative", "improvement",
        F.transform("_gains", lambda g: g["nutrient"]).alias("better"), _reasons(more).alias("reasons"),
    )
    keys = [*group, "v", "_owner"]
    renamed = first.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "rank", "alternative", "better", "improvement", "reasons")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    found = wanted.join(renamed, on).select("gtin", "rank", "alternative", "better", "improvement", "reasons")
    # A gtin with rows on several shelves keeps the best of them.
    again = Window.partitionBy("gtin", "alternative").orderBy(F.size("better").desc(), F.desc("improvement"))
    found = found.withColumn("_n", F.row_number().over(again)).where("_n = 1").drop("_n", "rank")
    found = found.withColumn("_given", F.lit(0))
    if curated is not None:
        given = curated.select(
            "gtin", "alternative", F.array().cast("array<string>").alias("better"),
            F.lit(None).cast("long").alias("improvement"), F.col("reasons").cast("array<string>").alias("reasons"),
            F.lit(1).alias("_given"),
        ).where("gtin is not null and alternative is not null").dropDuplicates(["gtin", "alternative"])
        if blocked is not None:
            given = given.join(blocked.withColumnRenamed("blocked", "alternative"), ["gtin", "alternative"], "left_anti")
        found = found.join(given.select("gtin", "alternative"), ["gtin", "alternative"], "left_anti").unionByName(given)
    last = Window.partitionBy("gtin").orderBy(F.desc("_given"), F.size("better").desc(), F.desc("improvement"), "alternative")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= most).select(
        "gtin", "rank", "alternative", "better", "improvement", "reasons"
    )


def _gain(nutrient, i):
    """What an offered point gains in the i-th nutrient: whole per cents, null where it gains nothing."""
    own, other = F.get("v", i), F.get("_offer", i)
    share = F.when(own == 0, F.lit(100)).otherwise(F.floor(F.lit(100.0) * (own - other) / F.abs(own)))
    return F.struct(
        nutrient.alias("nutrient"), F.abs(own).alias("own"), F.abs(other).alias("other"),
        F.when(other < own, share).cast("long").alias("gain"),
    )


def _reasons(more):
    per = F.when(F.col("basis") == "per_100ml", "100 ml").otherwise("100 g")
    return F.transform(
        "_gains",
        lambda g: F.format_string(
            "%s %s: %s %s against %s %s per %s",
            F.when(g["nutrient"].isin(*more), "More").otherwise("Less"), F.lower(display_name(g["nutrient"])),
            show_two(g["other"]), unit_of(g["nutrient"]), show_two(g["own"]), unit_of(g["nutrient"]), per,
        ),
    )
