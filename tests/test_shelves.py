"""Alternatives, category limits, coverage and conflict choice against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larder.operators import alternatives, conflicts, coverage, limits, sizes
from larder.vocab import NUTRIENT_IDS

PANELS = "gtin string, category_id string, basis string, country string, " + ", ".join(f"{n} double" for n in NUTRIENT_IDS)


def panel(gtin, category, basis="per_100g", country="IN", **values):
    return (gtin, category, basis, country, *[values.get(n) for n in NUTRIENT_IDS])


def beats(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if y is not None]
    return all(x <= y for x, y in pairs) and any(x < y for x, y in pairs)


@pytest.mark.parametrize("part_points", [3, 20, 5000])
def test_skyline_is_exact_however_it_is_cut(spark, part_points):
    draw = random.Random(part_points)
    rows = [("hot", [float(draw.randrange(30)) for _ in range(3)]) for _ in range(300)]
    # Points of which none beats another, so that parts do not shrink.
    rows += [("flat", [float(i), float(60 - i)]) for i in range(60)] + [("one", [1.0]), ("one", [1.0]), (None, [2.0])]
    found = alternatives.skyline(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], part_points)
    groups = defaultdict(set)
    for g, v in rows:
        groups[g].add(tuple(v))
    want = {(g, p) for g, points in groups.items() for p in points if not any(beats(q, p) for q in points)}
    assert sorted((str(r.g), tuple(r.v)) for r in found.collect()) == sorted((str(g), p) for g, p in want)


def test_skyline_of_nothing(spark):
    assert alternatives.skyline(spark.createDataFrame([], "g string, v array<double>"), ["g"]).collect() == []


def slow_alternatives(panels, near, relevant, blocked, most):
    by = [dict(zip(("gtin", "category_id", "basis", "country", *NUTRIENT_IDS), p)) for p in panels]

    def figures(p, category):
        return [-p[n] if p[n] is not None and n in alternatives.MORE else p[n] for n in sorted(relevant[category])]

    out = []
    for t in by:
        c = t["category_id"]
        if c not in relevant or t["basis"] not in ("per_100g", "per_100ml") or all(x is None for x in figures(t, c)):
            continue
        own = figures(t, c)
        offered = {
            (p["gtin"], tuple(figures(p, c))) for p in by
            if p["category_id"] in near[c] and p["basis"] == t["basis"] and p["country"] == t["country"]
            and None not in figures(p, c)
        }
        scored = []
        for g, v in offered:
            if beats(v, own) and not any(beats(w, v) for _, w in offered) and (t["gtin"], g) not in blocked:
                gains = [100 if x == 0 else (100.0 * (x - y)) // abs(x) for x, y in zip(own, v) if x is not None and y < x]
                better = [n for n, x, y in zip(sorted(relevant[c]), own, v) if x is not None and y < x]
                scored.append((-len(better), -int(sum(gains)), g, better))
        for i, (_, gain, g, better) in enumerate(sorted(scored)[:most]):
            out.append((t["gtin"], i + 1, g, better, -gain))
    return sorted(out)


def test_alternatives_match_brute_force(spark):
    draw = random.Random(7)
    some = lambda top: None if draw.random() < 0.1 else float(draw.randrange(top))
    panels = [
        panel(f"{i:04d}", draw.choice(["a", "b", "c", "d", None]), draw.choice(["per_100g", "per_100ml", "per_serving"]),
              draw.choice(["IN", "FR"]), sugars_g=some(12), fibre_g=some(6), fat_g=some(9))
        for i in range(400)
    ]
    near = {"a": {"a", "b"}, "b": {"b"}, "c": {"c", "ghost"}}
    relevant = {"a": ["sugars_g", "fibre_g"], "b": ["sugars_g", "fat_g", "fibre_g"], "c": ["fat_g"]}
    plain = slow_alternatives(panels, near, relevant, set(), 3)
    blocked = {(r[0], r[2]) for r in plain if int(r[0]) % 3 == 0 and r[1] < 3}
    subs = spark.createDataFrame([("a", "b"), ("c", "ghost"), ("a", "b")], "category_id string, substitute_id string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    fields = [(c, n) for c, names in relevant.items() for n in names] + [("a", "sugars_g"), ("d", "unheard_of")]
    fields = spark.createDataFrame(fields, "category_id string, field string")
    table = spark.createDataFrame(panels, PANELS)
    places = alternatives.neighbourhoods(ids, subs)

    def run(**more):
        found = alternatives.alternatives(table, places, fields, ("country",), **more).collect()
        return sorted((r.gtin, r["rank"], r.alternative, r.better, r.improvement) for r in found)

    assert plain and run() == plain
    pairs = spark.createDataFrame(sorted(blocked), "gtin string, blocked string")
    assert blocked and run(blocked=pairs) == slow_alternatives(panels, near, relevant, blocked, 3)


def test_reasons_and_curated_suggestions(spark):
    panels = spark.createDataFrame(
        [panel("1", "a", sugars_g=20.0, fibre_g=2.0), panel("2", "a", sugars_g=5.5, fibre_g=4.0), panel("3", "a", sugars_g=5.5, fibre_g=4.0)],
        PANELS,
    )
    near = alternatives.neighbourhoods(
        spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "category_id string, substitute_id string")
    )
    fields = spark.createDataFrame([("a", "sugars_g"), ("a", "fibre_g")], "category_id string, field string")
    curated = spark.createDataFrame(
        [("1", "9", ["No palm oil"]), ("1", "3", ["Same maker"]), ("2", "8", ["Larger packet"])],
        "gtin string, alternative string, reasons array<string>",
    )
    blocked = spark.createDataFrame([("2", "8")], "gtin string, blocked string")
    found = alternatives.alternatives(panels, near, fields, curated=curated, blocked=blocked).orderBy("gtin", "rank").collect()
    assert [(r.gtin, r["rank"], r.alternative) for r in found] == [("1", 1, "3"), ("1", 2, "9"), ("1", 3, "2")]
    assert found[2].reasons == ["More fibre: 4 g against 2 g per 100 g", "Less sugars: 5.5 g against 20 g per 100 g"]
    assert found[0].reasons == ["Same maker"] and found[0].improvement is None


def nearest(parents, marked, at):
    """(nearest, in_cycle) by walking up."""
    seen, found, node = set(), None, at
    while node in parents and node not in seen:
        seen.add(node)
        if found is None and node in marked:
            found = node
        node = parents[node]
    return found, node in seen


def test_limits_along_deep_ways_and_circles(spark):
    parents = {f"deep{i}": f"deep{i - 1}" if i else None for i in range(41)}
    parents |= {f"ring{i}": f"ring{(i + 1) % 7}" for i in range(7)} | {"tail": "ring3", "self": "self", "lost": "ghost", "top": None}
    parents |= {f"t{i}": f"t{i // 3}" if i else "deep20" for i in range(200)}
    marked = {"deep0", "deep13", "ring5", "t4", "nowhere"}
    tree = spark.createDataFrame(list(parents.items()), "id string, parent_id string")
    limited = spark.createDataFrame([(m,) for m in marked], "category_id string")
    found = {r.category_id: (r.nearest_id, r.in_cycle) for r in limits.nearest_ancestor(tree, limited).collect()}
    assert found == {c: nearest(parents, marked, c) for c in parents}
    assert limits.nearest_ancestor(tree.limit(0), limited).collect() == []


def test_no_round_up_the_tree_broadcasts_the_categories(spark, monkeypatch):
    plans, written = [], limits.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(limits, "written", noted)
    tree = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)], "id string, parent_id string")
    limits.nearest_ancestor(tree, spark.createDataFrame([("c0",)], "category_id string")).collect()
    assert len(plans) > 5
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_rules_beyond_the_bound_are_not_broadcast_however_small_their_files(spark, monkeypatch):
    plans, bound = [], sizes.broadcast_if_small
    monkeypatch.setattr(limits, "broadcast_if_small", lambda df: bound(df, 100))
    written = limits.written
    monkeypatch.setattr(limits, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    tree = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)], "id string, parent_id string")
    rules = spark.createDataFrame(
        [(f"c{i}", "Sweets", "sugars_g", "Sugars", "g", None, None, 10.0) for i in range(20)],
        "category_id string, source_category string, nutrient string, display string, unit string, derived_from string, multiply_by double, above double",
    )
    columns = "gtin string, block_index int, category_id string, basis string, serving_value double, serving_unit string, serving_description string"
    columns += ", " + ", ".join(f"{n} double" for n in NUTRIENT_IDS)
    row = lambda i: (str(i), 0, f"c{i}", "per_100g", None, None, None, *[11.0 if n == "sugars_g" else None for n in NUTRIENT_IDS])
    found = limits.category_limits(spark.createDataFrame([row(i) for i in range(50)], columns), tree, rules)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r.gtin, r.limit_category) for r in found.collect()} == {(str(i), f"c{min(i, 19)}") for i in range(40)}
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_a_limit_is_exceeded_only_above_it(spark):
    columns = "gtin string, block_index int, category_id string, basis string, serving_value double, serving_unit string, serving_description string"
    columns += ", " + ", ".join(f"{n} double" for n in NUTRIENT_IDS)
    row = lambda g, c, b, amount=None, **v: (g, 0, c, b, amount, "g" if amount else None, None, *[v.get(n) for n in NUTRIENT_IDS])
    panels = spark.createDataFrame(
        [row("1", "child", "per_100g", sugars_g=10.0, sodium_mg=1000.0), row("2", "child", "per_serving", 25.0, sugars_g=2.6),
         row("3", "other", "per_100g", sugars_g=50.0), row("4", "child", "per_serving", sugars_g=9.0), row("5", None, "per_100g", sugars_g=90.0)],
        columns,
    )
    tree = spark.createDataFrame([("root", None), ("child", "root"), ("other", None)], "id string, parent_id string")
    rules = spark.createDataFrame(
        [("root", "Sweets", "sugars_g", "Sugars", "g", None, None, 10.0), ("root", "Sweets", "salt_g", "Salt", "g", "sodium_mg", 0.0025, 2.0)],
        "category_id string, source_category string, nutrient string, display string, unit string, derived_from string, multiply_by double, above double",
    )
    found = limits.category_limits(panels, tree, rules).orderBy("gtin", "nutrient").collect()
    assert [(r.gtin, r.nutrient, r.exceeds) for r in found] == [("1", "salt_g", True), ("1", "sugars_g", False), ("2", "sugars_g", True)]
    assert found[0].statement == "Salt: 2.5 g per 100 g, above the limit of 2 g for Sweets."
    assert found[1].statement == "Sugars: 10 g per 100 g, within the limit of 10 g for Sweets."


def test_coverage_needs_no_single_task(spark):
    draw = random.Random(3)
    terms = [f"t{int(draw.paretovariate(0.8))}" for _ in range(5000)] + ["", None]
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    found = coverage.term_coverage(
        coverage.term_counts(table), spark.createDataFrame([("t1",), ("t3",), ("t3",), (None,)], "alias string")
    )
    counts = sorted(Counter(t for t in terms if t).items(), key=lambda x: (-x[1], x[0]))
    upto, want = 0, []
    for i, (t, n) in enumerate(counts):
        upto += n
        want.append((t, n, i + 1, upto, 5000, t in ("t1", "t3")))
    got = [tuple(r) for r in found.select("term", "mentions", "place", "covered", "total", "known").orderBy("place").collect()]
    assert got == want
    marks = {r.share: r.terms for r in coverage.coverage_marks(found, [1, 53, 70, 100]).collect()}
    assert marks == {s: next(p for _, _, p, c, _, _ in want if c * 100 >= s * 5000) for s in (1, 53, 70, 100)}
    plan = coverage.running_total(table.withColumn("n", F.lit(1)), [F.asc("term")], "n", "upto")._jdf.queryExecution().toString()
    assert "SinglePartition, ENSURE" not in plan.split("Window")[-1].split("Aggregate")[0]
    assert coverage.term_coverage(coverage.term_counts(table.limit(0))).collect() == []


def slow_choice(claims, rounds):
    rank = {n: len(conflicts.AUTHORITY) - i for i, n in enumerate(conflicts.AUTHORITY)}
    said, prior = {}, {}
    for key, path, source, kind, value in claims:
        if None not in (key, path, source, value):
            said[key, path, value, source] = max(said.get((key, path, value, source), 0), rank.get(kind, 0))
    for (*_, source), r in said.items():
        prior[source] = max(prior.get(source, 0), 1000 * r // 6)
    weights = dict(prior)

    def judge():
        items = defaultdict(dict)
        for (key, path, value, source), r in said.items():
            s, top = items[key, path].get(value, (0, 0))
            items[key, path][value] = (s + weights[source], max(top, r))
        return items, {i: min(v, key=lambda x: (-v[x][0], -v[x][1], x)) for i, v in items.items()}

    items, chosen = judge()
    for _ in range(rounds):
        seen, agreed = Counter(), Counter()
        for key, path, value, source in said:
            if len(items[key, path]) > 1:
                seen[source] += 1
                agreed[source] += value == chosen[key, path]
        after = {s: (10 * p + 1000 * agreed[s]) // (10 + seen[s]) for s, p in prior.items()}
        if after == weights:
            break
        weights = after
        items, chosen = judge()
    return {(*i, v): (support, v == chosen[i]) for i, values in items.items() for v, (support, _) in values.items()}


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_conflict_choice_matches_brute_force(spark, rounds):
    draw = random.Random(rounds)
    kinds = [*conflicts.AUTHORITY, "hearsay", None]
    truth = {k: str(draw.randrange(5)) for k in range(80)}
    claims = []
    for k in truth:
        for s in draw.sample(range(12), draw.randrange(1, 7)):
            value = truth[k] if draw.random() < (0.9 if s % 3 else 0.3) else str(draw.randrange(5))
            claims.append((f"k{k}", "fat", f"s{s}", kinds[s % 8], value))
    claims += claims[:20] + [("k1", "fat", "s1", "packaging", None), (None, "fat", "s1", "packaging", "1")]
    table = spark.createDataFrame(claims, "key string, path string, source string, type string, value string")
    found = conflicts.resolve(table, rounds=rounds).collect()
    assert {(r.key, r.path, r.value): (r.support, r.chosen) for r in found} == slow_choice(claims, rounds)
    # No value is lost, and each item has one choice.
    assert len(found) == len({(c[0], c[1], c[4]) for c in claims if None not in (c[0], c[1], c[2], c[4])})
    assert all(n == 1 for n in Counter((r.key, r.path) for r in found if r.chosen).values())


def test_equal_support_stays_unresolved(spark):
    claims = [("k", "fat", "a", "packaging", "13.1"), ("k", "fat", "b", "packaging", "11.8"), ("k", "name", "a", "packaging", "x")]
    table = spark.createDataFrame(claims, "key string, path string, source string, type string, value string")
    found = {(r.path, r.value): (r.chosen, r.resolution) for r in conflicts.resolve(table, rounds=0).collect()}
    assert found == {("fat", "11.8"): (True, "unresolved"), ("fat", "13.1"): (False, "unresolved"), ("name", "x"): (True, "agreed")}
    assert conflicts.resolve(table.limit(0)).collect() == []
