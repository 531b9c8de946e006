"""Peers, bands, phrases, search, scans and the catalogue."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.analysis import band_rows, palm_list
from larder import schemas
from larder.operators import bands, peers, phrases, scans, search, tables
from larder.operators.report import content_fingerprint
from larder.plans.building import catalogue_tables
from larder.sources.catalogue import catalogue_status, read_catalogue, write_catalogue
from larder.sources.export import OPEN_DATABASE
from larder.sources.records import read_records, write_records
from larder.streaming.scans import enriched_stream, write_scans
from larder.vocab import NUTRIENT_IDS

PANEL = "gtin string, block_index int, basis string, serving_description string, serving_value double, serving_unit string, not_declared array<string>, " + ", ".join(f"{n} double" for n in NUTRIENT_IDS)


def panel(spark, basis, serving=(None, None, None), **values):
    row = ("g", 0, basis, *serving, None, *[float(values[n]) if n in values else None for n in NUTRIENT_IDS])
    return spark.createDataFrame([row], PANEL)


def levels(spark, *args, **values):
    got = bands.nutrient_bands(panel(spark, *args, **values), band_rows(spark)).collect()
    return {r.nutrient: r for r in got}


@pytest.mark.parametrize("sugars, level", [(5.0, "Lower"), (5.01, "Moderate"), (22.5, "Moderate"), (22.51, "Higher")])
def test_food_sugar_bands(spark, sugars, level):
    assert levels(spark, "per_100g", sugars_g=sugars)["sugars_g"].level == level


def test_bands_of_drinks_servings_and_portions(spark):
    assert levels(spark, "per_100ml", sugars_g=15)["sugars_g"].level == "Higher"
    assert levels(spark, "per_100g", sugars_g=15)["sugars_g"].level == "Moderate"
    scaled = levels(spark, "per_serving", ("2 biscuits (25 g)", 25.0, "g"), sugars_g=6)["sugars_g"]
    assert (round(scaled.value, 3), scaled.level, scaled.calculated) == (24.0, "Higher", True)
    assert "Calculated from the declared serving" in scaled.statement
    assert levels(spark, "per_100g", ("1 pack", 150.0, "g"), sugars_g=20)["sugars_g"].level == "Higher"
    assert levels(spark, "per_100g", ("1 pack", 30.0, "g"), sugars_g=20)["sugars_g"].level == "Moderate"
    assert levels(spark, "per_serving", ("1 biscuit", None, None), sugars_g=6) == {}
    salt = levels(spark, "per_100g", sodium_mg=600)["salt_g"]
    assert salt.level == "Moderate" and round(salt.value, 3) == 1.5 and "2.5" in salt.derived_note
    statement = levels(spark, "per_100g", sugars_g=25.5)["sugars_g"].statement
    assert "25.5 g per 100 g" in statement and "above 22.5 g" in statement


def test_statements_carry_no_verdict(spark):
    banned = ["healthy", "good for", "bad for", "avoid", "safe", "harmful", "junk", "should not", "recommended"]
    for row in levels(spark, "per_100g", sugars_g=40, fat_g=30, sodium_mg=900).values():
        assert not any(word in row.statement.lower() for word in banned)


def test_peer_cutoffs_match_nearest_rank(spark):
    random.seed(3)
    values = [("c" if i % 3 else "hot", "per_100g", "sugars_g", round(random.random() * 20, 1)) for i in range(900)]
    df = spark.createDataFrame(values, "category_id string, basis string, nutrient string, value double")
    for partitions in (1, 7):
        got = peers.peer_stats(df.repartition(partitions), 30, 7, 75, "r", "1").collect()
        assert len(got) == 2
        for r in got:
            mine = sorted(v[3] for v in values if v[0] == r.category_id)
            rank = [max(1, min(len(mine), math.ceil(p / 100.0 * len(mine)))) for p in (7.0, 75.0)]
            assert (r.lower_value, r.higher_value) == (mine[rank[0] - 1], mine[rank[1] - 1])
    assert peers.peer_stats(df, 10_000, 25, 75, "r", "1").count() == 0


def detected(spark, *texts, tree=None):
    rows = [(i, t, tree) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, label string, tree string")
    claimed = phrases.claimed_phrases(df, palm_list(spark), "id", "label", tree="tree")
    return [r for r in phrases.detect(claimed, "id").orderBy("id").collect()]


def test_phrase_states(spark):
    texts = {
        "Edible vegetable oil (palm), sugar": "Present", "Rice flour, palm sugar": "NotDetected",
        "Cocoa, palm kernel oil": "Present", "Sugar, edible vegetable oil, salt": "Unknown",
        "Water, palmitic acid": "NotDetected", "  ": "NoIngredients", "Palmyra fibre": "NotDetected",
        "Wheat flour, palm oil (25%), sugar": "ConfirmedQuantity", # A full stop stays part of the word: only the bare "palm" matches here.
        "Contains palm oil.": "Present",
    }
    got = detected(spark, *texts)
    assert [r.state for r in got] == list(texts.values())
    assert got[2].reported_id == "palm-kernel-oil" and got[2].definite_count == 1
    assert got[7].percentage == 25.0 and "25%" in got[7].statement
    assert "not a guarantee" in got[1].statement
    stated = detected(spark, "Refined palm oil, sugar", tree='[{"raw":"x","canonical":"palm-oil","percentage":18.5}]')[0]
    assert (stated.state, stated.percentage) == ("ConfirmedQuantity", 18.5)


def brute_force(text, aliases):
    """Greedy longest-first claims, one text at a time."""
    import re

    found = []
    for segment in re.split(r"[,;()\[\]{}•|\n]+", text.lower()):
        words = re.sub("[^a-z0-9%.]+", " ", segment).split()
        taken = set()
        for alias in sorted(aliases, key=lambda a: -len(a)):
            size = len(alias.split())
            starts = [i for i in range(len(words)) if words[i:i + size] == alias.split()]
            if starts and not taken & set(range(starts[0], starts[0] + size)):
                taken |= set(range(starts[0], starts[0] + size))
                found.append(alias)
    return sorted(found)


def test_phrases_match_brute_force(spark):
    random.seed(5)
    aliases = ["a b", "b c d", "a", "b", "d e", "c"]
    texts = [" ".join(random.choice(["a", "b", "c", "d", "e", "f", ","]) for _ in range(random.randint(1, 60))) for _ in range(150)]
    words = spark.createDataFrame(
        [(i, a.replace(" ", "-"), a, None, ["sure"]) for i, a in enumerate(aliases)],
        "ordinal int, id string, name string, aliases array<string>, flags array<string>",
    )
    df = spark.createDataFrame(list(enumerate(texts)), "id int, label string").repartition(5)
    claimed = phrases.claimed_phrases(df, words, "id", "label", definite="sure")
    got = {r.id: sorted(m.alias for m in r.matches) for r in claimed.collect()}
    assert got == {i: brute_force(t, aliases) for i, t in enumerate(texts)}


def test_ingredient_tree_of_any_depth(spark):
    deep = '{"raw":"n39"}'
    for i in range(38, -1, -1):
        deep = f'{{"raw":"n{i}","children":[{deep}]}}'
    df = spark.createDataFrame([("g", f'[{deep},{{"raw":"last"}}]'), ("e", "[]"), ("n", None)], "gtin string, ingredients string")
    from larder.operators.ingredients import flatten_ingredients

    got = flatten_ingredients(df).orderBy("ordinal").collect()
    assert [r.raw for r in got] == [f"n{i}" for i in range(40)] + ["last"]
    assert [r.parent_ordinal for r in got] == [None, *range(39), None]


CATALOGUE = [
    ("08901234567890", "Parle-G Biscuits", "parle", "biscuits", 25.5, "Flour, sugar"),
    ("08901111111116", "Monaco", "parle", "biscuits", None, "Flour"),
    ("08902222222227", "Mystery", "parle", None, None, None),
]


def catalogue_products(spark):
    rows = spark.createDataFrame(CATALOGUE, "gtin string, name string, brand string, category string, sugars double, ingredients_raw string")
    values = F.struct(*[(F.col("sugars") if n == "sugars_g" else F.lit(None).cast("double")).alias(n) for n in NUTRIENT_IDS])
    block = F.struct(F.lit("per_100g").alias("basis"), F.lit(None).alias("serving"), values.alias("values"), F.array(F.lit("fat_g")).alias("not_declared"))
    made = {
        "barcode_printed": F.substring("gtin", 2, 13), "barcode_format": F.lit("EAN-13"), "countries": F.array(F.lit("IN")),
        "nutrition": F.when(F.col("sugars").isNotNull(), F.array(block.cast(schemas.PANEL))),
        "verification": F.named_struct(F.lit("status"), F.lit("unverified"), F.lit("last_verified"), F.lit("2026-08-01")),
        "provenance": F.create_map(F.lit("name"), F.named_struct(F.lit("source"), F.lit("s1"), F.lit("confidence"), F.lit("high"), F.lit("note"), F.lit(None).cast("string"))),
        "schema_version": F.lit(1),
    }
    return rows.select(*[made.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in schemas.PRODUCT_FIELDS])


def build(spark, **options):
    dims = {
        "brand": spark.createDataFrame([("parle", "Parle", None)], "id string, name string, owner string"),
        "category": spark.createDataFrame([], schemas.CATEGORY),
        "country": spark.createDataFrame([], schemas.COUNTRY),
        "ingredient": spark.createDataFrame([], schemas.INGREDIENT),
    }
    meta = tables.meta_table(spark, 1, "2026-08-27", OPEN_DATABASE)
    return catalogue_tables(catalogue_products(spark), dims, meta, **options)


def test_catalogue_build_write_read_search(spark, tmp_path):
    path = str(tmp_path / "cat")
    built = build(spark)
    assert len(built) == 18
    write_catalogue(built, path)
    read = read_catalogue(spark, path)
    assert [read[n].count() for n in ("product", "nutrition", "nutrition_not_declared")] == [3, 1, 1]
    assert read["product"].where("is_complete = 0").count() == 1
    assert catalogue_status(read["meta"], read["product"]).first().usable
    queries = spark.createDataFrame([("m", "mys"), ("p", "parle"), ("none", "()"), ("two", "par mona")], "query_id string, text string")
    hits = search.search_products(read["product"], read["brand"], read["product_search"], queries, 50).collect()
    found = {q: [h.name for h in sorted(hits, key=lambda h: h.rank) if h.query_id == q] for q in ("m", "p", "none", "two")}
    assert found["m"] == ["Mystery"] and sorted(found["p"]) == ["Monaco", "Mystery", "Parle-G Biscuits"]
    assert found["none"] == [] and found["two"] == ["Monaco"]
    back = tables.assemble_products(read).where("gtin = '08901234567890'").first()
    assert back.nutrition[0]["values"].sugars_g == 25.5 and back.nutrition[0].not_declared == ["fat_g"]


def test_starter_leaves_incomplete_products_out(spark):
    assert {r.name for r in build(spark, starter=2)["product"].collect()} == {"Parle-G Biscuits", "Monaco"}


def test_older_and_newer_catalogues(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    write_catalogue({k: v for k, v in build(spark).items() if k in ("meta", "product")}, old)
    assert read_catalogue(spark, old)["category_peer_stat"].count() == 0
    write_catalogue({"meta": spark.createDataFrame([("schema_version", "2")], "key string, value string")}, new)
    with pytest.raises(ValueError):
        read_catalogue(spark, new)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = catalogue_products(spark).select("gtin", "name", "nutrition")
    assert content_fingerprint(df).first() == content_fingerprint(df.orderBy(F.desc("name")).repartition(3)).first()
    assert content_fingerprint(df).first() != content_fingerprint(df.where("gtin < '089022'")).first()


def test_record_sinks(spark, tmp_path):
    write_records(catalogue_products(spark), str(tmp_path / "r"))
    assert (tmp_path / "r" / "shard=890").is_dir()
    assert read_records(spark, str(tmp_path / "missing"), schemas.BRAND).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.json").write_text('{\n "id": "x",\n "name": "X"\n}')
    assert read_records(spark, str(tmp_path / "b"), schemas.BRAND).select("id", "name").first() == ("x", "X")


def test_scan_stream_records_each_scan_once(spark, tmp_path):
    source = str(tmp_path / "scans")
    rows = [(" 8901234567890 ", datetime(2026, 1, 1, 10, 0)), ("8901234567890", datetime(2026, 1, 1, 10, 0)),
            ("96385074", datetime(2026, 1, 1, 10, 5)), ("https://x", datetime(2026, 1, 1, 10, 6))]
    schema = "raw string, scanned_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(source)
    product = catalogue_products(spark)
    stream = enriched_stream(spark.readStream.schema(schema).parquet(source), product, "1 hour")
    write_scans(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.gtin, r.found) for r in got.collect()} == {("08901234567890", True), ("00000096385074", False)}
    assert got.count() == 2
    batch = scans.record_scans(scans.enrich_scans(spark.createDataFrame(rows, schema), product))
    assert {tuple(r) for r in batch.collect()} == {tuple(r) for r in got.collect()}
    assert [tuple(r) for r in scans.miss_demand(got).collect()] == [("00000096385074", 1)]
