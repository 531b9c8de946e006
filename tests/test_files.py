"""Files cut short, wide keys, pointers, whole builds and record text from end to end."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from checks import bindings
from larder import schemas
from larder.functions.barcodes import normalize_gtin
from larder.functions.pointers import resolves
from larder.operators import quality
from larder.operators.brands import merge_brands
from larder.operators.lookup import lookup_products
from larder.plans.building import build_catalogue
from larder.plans.importing import import_products
from larder.plans.validating import reference_record_findings
from larder.sources.catalogue import read_catalogue
from larder.sources.export import OPEN_DATABASE, decode_lines, input_lineage, read_extent, read_lines, source_snapshot
from larder.sources.records import read_record_text
from larder.streaming.scans import demand_stream
from tests.test_import import line, lines


def test_a_cut_gzip_fails_unless_asked_and_is_then_reported(spark, tmp_path):
    whole = "\n".join(line(code=str(i)) for i in range(20_000)) + "\n"
    packed = gzip.compress(whole.encode())
    (tmp_path / "cut.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "good.jsonl").write_text(whole)
    with pytest.raises(Exception, match="(?i)eof|end of|corrupt|unexpected"):
        read_lines(spark, str(tmp_path)).count()
    read = read_lines(spark, str(tmp_path), skip_corrupt=True)
    extent = {r.file.rsplit("/", 1)[1]: r for r in read_extent(read).collect()}
    assert 0 < extent["cut.gz"].lines < 20_000 == extent["good.jsonl"].lines
    assert extent["good.jsonl"].bytes == len(whole.encode()) and extent["good.jsonl"].whole


def test_the_last_of_repeated_members_counts(spark):
    text = '{"code":"1","fat_100g":null,"code":"2","nutriments":{"fat_100g":3,"sugars_100g":1,"sugars_100g":2}}'
    row = decode_lines(lines(spark, text)).first()
    assert (row.malformed, row.code, row.fat_100g, row.sugars_100g) == (False, "2", None, "2")


def test_brackets_in_texts_and_nested_lists(spark):
    row = decode_lines(
        lines(spark, '{"product_name":"[new] bar","brands":["a",["b",1],{"c":2},null,""],"code":{"x":1},"serving_size":"{x}"}')
    ).first()
    assert (row.product_name, row.brands, row.code, row.serving_size) == ("[new] bar", "a,b,1", None, "{x}")


@pytest.mark.parametrize("text", ["[1]", "5", '{"a":1', "{'a':1}", '{"a":NaN}', "{a:1}"])
def test_what_is_not_a_json_object_is_malformed(spark, text):
    assert decode_lines(lines(spark, text)).first().malformed


def test_wide_keys_stay_apart(spark, tmp_path):
    keys = [1, 999_999_999, 1_000_000_000, 1_234_567_890, 1_234_567_899, 2_234_567_890, 4_800_000_000_007]
    orders = spark.createDataFrame(
        [(k, "O", "1-URGENT", 10.0) for k in keys],
        "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    codes = bindings.table(spark, str(tmp_path), "raw_base").select("k", normalize_gtin(F.col("code")).alias("g"))
    found = {r.k: r.g for r in codes.collect()}
    valid = [g for k, g in found.items() if g is not None]
    assert len(set(valid)) == len(valid)
    assert {k for k, g in found.items() if g is None} == {k for k in keys if k % 17 == 0 or k % 11 == 0}
    parts = spark.createDataFrame(
        [(k, "n", "Brand#1", "t", 1) for k in [*keys, 10_000_001, 110_000_001]],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    )
    parts.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("code_rows", "part_products"):
        column = "code" if name == "code_rows" else "gtin"
        rows = bindings.table(spark, str(tmp_path), name).select("p_partkey", normalize_gtin(F.col(column)).alias("g"))
        made = {r.p_partkey: r.g for r in rows.collect()}
        good = [g for g in made.values() if g is not None]
        assert len(good) == len(set(good)) >= len(keys), name


def test_pointers_into_odd_names(one):
    document = json.dumps({"names": {"1": "x", 'a"b': None, "it's": 1}, "list": [{"k": 0}], "a/b": {"~": 1}})
    there = ["", "/names/1", '/names/a"b', "/names/it's", "/list/0/k", "/a~1b/~0", "/list"]
    missing = ["/names/2", "/list/1", "/list/k", "/names/1/x", "/none", "/list/12345678901"]
    for pointer in there + missing:
        found = one(lambda: resolves(F.parse_json("d"), F.col("p")), d=document, p=pointer)
        assert found == (pointer in there), pointer


def test_probes_without_a_key_and_unknown_ones_stay(spark):
    probes = spark.createDataFrame([(1, "8901234567890"), (2, "bad"), (3, None), (4, "96385074")], "id int, code string")
    product = spark.createDataFrame([("08901234567890", "Tea")], "gtin string, name string")
    found = {r.id: (r.gtin, r.name, r.found) for r in lookup_products(probes, product, "code").collect()}
    assert found == {
        1: ("08901234567890", "Tea", True), 2: (None, None, False), 3: (None, None, False),
        4: ("00000096385074", None, False),
    }


def test_a_build_runs_the_product_plan_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    rows = lines(spark, *[line(code=c) for c in ("8901234567890", "4006381333931")])
    products = import_products(rows.mapInArrow(counted, rows.schema), OPEN_DATABASE, "2026-08-27")
    none = {
        "brand": spark.createDataFrame([], schemas.BRAND), "category": spark.createDataFrame([], schemas.CATEGORY),
        "ingredient": spark.createDataFrame([], schemas.INGREDIENT), "country": spark.createDataFrame([], schemas.COUNTRY),
    }
    meta = spark.createDataFrame([("schema_version", "1")], "key string, value string")
    build_catalogue(products, none, meta, str(tmp_path))
    assert runs.value == 2
    tables = read_catalogue(spark, str(tmp_path))
    assert tables["product"].count() == 2 and tables["nutrition"].count() == 2


def record(**changes):
    base = {
        "schema_version": 1, "gtin": "08901234567890", "barcode_printed": "8901234567890", "barcode_format": "EAN-13",
        "name": "Tea", "countries": ["IN"],
        "sources": [{"id": "s1", "type": "packaging", "retrieved_at": "2026-01-01"}],
        "provenance": {"name": {"source": "s1", "confidence": "high"}},
        "verification": {"status": "unverified", "last_verified": "2026-01-01"},
    }
    return json.dumps({k: v for k, v in {**base, **changes}.items() if v is not None})


def test_record_files_are_validated_end_to_end(spark, tmp_path):
    folder = tmp_path / "data" / "products" / "890"
    folder.mkdir(parents=True)
    texts = {
        "08901234567890": record(),
        "cut": record()[:-5],
        "shape": record(package={"quantity": {"value": 1, "unit": "furlong"}}, verification={"status": "new"}),
        "again": record(name="Tea again"),
        "member": record(verification={"status": "verified", "last_verified": "2026-01-01", "by": "x"}),
    }
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    read = read_record_text(spark, str(tmp_path), base=str(tmp_path))
    assert read.count() == len(texts)
    dims = {k: spark.createDataFrame([], "id string") for k in ("brand", "category", "country", "ingredient")}
    found = {}
    for r in quality.validate_text(read, "2026-06-15", dims).collect():
        found.setdefault(r.path.rsplit("/", 1)[1][:-5], set()).add((r.code, r.pointer))
    assert found["cut"] == {("0101", "")}
    assert found["shape"] == {("0201", "/package/quantity/unit"), ("0201", "/verification/status")}
    assert found["member"] == {("0201", "/verification/by")}
    # The two readable records share a gtin: the second path repeats it.
    assert ("0701", "/gtin") in found["again"] or ("0701", "/gtin") in found["08901234567890"]
    assert ("0704", "/countries/0") in found["08901234567890"]


def test_records_that_lose_a_field_do_not_load(spark):
    typed = spark.createDataFrame(
        [("a", "1", "n", ("x",)), ("b", None, "n", ("x",)), ("c", "1", "n", None)],
        "path string, gtin string, name string, verification struct<status:string>",
    )
    assert sorted(r.path for r in quality.unloadable(typed).collect()) == ["b", "c"]


def test_reference_records_need_sources_for_their_claims(spark):
    source = [("s1", "packaging", None, "2026-01-01", None, None)]
    brands = spark.createDataFrame(
        [
            ("a", "A", "Owner", ["IN"], source, {"name": ("s1", "high", None), "owner": ("s1", "high", None)}, 1),
            ("b", "B", "Owner", ["IN"], source, {"name": ("s1", "high", None)}, 1),
        ],
        schemas.BRAND,
    )
    ingredients = spark.createDataFrame(
        [(0, "oil", "Oil", None, None, ["fat"], [], source, {}, 1)], schemas.INGREDIENT
    )
    found = {(r.id, r.code, r.pointer) for r in reference_record_findings(brands, ingredients).collect()}
    assert {f for f in found if f[1] == "0501"} == {("b", "0501", "/owner"), ("oil", "0501", "/aliases")}


def test_unchanged_brands_keep_their_record(spark):
    kind = "id string, name string, owner string, schema_version int"
    old = spark.createDataFrame([("a", "A", None, 1), ("b", "B", "x", 1), ("c", "C", None, 1)], kind)
    new = spark.createDataFrame([("a", "A", None, 2), ("b", "B", "y", 2), ("d", "D", None, 2)], kind)
    merged = merge_brands(old, new).collect()
    assert {r.id: r.schema_version for r in merged} == {"a": 1, "b": 2, "c": 1, "d": 2}


def test_lineage_counts_files_and_bytes(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text(line(code=str(i)) + "\n")
    files = input_lineage(spark.read.text(str(tmp_path)))
    shot = source_snapshot(files, OPEN_DATABASE, "2026-08-27").collect()
    assert sorted(r.size_bytes for r in shot) == sorted(p.stat().st_size for p in tmp_path.iterdir())
    assert {r.source_id for r in shot} == {OPEN_DATABASE.id} and all(r.licence for r in shot)


def test_demand_of_a_stream_of_scans(spark, tmp_path):
    rows = [("a", False), ("a", False), ("b", False), ("c", True)]
    spark.createDataFrame(rows, "gtin string, found boolean").withColumn(
        "scanned_at", F.lit("2026-01-01").cast("timestamp")
    ).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("gtin string, found boolean, scanned_at timestamp").parquet(f"{tmp_path}/in")
    query = (
        demand_stream(stream).writeStream.format("memory").queryName("demand").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert {r.gtin for r in spark.table("demand").collect()} == {"a", "b"}
