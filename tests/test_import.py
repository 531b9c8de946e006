"""Export lines to products, twice, in batch and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from larder.operators.report import import_report
from larder.operators.upsert import upsert
from larder.plans.importing import import_batch, import_products, map_lines
from larder.sources.export import OPEN_DATABASE, SourceSpec, decode_lines, flat_rows, read_lines, source_spec
from larder.sources.record_log import compact, current_records, read_log
from larder.streaming.imports import export_stream, start_import

GOOD = {
    "code": "8901234567890", "product_name": " Tasty  Biscuits ", "brands": "Nestlé, Other",
    "countries_tags": ["en:india"], "categories_tags": ["en:biscuits", "en:cream-biscuits"],
    "nutrition_data_per": "100g", "serving_size": "25 g", "product_quantity": "100", "product_quantity_unit": "g",
    "ingredients_text": "Flour, sugar",
    "nutriments": {"sugars_100g": 25.5, "sodium_100g": 0.296, "fat_100g": "12", "proteins_100g": -1},
}


def line(**changes):
    return json.dumps({**GOOD, **changes})


def lines(spark, *rows):
    return spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, ord long")


def product(spark, **changes):
    return import_products(lines(spark, line(**changes)), OPEN_DATABASE, "2026-08-27").first()


def reasons(spark, *rows):
    got = map_lines(lines(spark, *rows), OPEN_DATABASE, "2026-08-27").orderBy("ord")
    return [r["drop_reason"] for r in got.collect()]


def test_complete_row(spark):
    p = product(spark)
    assert (p.gtin, p.name, p.brand, p.category) == ("08901234567890", "Tasty Biscuits", "nestle", "cream-biscuits")
    panel = p.nutrition[0]
    assert panel.basis == "per_100g" and panel.serving is None
    assert (panel["values"].sugars_g, panel["values"].sodium_mg, panel["values"].fat_g) == (25.5, 296.0, 12.0)
    assert panel["values"].protein_g is None and panel["values"].added_sugars_g is None
    assert set(p.provenance) == {"name", "brand", "category", "package", "nutrition", "ingredients_raw"}
    assert p.verification.status == "unverified" and p.sources[0].retrieved_at == "2026-08-27"


def test_panels_need_a_basis_and_a_serving_text(spark):
    assert product(spark, nutrition_data_per=None).nutrition is None
    serving = {"nutriments": {"sugars_serving": 6}}
    assert product(spark, nutrition_data_per="serving", serving_size=None, **serving).nutrition is None
    panel = product(spark, nutrition_data_per="serving", serving_quantity=25, **serving).nutrition[0]
    assert panel.basis == "per_serving" and panel.serving.quantity.value == 25.0


def test_a_null_at_the_top_hides_the_nutriment(spark):
    assert product(spark, sugars_100g=None).nutrition[0]["values"].sugars_g is None


def test_drop_reasons(spark):
    assert reasons(spark, "{bad", line(code="8901234567891"), line(code="4006381333931", countries_tags=[]),
                   line(product_name="x"), line(), "[1]") == [
        "the source line is not valid JSON", "barcode is missing, malformed, or fails its check digit",
        "not sold in India and not an Indian barcode", "no product name", None, "the source line is not valid JSON",
    ]


def test_values_of_any_type(spark):
    row = decode_lines(lines(spark, line(code=8901234567890, product_name=True, brands={"a": 1}, serving_size=["x", "", 2, {"q": 1}, ["y"]]))).first()
    assert (row.code, row.product_name, row.brands, row.serving_size) == ("8901234567890", "true", None, "x,2,y")


def test_report_counts(spark):
    mapped = map_lines(lines(spark, line(), line(product_name="Again"), "{bad", line(code="96385074", nutrition_data_per=None, ingredients_text=" ")), OPEN_DATABASE, "2026-08-27")
    row = import_report(mapped).first()
    assert (row.candidates_read, row.mapped, row.dropped, row.duplicates, row.incomplete) == (4, 2, 1, 1, 1)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_first_record_wins_whatever_the_partitions(spark, partitions):
    # One key holds most rows.
    rows = [line(product_name=f"Name {i}") for i in range(60)] + [line(code="96385074", product_name="Other")]
    got = import_products(lines(spark, *rows).repartition(partitions), OPEN_DATABASE, "2026-08-27")
    assert {(r.gtin, r.name) for r in got.collect()} == {("08901234567890", "Name 0"), ("00000096385074", "Other")}


def test_second_import_keeps_dates_of_unchanged_records(spark):
    first = import_products(lines(spark, line(), line(code="96385074")), OPEN_DATABASE, "2026-08-27")
    again = import_products(
        lines(spark, line(), line(code="96385074", nutriments={"sugars_100g": 28.1})), OPEN_DATABASE, "2026-09-27"
    )
    got = {r.gtin: (r.state, r.verification.last_verified) for r in upsert(first, again).collect()}
    assert got == {"08901234567890": ("unchanged", "2026-08-27"), "00000096385074": ("changed", "2026-09-27")}


def test_files_keep_stream_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line(product_name="First") + "\n\n" + line(product_name="Second") + "\n")
    (tmp_path / "b.jsonl").write_bytes(line(product_name="Third").encode() + b"\n\xff\xfe\n")
    got = read_lines(spark, str(tmp_path), spread=4)
    assert got.count() == 4
    assert [r.name for r in import_products(got, OPEN_DATABASE, "2026-08-27").collect()] == ["First"]


def test_flat_rows(spark):
    raw = spark.createDataFrame([("8901234567890", "Flat name", "100g", "5")], ["Code", "product_name", "nutrition_data_per", "sugars_100g"])
    row = flat_rows(raw).first()
    assert (row.code, row.sugars_100g, row.brands) == ("8901234567890", "5", None)


def test_sources_must_be_listed_and_licensed():
    with pytest.raises(ValueError):
        source_spec("shop")
    with pytest.raises(ValueError):
        SourceSpec("x", "", "y", "", "")


def test_record_log_batches(spark, tmp_path):
    root = str(tmp_path / "log")

    def run(batch, *rows):
        import_batch(lines(spark, *rows), root, batch, OPEN_DATABASE, "2026-08-27", "2026-09-01")

    run(0, line(), line(code="96385074"))
    run(1, line(), line(code="96385074", product_name="Renamed"))
    run(1, line(), line(code="96385074", product_name="Renamed"))
    log = read_log(spark, root)
    assert {(r.batch, r.gtin) for r in log.collect()} == {(0, "08901234567890"), (0, "00000096385074"), (1, "00000096385074")}
    # Saturated fat above fat: the record is in error, so it goes.
    run(2, line(code="96385074", nutriments={"fat_100g": 1, "saturated-fat_100g": 9}))
    assert [r.gtin for r in current_records(read_log(spark, root)).collect()] == ["08901234567890"]
    compact(spark, root, str(tmp_path / "compact"), upto=3)
    assert current_records(read_log(spark, str(tmp_path / "compact"))).count() == 1


def test_streaming_import(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    (source / "1.jsonl").write_text(line() + "\n" + line(product_name="Later duplicate") + "\n{bad\n")
    for _ in range(2):
        query = start_import(export_stream(spark, str(source)), root, str(tmp_path / "cp"), OPEN_DATABASE, "2026-08-27", "2026-09-01")
        query.awaitTermination(120)
        (source / "2.jsonl").write_text(line(code="96385074") + "\n")
    got = current_records(read_log(spark, root)).select("gtin", "name").collect()
    assert {tuple(r) for r in got} == {("08901234567890", "Tasty Biscuits"), ("00000096385074", "Tasty Biscuits")}
