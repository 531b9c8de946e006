"""How often the import reports map the lines."""

import re

from pyspark.sql import functions as F

from checks import imports
from checks.registry import QUERIES
from larder.plans import importing
from larder.sources.export import decode_lines

SMOKE = "/root/testdata/sf0.001"


def test_a_report_maps_each_import_once(spark, monkeypatch):
    calls = []
    whole = importing.map_products
    monkeypatch.setattr(importing, "map_products", lambda *a, **o: calls.append(1) or whole(*a, **o))
    imports.whole_report(spark, SMOKE)
    assert len(calls) == 2


def test_a_manifest_reads_written_products(spark):
    plan = imports.manifest(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan


def test_a_filter_on_fields_does_not_decode_the_lines_again(spark):
    plan = QUERIES["region_filter"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    filters = re.findall(r"Filter \((.*?)(?:Project \[|Generate )", plan, re.S)
    assert any("en:india" in condition for condition in filters)
    assert not any("from_json" in condition for condition in filters)


def test_fields_that_nobody_reads_are_not_made(spark):
    lines = spark.createDataFrame([('{"code":"1","brands":"x"}', 0), ('{"code":"2"', 1)], "value string, ord long")
    found = decode_lines(lines).where(F.col("code").startswith("1") | F.col("malformed")).select("ord", "code")
    assert sorted(map(tuple, found.collect())) == [(0, "1"), (1, None)]
    assert "AS brands" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_loop_over_names_looks_at_columns_that_are_worked_out_once(spark):
    plan = QUERIES["scan_jsonl"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    loop = next(line for line in plan.splitlines() if "AS _fields#" in line)
    assert "reverse" not in loop and "from_json" not in loop


def test_members_of_nutriments_keep_their_last_text(spark):
    inner = '"fat_100g":1,"x":{"fat_100g":9},"fat_100g":"2.50","fiber_100g":3,"fiber_100g":null,"brands":["b","c"],"code":"7"'
    rows = [
        '{"nutriments":{%s}}' % inner, '{"fat_100g":null,"nutriments":{%s}}' % inner, '{"nutriments":[{%s}]}' % inner,
        '{"nutriments":{"fat_100g":5},"code":"1","nutriments":{%s}}' % inner, '{"nutriments":"{\'fat_100g\':1}"}',
    ]
    lines = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "value string, ord long")
    found = decode_lines(lines).orderBy("ord").select("malformed", "code", "brands", "fat_100g", "fiber_100g").collect()
    assert [tuple(r) for r in found] == [
        (False, "7", "b,c", "2.50", None), (False, "7", "b,c", None, None), (False, None, None, None, None),
        (False, "1", "b,c", "2.50", None), (False, None, None, None, None),
    ]
