"""How the rule jobs read records: once, and with rules outside generators."""

import re

from pyspark.sql import functions as F

from checks import rules
from checks.bindings import TODAY
from checks.registry import QUERIES
from larder.operators import quality
from larder.schemas import PRODUCT_COLUMNS

SMOKE = "/root/testdata/sf0.001"


def stored_records(spark, folder):
    rules.records(spark, SMOKE).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_stand_outside_the_generator(spark, tmp_path):
    plan = plan_of(quality.row_findings(stored_records(spark, tmp_path / "r"), TODAY, "rid", path="path"))
    assert "CASE" not in "".join(re.findall(r"Generate (inline\(.*)", plan))


def test_all_rules_read_the_records_once(spark, tmp_path):
    records = stored_records(spark, tmp_path / "r")
    plan = plan_of(quality.all_findings(records, rules.ids(spark, SMOKE), TODAY, "rid"))
    assert len(re.findall(r"FileScan parquet .*r\]", plan)) == 1


def test_one_scan_finds_what_the_parts_find(spark, tmp_path):
    records = stored_records(spark, tmp_path / "r")
    dims = rules.ids(spark, SMOKE)
    parts = quality.row_findings(records, TODAY, "rid")
    for part, name in (
        (quality.unknown_brands, "brand"), (quality.unknown_categories, "category"),
        (quality.unknown_countries, "country"), (quality.unmatched_ingredients, "ingredient"),
    ):
        parts = parts.unionByName(part(records, dims[name], "rid"))
    whole = quality.all_findings(records, dims, TODAY, "rid")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.select(whole.columns).collect()))


def test_coverage_by_odd_paths(spark):
    """Names and panels cover themselves; a path below, and one whose slash belongs to its name, do not."""
    paths = ["/name", "nutrition[0]", "nutrition/1", "brand.x", "category"]
    entry = "named_struct('source', 's1', 'confidence', 'high', 'note', cast(null as string))"
    made = ", ".join(f"'{p}', {entry}" for p in paths)
    fields = {
        "gtin": "'08901719134845'", "name": "'x'", "brand": "'b'", "category": "'c'", "provenance": f"map({made})",
    }
    row = rules.records(spark, SMOKE).where("size(nutrition) = 2 and package is null").limit(1)
    for name, text in fields.items():
        row = row.selectExpr(*[c for c in row.columns if c != name], f"{text} as {name}")
    assert set(PRODUCT_COLUMNS) <= set(row.columns)
    found = quality.only(quality.row_findings(row, TODAY, "rid"), "0501").collect()
    pointers = {f.pointer for f in found}
    assert {"/name", "/brand", "/nutrition/1"} <= pointers and not pointers & {"/category", "/nutrition/0"}


def test_records_make_only_the_fields_that_are_read_and_keep_filters_above(spark):
    plan = plan_of(rules.records(spark, SMOKE).where("array_contains(countries, 'C1')").select("rid", "countries"))
    assert "map_from_entries" not in plan and "format_string" not in plan
    assert plan.index("array_contains(countries") < plan.index("monotonically_increasing_id")
    assert rules.records(spark, SMOKE).columns == ["rid", "path", *PRODUCT_COLUMNS]


def test_rules_asked_for_are_found_and_no_others_worked_out(spark, tmp_path):
    """Every rule alone, and pairs of a panel's and a record's, give what all rules together give of them."""
    records = stored_records(spark, tmp_path / "r").withColumn("raw", F.to_json(F.struct("name", "brand")))
    whole = quality.row_findings(records, TODAY, "rid", path="path", raw="raw").collect()
    codes = sorted({f.code for f in whole})
    assert len(codes) > 20
    for wanted in [*([c] for c in codes), ["0401", "0103"], ["0410", "0501", "0802"]]:
        some = quality.row_findings(records, TODAY, "rid", path="path", raw="raw", codes=wanted)
        assert sorted(map(tuple, some.collect())) == sorted(tuple(f) for f in whole if f.code in wanted)
    plan = plan_of(QUERIES["saturated_above_fat"](spark, SMOKE))
    assert "0401" in plan and "0402" not in plan and "map_from_entries" not in plan and "from_json" not in plan


def test_lambdas_look_at_columns_that_are_worked_out_once(spark):
    """Parsing the record inside the lambda over its entries would parse it once an entry."""
    plan = QUERIES["stale_paths"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json", plan.lower())) == 1
    assert re.search(r"AS _document#\d+", plan)


def test_the_flag_of_broken_rules_is_not_worked_out_in_a_lambda(spark):
    plan = QUERIES["prune_broken"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"exists\(_found#\d+", plan)


def test_the_flag_looks_at_all_rules_of_severity_error_and_no_other(spark, tmp_path):
    records = stored_records(spark, tmp_path / "r")
    found = quality.row_findings(records, TODAY, "rid", path="path", raw=None)
    severities = {(r.code, r.severity) for r in found.select("code", "severity").distinct().collect()}
    assert {c for c, s in severities if s == "error"} <= quality.ERROR_CODES
    assert not {c for c, s in severities if s != "error"} & quality.ERROR_CODES
    broken = quality.row_findings(records, TODAY, "rid").where("severity = 'error'")
    kept = records.join(broken.select("rid").distinct(), "rid", "left_anti").select("rid").collect()
    flagged = quality.with_row_error(records, TODAY, "flag")
    assert {r.rid for r in flagged.where("not flag").select("rid").collect()} == {r.rid for r in kept}
    assert "0802" not in plan_of(flagged)
