"""Golden cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from larder.functions import barcodes, dates, numbers, pointers, text
from larder.operators import phrases, search


def results(spark, cases, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["v"] for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def check(spark, cases, make):
    assert results(spark, list(cases), make) == list(cases.values())


def test_normalize_gtin(spark):
    check(spark, {
        "8901234567890": "08901234567890", "036000291452": "00036000291452", "96385074": "00000096385074",
        " 8901234567890\t": "08901234567890", "8901234567891": None, "890123456789": None,
        "12345678901234567": None, "89O1234567890": None, "": None, "1234567": None,
    }, barcodes.normalize_gtin)


def test_check_digit(spark):
    check(spark, {"890123456789": 0, "890111111111": 6, "890222222222": 7}, barcodes.check_digit)


def test_check_digit_has_no_upper_length(spark):
    # 18 digits (a logistics code): longer than the arithmetic path takes.
    check(spark, {"106141411234567897": True, "106141411234567898": False}, barcodes.has_valid_check_digit)


def test_shard(spark):
    check(spark, {"08901234567890": "890", "00036000291452": "360", "00000000000017": "017", "12": None},
          barcodes.gtin_shard)


def test_scanned_codes(spark):
    check(spark, {
        "(01)08901719134845": "08901719134845", "0108901719134845": "08901719134845",
        "010890171913484510ABC123": "08901719134845", "]d20108901719134845": "08901719134845",
        "https://example.org/x": None, "8901234567891": None, "": None,
    }, barcodes.scanned_gtin)
    check(spark, {
        "8901234567890": "Product", "8901234567891": "BadCheckDigit", "  ": "Empty", "hello": "NotAProduct",
        "upi://pay": "NotAProduct",
    }, barcodes.scan_kind)


def test_slug(spark):
    check(spark, {"  Mother's  Recipe  ": "mother-s-recipe", "Nestlé": "nestle", "!!!": None,
                  "Straße Œuvre": "strasse-oeuvre", "पारले": None, "x" * 81: None}, text.slug)


def test_category(spark):
    check(spark, {"en:biscuits,en:cream-biscuits": "cream-biscuits", "en:sodas": "soft-drink", "en:what": None,
                  " EN:Sodas ,x": "soft-drink", "": None}, text.map_category)


def test_clean_and_lists(spark):
    check(spark, {" a \n  b ": "a b", " 　 ": None}, text.clean_text)
    check(spark, {" , , A B , C": "A B", ",": None, "One": "One"}, text.first_of_list)
    check(spark, {"abc  def": "abc", "ab": "ab"}, lambda x: text.truncate(x, 5))


def test_numbers(spark):
    check(spark, {"5d": None, "NaN": None, "Infinity": None, "-1": None, " 1.5 ": 1.5, "1e2": 100.0, ".5": 0.5,
                  "5.": 5.0, "": None, "1e999": None, "+7": 7.0, "-0.0": 0.0, "-1e-400": None}, numbers.parse_number)
    check(spark, {"1.005": 1.0, "2.675": 2.68, "0.125": 0.13, "24": 24.0},
          lambda x: numbers.round_half_away(x.cast("double")))
    check(spark, {"24.0": "24", "25.5": "25.5", "0.126": "0.13", "100": "100"}, lambda x: numbers.show_two(x.cast("double")))


def test_freshness(spark):
    check(spark, {"2026-09-01": "Current", "2026-04-01": "Current", "2026-03-01": "ReviewRecommended",
                  "2025-10-01": "ReviewRecommended", "2025-09-01": "PossiblyOutdated", "2019-01-01": "PossiblyOutdated",
                  "soon": "Unknown"}, lambda x: dates.freshness(x, "2026-09-03"))
    # Month ends: six whole months are not reached on 28 February.
    check(spark, {"2025-08-31": 5}, lambda x: dates.whole_months(dates.parse_day(x), dates.as_day("2026-02-28")))


def test_pointers(spark):
    check(spark, {"nutrition[0].values.x": "/nutrition/0/values/x", "a/b~c": "/a~1b~0c", "": ""}, pointers.pointer_of)
    assert results(spark, ["/nutrition/0"], lambda x: pointers.covers(F.lit("/nutrition"), x)) == [True]
    assert results(spark, ["/nutritionist"], lambda x: pointers.covers(F.lit("/nutrition"), x)) == [False]
    doc = F.parse_json(F.lit('{"a":{"b":null},"c":[1,2]}'))
    check(spark, {"/a/b": True, "/c/1": True, "/c/2": False, "/a/x": False}, lambda x: pointers.resolves(doc, x))


@pytest.mark.parametrize("typed, terms", [
    ("parle's", ["parles"]), ("parle AND", ["parle", "and"]), ('"unclosed', ["unclosed"]), ("*", []), ("()", []),
    ("Nestlé  kit", ["nestle", "kit"]),
])
def test_search_terms(one, typed, terms):
    assert one(lambda: search.search_terms(F.col("q")), q=typed) == terms


def test_phrase_text(one):
    assert one(lambda: phrases.normalise(phrases.fold(F.col("x"))), x=" Oléine d'huile  (25%)") == "oleine d huile 25%"
