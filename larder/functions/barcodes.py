"""Barcode check digits, canonical keys, shards and scanned codes."""

from pyspark.sql import functions as F

from larder.functions.text import strip

PLAIN_DIGITS = 14
GROUP_SEPARATOR = "\x1d"


def _weighted_sum(digits, even, odd):
    """Sum of digits times weights by position from the right."""
    # Counted in integers; the generated code casts the digits once.
    number = digits.try_cast("bigint")
    plain = sum(
        (F.call_function("div", number, F.lit(10**i)) % 10) * (even if i % 2 == 0 else odd)
        for i in range(PLAIN_DIGITS)
    )
    longer = F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
            lambda d, i: d.try_cast("bigint") * F.when(i % 2 == 0, even).otherwise(odd),
        ),
        F.lit(0).cast("bigint"),
        lambda a, b: a + b,
    )
    return F.when(F.length(digits) <= PLAIN_DIGITS, plain).otherwise(longer)


def check_digit(body):
    """GS1 check digit of a digit string; weights 3,1,3,1... from the right."""
    return F.when(body.rlike("^[0-9]+$"), ((10 - _weighted_sum(body, 3, 1) % 10) % 10).cast("int"))


def has_valid_check_digit(code):
    """At least 8 ASCII digits whose weighted sum, check digit included, is a multiple of ten.

    Never null.
    """
    return F.coalesce(code.rlike("^[0-9]{8,}$") & (_weighted_sum(code, 1, 3) % 10 == 0), F.lit(False))


def normalize_gtin(code):
    """14-digit key of a printed code, or null when it is not a barcode."""
    plain = strip(code)
    ok = F.length(plain).between(8, 14) & has_valid_check_digit(plain)
    return F.when(ok, F.lpad(plain, 14, "0"))


def gtin_shard(gtin):
    """First three significant digits of a key, padded when shorter."""
    significant = F.ltrim(gtin, F.lit("0"))
    return F.when(
        gtin.rlike("^[0-9]{14}$"), F.lpad(F.substring(significant, 1, 3), 3, "0")
    )


def record_path(gtin):
    return F.concat(F.lit("products/"), gtin_shard(gtin), F.lit("/"), gtin, F.lit(".json"))


def format_from_length(printed):
    size = F.length(printed)
    return (
        F.when(size == 8, "EAN-8").when(size == 12, "UPC-A").when(size == 14, "GTIN-14").otherwise("EAN-13")
    )


def expected_length(barcode_format):
    """Digits a format prints; null for UPC-E, which varies."""
    return (
        F.when(barcode_format == "EAN-13", 13)
        .when(barcode_format == "EAN-8", 8)
        .when(barcode_format == "UPC-A", 12)
        .when(barcode_format.isin("GTIN-14", "ITF-14"), 14)
    )


def _element_string_gtin(text):
    """Key inside a GS1 element string such as (01)08901719134845."""
    plain = F.translate(text, "()" + GROUP_SEPARATOR, "")
    plain = F.when(
        plain.startswith("]") & (F.length(plain) > 3), F.substring(plain, 4, 1_000_000)
    ).otherwise(plain)
    candidate = F.substring(plain, 3, 14)
    return F.when(
        plain.startswith("01") & candidate.rlike("^[0-9]{14}$"), normalize_gtin(candidate)
    )


def scanned_gtin(raw):
    text = strip(raw)
    return F.coalesce(normalize_gtin(text), _element_string_gtin(text))


def scan_kind(raw, gtin=None):
    """Product, Empty, BadCheckDigit or NotAProduct.  gtin is the scanned key when known."""
    text = strip(raw)
    found = scanned_gtin(raw) if gtin is None else gtin
    return (
        F.when(found.isNotNull(), "Product")
        .when(text.isNull() | (text == ""), "Empty")
        .when(text.rlike("^[0-9]{8,14}$"), "BadCheckDigit")
        .otherwise("NotAProduct")
    )


def scan_message(raw, kind):
    """What to tell the person who scanned; empty for a product."""
    link = F.lower(strip(raw)).rlike("^(http|https|upi)://")
    # One sentence per kind.
    return (
        F.when(
            kind == "BadCheckDigit",
            "That did not read as a valid barcode. Try again, holding the packet flat and steady.",
        )
        .when(
            (kind == "NotAProduct") & link,
            "That is a web link, not a product barcode. Scan the barcode with the black bars instead.",
        )
        .when(
            kind == "NotAProduct",
            "That is a code of some kind, but not a product barcode. "
            "Look for the one with black bars and digits underneath.",
        )
        .when(kind == "Empty", "Nothing was read.")
        .otherwise("")
    )
