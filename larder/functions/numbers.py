"""Tolerant parsing, exact rounding and number formatting."""

from pyspark.sql import functions as F

# A number that is not negative; minus zero is.
NUMBER = (
    r"^[\t-\r ]*([+]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|-(0+\.?0*|\.0+)([eE][+-]?\d+)?)[\t-\r ]*$"
)


def parse_number(text):
    """A double, or null when unparsable, negative or infinite.

    The pattern comes first because a cast also takes '5d', 'NaN' and 'Infinity'.  It
    also settles the sign, so the value is worked out once.
    """
    value = F.when(text.rlike(NUMBER), F.btrim(text, F.lit("\t\n\x0b\x0c\r ")).try_cast("double"))
    return F.nullif(value, F.lit(float("inf")))


def round_half_away(value):
    """Two decimals, halves away from zero, decided on the scaled double.

    Not F.round: that works on the decimal text and gives 1.01 for 1.005.
    """
    scaled = F.abs(value) * 100
    whole = F.floor(scaled)
    rounded = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 100
    return F.when(F.abs(value) < 1e16, F.signum(value) * rounded).otherwise(value)


def show_two(value):
    """At most two decimals, no trailing zeros: 24.0 gives '24'."""
    return _show(round_half_away(value), 2)


def show_one(value):
    return _show(value, 1)


def show_whole(value):
    return _show(value, 0)


def _show(value, digits):
    exact = F.round(value.cast("decimal(30,10)"), digits).cast(f"decimal(30,{digits})").cast("string")
    if digits == 0:
        return exact
    return F.rtrim(F.rtrim(exact, F.lit("0")), F.lit("."))
