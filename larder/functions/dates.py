"""Freshness and verification dates."""

from pyspark.sql import functions as F


def as_day(value):
    """A date column from a 'yyyy-MM-dd' argument, date or column."""
    return value if hasattr(value, "cast") else F.lit(str(value)).cast("date")


def parse_day(text):
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def whole_months(earlier, later):
    """Calendar months between two dates, one less when the day is not reached.

    Not months_between: that treats month ends as equal.
    """
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    return months - F.when(F.dayofmonth(later) < F.dayofmonth(earlier), 1).otherwise(0)


def freshness(last_verified, today, review_after=6, outdated_after=12):
    checked = parse_day(last_verified)
    months = whole_months(checked, as_day(today))
    return (
        F.when(checked.isNull(), "Unknown")
        .when(months < review_after, "Current")
        .when(months < outdated_after, "ReviewRecommended")
        .otherwise("PossiblyOutdated")
    )


def freshness_note(last_verified, today, review_after=6, outdated_after=12):
    checked = parse_day(last_verified)
    level = freshness(last_verified, today, review_after, outdated_after)
    shown = F.date_format(checked, "d MMMM yyyy")
    # One sentence per level.
    return (
        F.when(level == "Unknown", "There is no verification date for this record.")
        .when(level == "Current", F.format_string("Last checked %s.", shown))
        .when(
            level == "ReviewRecommended",
            F.format_string(
                "Last checked %s, over six months ago. Formulations change, "
                "so this is worth re-checking against the packet.",
                shown,
            ),
        )
        .otherwise(
            F.format_string(
                "Last checked %s, over a year ago. This may not match what is on the shelf now.", shown
            )
        )
    )
