"""Reading panels: declared fields, long form and comparable basis."""

from pyspark.sql import functions as F

from larder.vocab import NUTRIENT_IDS, NUTRIENTS


def declared_fields(values):
    """Names of the nutrients that hold a value, in panel order."""
    return F.array_compact(
        F.array(*[F.when(values[n].isNotNull(), F.lit(n)) for n in NUTRIENT_IDS])
    )


def declared_count(values):
    return sum(values[n].isNotNull().cast("int") for n in NUTRIENT_IDS)


def display_name(nutrient):
    names = [(n, shown) for n, shown, _ in NUTRIENTS] + [("salt_g", "Salt")]
    return _lookup(nutrient, names).otherwise(nutrient)


def unit_of(nutrient):
    return _lookup(nutrient, [(n, u) for n, _, u in NUTRIENTS if u != "g"]).otherwise(F.lit("g"))


def _lookup(column, pairs):
    chain = F
    for key, value in pairs:
        chain = chain.when(column == key, F.lit(value))
    return chain


def panel_order(nutrient):
    return _lookup(nutrient, [(n, i) for i, n in enumerate(NUTRIENT_IDS)])


def long_values(values):
    """array<struct<nutrient, value>> in panel order, for one explode."""
    return F.array(
        *[F.struct(F.lit(n).alias("nutrient"), values[n].alias("value")) for n in NUTRIENT_IDS]
    )


def in_base_unit(value, unit):
    """Grams or millilitres; null for pieces."""
    return F.when(unit.isin("g", "ml"), value).when(unit.isin("kg", "l"), value * 1000)


def comparable_basis(basis, serving_value, serving_unit, serving_description):
    """struct<basis, form, factor, calculated, serving_description, serving_amount>.

    Per-100 panels keep their figures; a per-serving panel with a mass or volume is
    scaled by 100 / amount and marked calculated; anything else gives null.
    """
    amount = in_base_unit(serving_value, serving_unit)
    liquid = serving_unit.isin("ml", "l")

    def result(to_basis, form, factor, calculated, described, serving):
        return F.struct(
            to_basis.alias("basis"),
            form.alias("form"),
            factor.cast("double").alias("factor"),
            F.lit(calculated).alias("calculated"),
            described.cast("string").alias("serving_description"),
            serving.cast("double").alias("serving_amount"),
        )

    nothing = F.lit(None)
    scaled = F.struct(
        F.when(liquid, "per_100ml").otherwise("per_100g").alias("basis"),
        F.when(liquid, "drink").otherwise("food").alias("form"),
        (100.0 / amount).alias("factor"),
        F.lit(True).alias("calculated"),
        serving_description.alias("serving_description"),
        amount.alias("serving_amount"),
    )
    return (
        F.when(
            basis == "per_100g",
            result(F.lit("per_100g"), F.lit("food"), F.lit(1.0), False, nothing, F.when(~liquid, amount)),
        )
        .when(
            basis == "per_100ml",
            result(F.lit("per_100ml"), F.lit("drink"), F.lit(1.0), False, nothing, F.when(liquid, amount)),
        )
        .when((basis == "per_serving") & (amount > 0), scaled)
    )
