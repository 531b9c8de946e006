"""Which of several sources' values to show: votes weighed by how far a source agrees with others.

Nothing is averaged and no value is dropped: every claimed value stays a row with its support.
"""

from pyspark.sql import functions as F

from larder.operators.sizes import broadcast_if_small, written

# Source types from most to least authoritative: fixed values.
AUTHORITY = ("packaging", "manufacturer", "regulator", "open_database", "retailer", "community")
UNIT = 1000
STRENGTH = 10


def authority(kind):
    """Rank of a source type, 6 for the strongest to 1; 0 for any other."""
    rank = F.lit(0)
    for i, name in enumerate(AUTHORITY):
        rank = F.when(kind == name, F.lit(len(AUTHORITY) - i)).otherwise(rank)
    return rank


def votes(claims):
    """key, path, value, source, rank: each source's claim of a value, once.

    Claims without a key, path, value or source say nothing and are left out.  A source of
    several types counts as its strongest.
    """
    said = claims.where("key is not null and path is not null and value is not null and source is not null")
    return said.groupBy("key", "path", "value", "source").agg(F.max(authority(F.col("type"))).alias("rank"))


def initial_weights(votes):
    """source, prior, weight: the authority rank as a share of the strongest, in thousandths."""
    prior = F.floor(F.lit(UNIT) * F.max("rank") / F.lit(len(AUTHORITY))).cast("long")
    return votes.groupBy("source").agg(prior.alias("prior")).withColumn("weight", F.col("prior"))


def supported(votes, weights):
    """key, path, value, support, rank, n_sources, chosen: all values of an item, one of them chosen.

    The value with most support is chosen; of equal ones that of the stronger type, then the
    smaller value.
    """
    voted = votes.join(broadcast_if_small(weights.select("source", "weight")), "source")
    values = voted.groupBy("key", "path", "value").agg(
        F.sum("weight").alias("support"), F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n_sources")
    )
    values = written(values)
    # The largest by support and rank, then the smallest value: two partial maxima, no sort of an item.
    best = values.groupBy("key", "path").agg(
        F.max(F.struct("support", "rank")).alias("most")
    )
    near = values.join(best, ["key", "path"]).where(
        (F.col("support") == F.col("most.support")) & (F.col("rank") == F.col("most.rank"))
    )
    first = near.groupBy("key", "path").agg(F.min("value").alias("chosen_value"))
    return values.join(first, ["key", "path"]).select(
        "key", "path", "value", "support", "rank", "n_sources", (F.col("value") == F.col("chosen_value")).alias("chosen")
    )


def next_weights(votes, values, weights, strength=STRENGTH):
    """Weights by agreement: the share of a source's items whose chosen value it claims.

    The prior counts like `strength` items.  Only items that several values contest count, so
    a source that nobody contradicts keeps its prior.
    """
    contested = values.groupBy("key", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "path")
    judged = votes.join(contested, ["key", "path"]).join(
        values.select("key", "path", "value", "chosen"), ["key", "path", "value"]
    )
    record = judged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("chosen").alias("agreed")
    )
    n, agreed = F.coalesce("n", F.lit(0)), F.coalesce("agreed", F.lit(0))
    share = F.floor((F.lit(strength) * F.col("prior") + F.lit(UNIT) * agreed) / (F.lit(strength) + n)).cast("long")
    return weights.select("source", "prior").join(record, "source", "left").select("source", "prior", share.alias("weight"))


def resolve(claims, rounds=10, settled=0, strength=STRENGTH):
    """key, path, value, support, rank, n_sources, chosen, resolution: every claimed value, judged.

    claims: key, path, source, type, value.  Weights start from the authority of the source's
    type and follow agreement, round by round, until no weight moves by more than `settled`
    thousandths or the rounds are over.  resolution is `agreed` where one value is claimed,
    `chosen` where the chosen one has more support than any other, else `unresolved`.
    """
    said = written(votes(claims))
    weights = written(initial_weights(said))
    values = supported(said, weights)
    for _ in range(rounds):
        values = written(values)
        after = written(next_weights(said, values, weights, strength))
        moved = after.join(weights.select("source", F.col("weight").alias("before")), "source").agg(
            F.max(F.abs(F.col("weight") - F.col("before")))
        ).first()[0]
        if (moved or 0) <= settled:
            break
        weights = after
        values = supported(said, weights)
    others = values.groupBy("key", "path").agg(
        F.count(F.lit(1)).alias("n"), F.max("support").alias("most"),
        F.max(F.when(~F.col("chosen"), F.col("support"))).alias("second"),
    )
    resolution = F.when(F.col("n") == 1, "agreed").when(F.col("most") > F.col("second"), "chosen").otherwise("unresolved")
    return values.join(others, ["key", "path"]).select(
        "key", "path", "value", "support", "rank", "n_sources", "chosen", resolution.alias("resolution")
    )
