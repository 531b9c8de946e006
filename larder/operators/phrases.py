"""Which dictionary phrases a label text names.

Longest phrase first, whole words only, and a phrase claims the words it stands on.  The
flags that make a phrase definite or possible are arguments.
"""

from pyspark.sql import functions as F

from larder.functions.numbers import show_two
from larder.functions.text import strip
from larder.operators.ingredients import tree_nodes
from larder.operators.sizes import broadcast_if_small
from larder.vocab import PHRASE_ACCENTS

# Fixed value: what parts an ingredient statement into segments.
SEPARATORS = r"[,;()\[\]{}•|\n]+"
NO_SHARES = "array<struct<canonical:string,percentage:double>>"


def fold(text):
    return F.translate(F.lower(text), *PHRASE_ACCENTS)


def normalise(folded):
    """Words of a-z, 0-9, % and full stop, one space apart."""
    return F.btrim(F.regexp_replace(folded, "[^a-z0-9%.]+", " "))


def alias_table(dictionary):
    """Phrases of a dictionary: alias, ordinal, position, id, name, flags, size.

    dictionary: ordinal, id, name, aliases, flags.  The name is the last alias of its
    entry; an alias that several entries share belongs to the first.
    """
    spoken = F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))
    listed = dictionary.select("ordinal", "id", "name", "flags", F.posexplode(spoken).alias("position", "alias"))
    entry = F.struct("ordinal", "position", "id", "name", "flags")
    return (
        listed.withColumn("alias", normalise(fold(F.col("alias"))))
        .where(F.col("alias") != "")
        .groupBy("alias")
        .agg(F.min(entry).alias("e"))
        .select("alias", "e.*", F.length("alias").alias("size"))
    )


def alias_order(aliases):
    """Longest first, then dictionary order."""
    return aliases.orderBy(F.desc("size"), "ordinal", "position")


def _claims(candidates):
    """Candidates in claim order, less those that overlap an earlier claim."""

    def free(taken, x):
        return ~F.exists(
            taken,
            lambda c: (x["start"] < c["start"] + c["words"]) & (x["start"] + x["words"] > c["start"]),
        )

    return F.aggregate(
        F.array_sort(candidates),
        F.slice(candidates, F.lit(1), F.lit(0)),
        lambda taken, x: F.when(free(taken, x), F.concat(taken, F.array(x))).otherwise(taken),
    )


def claimed_phrases(
    texts, dictionary, key, text, definite="palm_derived", possible="may_be_palm_derived", tree=None
):
    """One row per text: key, blank, percent_text, shares, matches.

    Each text is read once.  Its segments are exploded to words, joined to the phrases that
    begin with them; only then are the words that follow compared.  Every text also sends one empty word, matched by an empty phrase, so that
    texts without a hit stay in the result.  Hits are exchanged once, by key.  Only texts
    with a percentage travel with their hits.
    """
    flagged = (
        F.when(F.array_contains("flags", F.lit(definite)), "definite").when(
            F.array_contains("flags", F.lit(possible)), "possible"
        )
    )
    aliases = alias_table(dictionary).select(
        "alias",
        F.substring_index("alias", " ", 1).alias("first_word"),
        F.size(F.split("alias", " ")).alias("words"),
        (-F.col("size")).alias("shortness"),
        "ordinal",
        "position",
        "id",
        "name",
        flagged.alias("kind"),
    )
    nothing = texts.sparkSession.createDataFrame(
        [("", "", 1, 0, 0, 0, "", "", None)], aliases.schema
    )

    body = F.col(text)
    folded = fold(body)
    whole = normalise(folded)
    no_shares = F.array().cast(NO_SHARES)
    shares = no_shares
    if tree is not None:
        stated = F.filter(tree_nodes(F.col(tree)), lambda n: n["percentage"].isNotNull())
        shares = F.when(
            F.col(tree).contains('"percentage"'),
            F.transform(
                stated,
                lambda n: F.named_struct(
                    F.lit("canonical"), n["canonical"], F.lit("percentage"), n["percentage"]
                ),
            ),
        ).otherwise(no_shares).cast(NO_SHARES)
    about = F.named_struct(
        F.lit("blank"), F.coalesce(strip(body) == "", F.lit(True)),
        F.lit("percent_text"), F.when(whole.rlike(r"[0-9]\s*%"), whole),
        F.lit("shares"), F.coalesce(shares, no_shares),
    )
    segments = F.concat(F.array(F.lit("")), F.coalesce(F.split(folded, SEPARATORS), F.array().cast("array<string>")))
    # The outer explodes keep Spark from inferring a size filter that splits the text twice.
    words = (
        texts.select(F.col(key).alias("_key"), about.alias("_about"), F.posexplode_outer(segments).alias("segment", "_text"))
        .select(
            "_key",
            "segment",
            F.when(F.col("segment") == 0, F.col("_about")).alias("about"),
            F.when(F.col("segment") == 0, F.array(F.lit("")))
            .otherwise(F.array_remove(F.split(normalise(F.col("_text")), " "), ""))
            .alias("_words"),
        )
        .select("_key", "segment", "about", "_words", F.posexplode_outer("_words").alias("start", "first_word"))
    )
    # The words ahead are put together only where a phrase begins with this word.
    ahead = F.array_join(F.slice("_words", F.col("start") + 1, F.col("words")), " ")
    known = broadcast_if_small(aliases.unionByName(nothing))
    same_first = words["first_word"] == known["first_word"]
    hits = words.join(known, same_first & (ahead == F.col("alias"))).drop("first_word", "_words")

    # Everything below is grouped on the key or finer, so it shares one exchange.
    fields = ["shortness", "ordinal", "position", "words", "alias", "id", "name", "kind"]
    firsts = hits.repartition("_key").groupBy("_key", "segment", "about", *fields).agg(F.min("start").alias("start"))
    claimed = (
        firsts.groupBy("_key", "segment")
        .agg(
            F.max("about").alias("about"),
            F.collect_list(F.struct("shortness", "ordinal", "position", "start", "words", "alias", "id", "name", "kind"))
            .alias("candidates"),
        )
        .select(
            "_key",
            "about",
            F.struct(
                "segment", F.filter(_claims(F.col("candidates")), lambda c: c["kind"].isNotNull()).alias("found")
            ).alias("claims"),
        )
    )
    listed = F.flatten(
        F.transform(
            F.array_sort(F.collect_list("claims")),
            lambda s: F.transform(
                s["found"],
                lambda c: F.struct(
                    s["segment"].alias("segment"), c["start"].alias("start"), c["alias"].alias("alias"),
                    c["id"].alias("id"), c["name"].alias("name"), c["kind"].alias("kind"),
                ),
            ),
        )
    )
    return (
        claimed.groupBy("_key")
        .agg(F.max("about").alias("about"), listed.alias("matches"))
        .select(F.col("_key").alias(key), "about.*", "matches")
    )


def _percentage(match, percent_text, shares):
    """Declared share of a match: from the parsed tree, else printed right after the phrase."""
    of_tree = F.get(F.filter(shares, lambda s: s["canonical"] == match["id"]), F.lit(0))["percentage"]
    quoted = F.replace(
        F.replace(match["alias"], F.lit("."), F.lit("\\.")), F.lit(" "), F.lit("[^a-z0-9]+")
    )
    # Fixed value: a share printed right after the phrase.
    pattern = F.concat(quoted, F.lit(r"[^a-z0-9%]{0,3}(\d{1,3}(?:\.\d+)?)\s*%"))
    printed = F.nullif(F.call_function("regexp_extract", percent_text, pattern, F.lit(1)), F.lit("")).try_cast("double")
    return F.coalesce(of_tree, F.when((printed > 0) & (printed <= 100), printed))


def with_percentages(claimed):
    """Adds the declared percentage to every match."""
    return claimed.withColumn(
        "matches",
        F.transform(
            "matches",
            lambda m: m.withField("percentage", _percentage(m, F.col("percent_text"), F.col("shares"))),
        ),
    )


def phrase_matches(claimed, key):
    """One row per flagged match."""
    return claimed.select(key, F.explode("matches").alias("m")).select(key, "m.*")


def detect(claimed, key):
    """State and sentence per text, from claimed_phrases."""
    judged = with_percentages(claimed).select(
        key,
        "blank",
        F.filter("matches", lambda m: m["kind"] == "definite").alias("definite"),
        F.filter("matches", lambda m: m["kind"] == "possible").alias("possible"),
    )
    stated = F.get(F.filter("definite", lambda m: m["percentage"].isNotNull()), F.lit(0))
    judged = judged.withColumn("reported", F.coalesce(stated, F.get("definite", F.lit(0)))).withColumn(
        "maybe", F.get("possible", F.lit(0))
    )
    state = (
        F.when(F.col("blank"), "NoIngredients")
        .when(F.col("reported.percentage").isNotNull(), "ConfirmedQuantity")
        .when(F.col("reported").isNotNull(), "Present")
        .when(F.col("maybe").isNotNull(), "Unknown")
        .otherwise("NotDetected")
    )
    return judged.withColumn("state", state).select(
        key,
        "state",
        F.size("definite").alias("definite_count"),
        F.size("possible").alias("possible_count"),
        F.col("reported.id").alias("reported_id"),
        F.col("reported.percentage").alias("percentage"),
        _statement().alias("statement"),
    )


def _statement():
    """One sentence per state."""
    name = F.lower("reported.name")
    return (
        F.when(
            F.col("state") == "ConfirmedQuantity",
            F.format_string(
                "Contains %s, declared as %s%% on the label.", name, show_two(F.col("reported.percentage"))
            ),
        )
        .when(
            F.col("state") == "Present",
            F.format_string("Contains %s. The label does not say how much.", name),
        )
        .when(
            F.col("state") == "Unknown",
            F.format_string(
                "The label lists %s. That wording does not say whether palm was used.", F.col("maybe.alias")
            ),
        )
        .when(
            F.col("state") == "NotDetected",
            "No palm-derived ingredient is named in the ingredients we hold. "
            "That is what the list says, not a guarantee about the product.",
        )
        .otherwise("There is no ingredient list for this product yet.")
    )
