"""Ingredient trees held as JSON text."""

from pyspark.sql import functions as F

NODE = "array<struct<raw:string,canonical:string,percentage:double,children:string>>"
FLAT = "array<struct<path:array<int>,raw:string,canonical:string,percentage:double,children:string>>"


def _children(path, text):
    """Direct children of a node, with their path; grandchildren stay text."""
    return F.transform(
        F.from_json(text, NODE),
        lambda c, i: F.named_struct(
            F.lit("path"), F.concat(path, F.array(i)),
            F.lit("raw"), c["raw"],
            F.lit("canonical"), c["canonical"],
            F.lit("percentage"), c["percentage"],
            F.lit("children"), c["children"],
        ),
    )


def tree_nodes(text):
    """All nodes of a tree in pre-order, as an array, at any depth.

    The frontier moves down one level per step until it is empty; a tree cannot be deeper
    than its number of '['.  Arrays of positions sort in pre-order.  Row-local: no join, no
    shuffle.
    """
    none = F.array().cast(FLAT)
    root = F.array().cast("array<int>")
    levels = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    start = F.named_struct(
        F.lit("front"), F.coalesce(_children(root, text), none).cast(FLAT), F.lit("done"), none
    )

    def descend(state, _):
        below = F.flatten(
            F.transform(
                F.filter(state["front"], lambda n: n["children"].isNotNull()),
                lambda n: F.coalesce(_children(n["path"], n["children"]), none),
            )
        )
        deeper = F.named_struct(
            F.lit("front"), below.cast(FLAT),
            F.lit("done"), F.concat(state["done"], state["front"]).cast(FLAT),
        )
        return F.when(F.size(state["front"]) == 0, state).otherwise(deeper)

    walk = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, descend)
    return F.when(text.isNotNull(), F.array_sort(walk["done"]))


def parent_path(path):
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def level_pointer(path):
    """JSON pointer of the list that holds the children of a path."""
    inner = F.array_join(F.transform(path, lambda i: i.cast("string")), "/children/")
    return F.when(F.size(path) == 0, "/ingredients").otherwise(
        F.concat(F.lit("/ingredients/"), inner, F.lit("/children"))
    )


def node_pointer(path):
    return F.concat(F.lit("/ingredients/"), F.array_join(path.cast("array<string>"), "/children/"))


def flatten_ingredients(products, key="gtin", tree="ingredients"):
    """One row per tree node: key, ordinal, parent_ordinal, raw, canonical_id, percentage, pointer."""
    nodes = products.where(F.col(tree).isNotNull()).select(key, tree_nodes(F.col(tree)).alias("_nodes"))
    paths = nodes.select(key, "_nodes", F.col("_nodes.path").alias("_paths"))
    rows = paths.select(key, "_paths", F.posexplode_outer("_nodes").alias("ordinal", "_n")).where(
        F.col("_n").isNotNull()
    )
    parent = F.array_position(F.col("_paths"), parent_path(F.col("_n.path"))) - 1
    return rows.select(
        key,
        "ordinal",
        F.when(F.size("_n.path") > 1, parent.cast("int")).alias("parent_ordinal"),
        F.col("_n.raw").alias("raw"),
        F.col("_n.canonical").alias("canonical_id"),
        F.col("_n.percentage").alias("percentage"),
        node_pointer(F.col("_n.path")).alias("pointer"),
    )


def level_totals(nodes):
    """array<struct<pointer, total>>: declared percentages of every list of a tree's nodes."""

    def total(parent):
        shares = F.transform(
            F.filter(nodes, lambda n: parent_path(n["path"]) == parent),
            lambda n: F.coalesce(n["percentage"], F.lit(0.0)),
        )
        return F.struct(
            level_pointer(parent).alias("pointer"),
            F.aggregate(shares, F.lit(0.0), lambda a, b: a + b).alias("total"),
        )

    parents = F.array_distinct(F.transform(nodes, lambda n: parent_path(n["path"])))
    return F.transform(parents, total)
