"""Provenance paths and JSON pointers."""

from pyspark.sql import functions as F


def pointer_of(path):
    """nutrition[0].values.x becomes /nutrition/0/values/x."""
    escaped = F.replace(F.replace(path, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    joined = F.btrim(F.regexp_replace(escaped, r"[.\[\]]+", "/"), F.lit("/"))
    return F.when(joined == "", "").otherwise(F.concat(F.lit("/"), joined))


def covers(ancestor, pointer):
    """True when a pointer equals an ancestor or lies below it."""
    return (ancestor == "") | (ancestor == pointer) | pointer.startswith(F.concat(ancestor, F.lit("/")))


def _member(node, name):
    """The member of that name; a name with a quote has no variant path and is looked up in a map."""
    members = F.try_variant_get(node, "$", "map<string,variant>")
    path = F.concat(F.lit('$["'), name, F.lit('"]'))
    return F.when(name.contains('"'), F.element_at(members, name)).otherwise(
        F.try_variant_get(node, path, "variant")
    )


def _step(node, step):
    """A step of digits is an item of an array, else a member of that name."""
    name = F.replace(F.replace(step, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    item = F.try_variant_get(node, F.concat(F.lit("$["), step, F.lit("]")), "variant")
    member = _member(node, name)
    return F.when(step.rlike("^[0-9]{1,9}$"), F.coalesce(item, member)).otherwise(member)


def resolves(document, pointer):
    """Does the pointer exist in a variant?  A present null exists."""
    steps = F.filter(F.split(pointer, "/"), lambda s: s != "")
    return F.aggregate(steps, document, _step).isNotNull()
