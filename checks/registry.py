"""Registered queries: name, Spark query, and the SQL that must match it."""

QUERIES = {}
ORACLES = {}


def register(name, query, sql=None):
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql
