"""Run registered queries against their SQL: python -m checks.compare [sf_dir] [names...]."""

import math
import os
import sys
import time

import duckdb

from checks.bindings import TABLES
from checks.registry import ORACLES, QUERIES


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value) if isinstance(value, bool) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """(rows, problem, seconds) of one query."""
    begin = time.time()
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    seconds = time.time() - begin
    if name not in ORACLES:
        return len(mine), None, seconds
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(mine), f"columns {sorted(df.columns)} / {sorted(names)}", seconds
    if mine != theirs:
        lost = sorted(set(theirs) - set(mine))[:2]
        extra = sorted(set(mine) - set(theirs))[:2]
        return len(mine), f"{len(mine)}/{len(theirs)} rows; only spark {extra}; only sql {lost}", seconds
    return len(mine), None, seconds


def main(arguments):
    from larder.session import local_session

    import checks.all  # noqa: F401  registers everything

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    wanted = arguments[1:] or list(QUERIES)
    spark = local_session(int(os.environ.get("CPUS", "8")))
    con = duck(sf_dir)
    bad = 0
    for name in wanted:
        try:
            count, problem, seconds = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            con = duck(sf_dir)
            count, problem, seconds = 0, f"{type(error).__name__}: {str(error)[:900]}", 0
        bad += problem is not None
        label = "ok" if problem is None else "FAIL"
        kind = "D" if name in ORACLES else "R"
        print(f"{label:4} {kind} {name:26} {count:8} {seconds:6.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
