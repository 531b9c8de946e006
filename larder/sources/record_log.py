"""Product records as a log of batches.

Every batch writes only the records it changed, to its own directory, so a micro-batch
costs what it changed and a replayed batch replaces its own output.  A deleted flag marks
a record that was pruned.

Beside the log, in `<root>-runs`, lie runs: the last fingerprint of every key in a stretch of
batches, in order of the key, in small pages and with Bloom filters, so a lookup of few keys
reads few pages.  Runs are merged by size: a stretch of `fan` runs of like size becomes one, so
their number grows with the logarithm of the log and a fingerprint is rewritten as often.  A
list per batch names the runs that hold all batches before it; it is written after them, so a
lost job leaves the list before in force and a repeated batch replaces its own.
"""

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.dedup import last_wins
from larder.schemas import PRODUCT

LOG = f"{PRODUCT}, substance string, deleted boolean"
HEAD = "gtin string, at bigint, substance string, deleted boolean"
RUNS = "lo bigint, hi bigint, rows bigint, merged boolean"
FAN = 4
LOTS = 16
IN_FILTER = "spark.sql.parquet.pushdown.inFilterThreshold"
PAGE_ROWS = 2000


def read_log(spark, root, before=None):
    """Batches of the log, those before a batch number when given."""
    try:
        log = spark.read.schema(f"{LOG}, batch bigint").parquet(root)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{LOG}, batch bigint")
    return log if before is None else log.where(F.col("batch") < before)


def latest_fingerprints(log):
    """gtin, substance, deleted of the last batch that wrote each key.

    Reads three narrow columns and combines them before the exchange.
    """
    last = F.max(F.struct("batch", "substance", "deleted"))
    return log.groupBy("gtin").agg(last.alias("_l")).select("gtin", "_l.substance", "_l.deleted")


def current_records(log):
    return last_wins(log, "gtin", "batch").where(~F.col("deleted")).drop("substance", "deleted", "batch")


def append_batch(changes, root, batch):
    _by_key(changes.sortWithinPartitions("gtin"), f"{root}/batch={batch}")


def _by_key(rows, path):
    writer = rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#gtin", "true")
    writer.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def few_keys(candidates):
    """The keys of a batch small enough to be looked up, in order; None for a larger one.

    At most LOTS times as many as the session pushes down to Parquet in one filter.
    """
    most = LOTS * int(candidates.sparkSession.conf.get(IN_FILTER))
    rows = candidates.where("gtin is not null").select("gtin").limit(most + 1).collect()
    return None if len(rows) > most else sorted({r.gtin for r in rows})


def _listed(spark, root, before):
    """(first batch that no run holds, the runs as tuples), of the last list for `before` or less."""
    try:
        lists = spark.read.schema(f"{RUNS}, upto bigint").parquet(f"{root}-runs/lists")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None, []
    last = lists.where(F.col("upto") <= before).agg(F.max("upto")).first()[0]
    rows = lists.where(F.col("upto") == last).select("lo", "hi", "rows", "merged").collect()
    return last, sorted(tuple(r) for r in rows)


def _heads_of(spark, root, runs, more="false"):
    """Rows of HEAD of some runs, and of the batches of the log for which `more` holds."""
    single = [lo for lo, _, _, merged in runs if not merged]
    heads = read_log(spark, root).where(F.expr(more) | F.col("batch").isin(single)).select(
        "gtin", F.col("batch").alias("at"), "substance", "deleted"
    )
    paths = [_run_path(root, lo, hi) for lo, hi, _, merged in runs if merged]
    return heads.unionByName(spark.read.schema(HEAD).parquet(*paths)) if paths else heads


def _run_path(root, lo, hi):
    return f"{root}-runs/heads/{lo}-{hi}"


def heads(spark, root, before, keys=None):
    """Rows of HEAD from which the last of each key before a batch is taken; of some keys when given.

    Keys are looked up in lots of neighbours, each a filter that Parquet compares with its pages.
    """
    first, runs = _listed(spark, root, before)
    since = f"batch < {before}" if first is None else f"batch >= {first} and batch < {before}"
    rows = _heads_of(spark, root, runs, since)
    if keys is None:
        return rows
    size = max(1, int(spark.conf.get(IN_FILTER)))
    lots = [keys[i : i + size] for i in range(0, len(keys), size)] or [[]]
    return reduce(DataFrame.unionByName, [rows.where(F.col("gtin").isin(lot)) for lot in lots])


def _last(rows):
    last = F.max(F.struct("at", "substance", "deleted"))
    return rows.groupBy("gtin").agg(last.alias("_l")).select("gtin", "_l.*")


def fingerprints(spark, root, before, keys=None):
    """gtin, substance, deleted of the last batch before a number that wrote each key.

    Of pruned keys a row marked deleted or none.  With keys, only pages that may hold them are read.
    """
    return _last(heads(spark, root, before, keys)).drop("at")


def next_merge(sizes, fan=FAN):
    """(start, end) of the runs to be merged next, by their numbers of rows; None when all is well.

    A run joins smaller ones right before it; `fan` runs at the end of like size, by powers of
    `fan`, become one.
    """
    tiers = [int(math.log(max(n, 1), fan) + 1e-9) for n in sizes]
    for j in range(1, len(tiers)):
        if tiers[j - 1] < tiers[j]:
            i = j - 1
            while i > 0 and tiers[i - 1] < tiers[j]:
                i -= 1
            return i, j + 1
    alike = next((k for k, tier in enumerate(reversed(tiers)) if tier != tiers[-1]), len(tiers))
    return (len(tiers) - alike, len(tiers)) if alike >= fan else None


def merge_runs(spark, root, before, fan=FAN):
    """Merges runs of the batches before a number and lists what there is then.  Safe to repeat.

    The driver handles one row a run; batches without changes are no runs.
    """
    first, runs = _listed(spark, root, before)
    new = read_log(spark, root, before)
    new = new if first is None else new.where(F.col("batch") >= first)
    runs = runs + sorted((r.batch, r.batch, r["count"], False) for r in new.groupBy("batch").count().collect())
    while stretch := next_merge([rows for _, _, rows, _ in runs], fan):
        start, end = stretch
        lo, hi = runs[start][0], runs[end - 1][1]
        rows = _last(_heads_of(spark, root, runs[start:end]))
        if start == 0:
            rows = rows.where(~F.col("deleted"))  # nothing older is hidden by them
        path = _run_path(root, lo, hi)
        _by_key(rows.repartitionByRange("gtin").sortWithinPartitions("gtin"), path)
        runs[start:end] = [(lo, hi, spark.read.schema(HEAD).parquet(path).count(), True)]
    spark.createDataFrame(runs, RUNS).coalesce(1).write.mode("overwrite").parquet(f"{root}-runs/lists/upto={before}")


def compact(spark, root, target, upto):
    """A new log whose batch 0 holds the records current before `upto`, plus later batches."""
    log = read_log(spark, root)
    base = last_wins(log.where(F.col("batch") < upto), "gtin", "batch").where(~F.col("deleted"))
    append_batch(base.drop("batch"), target, 0)
    later = log.where(F.col("batch") >= upto)
    later.write.mode("append").partitionBy("batch").parquet(target)
