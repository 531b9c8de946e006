"""Peer cut-offs kept up to date by batches of changes.

A view is a folder with three tables of batches.  `deltas` holds by how much a batch changed
the number of panels with a figure; a record that changed or went takes its old figures back.
`base` holds, every so many batches, all counts, so a batch reads one base and the few deltas
after it and never the records.  `stats` holds the cut-offs after each batch: those of groups
that the batch touched are computed anew, all others are carried over.  A batch reads only
batches before it and replaces its own output, so it may be repeated.
"""

from pyspark.sql import functions as F

from larder.operators.peers import GROUP, cut_offs, peer_values

DELTAS = "category_id string, basis string, nutrient string, value double, n bigint"
STATS = (
    "category_id string, basis string, nutrient string, peer_count bigint, lower_value double, "
    "higher_value double, rule_id string, rule_version string"
)
FOLD_EVERY = 16


def batch_changes(log, batch, key="gtin"):
    """(before, after): rows of the records that a batch of the log wrote, as they were and as they are.

    log: key, batch, deleted and what a record holds; a record may be several rows of one batch.
    Records without a key are left out.  Earlier rows are looked up for the batch's keys alone,
    by their number of batch first, so whole rows travel only when they are the last ones.
    """
    now = log.where((F.col("batch") == batch) & F.col(key).isNotNull())
    earlier = log.where(F.col("batch") < batch)
    last = (
        earlier.select(key, "batch")
        .join(now.select(key).distinct(), key, "left_semi")
        .groupBy(key)
        .agg(F.max("batch").alias("batch"))
    )
    live = ~F.coalesce("deleted", F.lit(False))
    return earlier.join(last, [key, "batch"], "left_semi").where(live), now.where(live)


def count_deltas(before, after, nutrients):
    """The group columns, value, n: by how much the panels with a figure grew; zero is left out."""
    gone = peer_values(before, nutrients).withColumn("n", F.lit(-1).cast("long"))
    come = peer_values(after, nutrients).withColumn("n", F.lit(1).cast("long"))
    return _summed(gone.unionByName(come))


def _summed(counts):
    return counts.groupBy(*GROUP, "value").agg(F.sum("n").alias("n")).where("n != 0")


def _read(spark, root, name, schema):
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def _write(df, root, name, batch):
    df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def _last_batch(table, before):
    """The last batch before a number, -1 when there is none: one number, of the folders' names."""
    last = table.where(F.col("batch") < before).agg(F.max("batch")).first()[0]
    return -1 if last is None else last


def update(spark, root, batch, before, after, rule, fold_every=FOLD_EVERY):
    """Takes a batch's changes into the view at root.

    before, after: panels (category_id, basis, a column per nutrient) of the changed records.
    rule: nutrients and the arguments of cut_offs.
    """
    rule = dict(rule)
    nutrients = rule.pop("nutrients")
    _write(count_deltas(before, after, nutrients), root, "deltas", batch)
    deltas, bases = _read(spark, root, "deltas", DELTAS), _read(spark, root, "base", DELTAS)
    folded = _last_batch(bases, batch)
    since = deltas.where((F.col("batch") > folded) & (F.col("batch") <= batch))
    counts = bases.where(F.col("batch") == folded).unionByName(since).drop("batch")
    touched = deltas.where(F.col("batch") == batch).select(*GROUP).distinct()
    fresh = cut_offs(_summed(counts.join(touched, GROUP, "left_semi")), **rule)
    kept = cut_off_view(spark, root, batch).join(touched, GROUP, "left_anti")
    _write(kept.unionByName(fresh), root, "stats", batch)
    if batch - folded >= fold_every:
        _write(_summed(counts), root, "base", batch)


def cut_off_view(spark, root, before=None):
    """The cut-offs after the last batch, or after the last one before a batch number."""
    stats = _read(spark, root, "stats", STATS)
    last = _last_batch(stats, 2**62 if before is None else before)
    return stats.where(F.col("batch") == last).drop("batch")
