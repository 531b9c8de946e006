"""Shared pieces: tables in the cluster's shared folder, splits of hot groups, word arrays."""

import contextlib
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F


def shared_dir(spark):
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session, as in tests, may leave it unset; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark, name):
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/larder-{uuid.uuid4().hex}/{name}"


def stored(df, name):
    """df, written to the shared folder and read again: its lineage ends at the files."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark, rows):
    """While it holds, Arrow batches have few rows: a batch is bounded by rows, and texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def packed(docs):
    """docs as a struct `_row` beside doc_id, source and text where docs has them.

    Operators that return whole rows join on columns of their own next to `_row`, so no
    column of docs clashes with theirs; `_row.*` gives the rows back.
    """
    own = [c for c in ("doc_id", "source") if c in docs.columns]
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        *own,
        F.xxhash64("text").alias("text_hash"),
    )


def one_of_each(docs, found):
    """docs with one row for each component of found (doc_id, text_hash, component).

    The row with the smallest doc_id stays, null last, then that with the smallest hash of its
    text; of rows equal in both, one.  Columns as in docs.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keep = found.groupBy("component").agg(F.min(rank).alias("first")).select(
        F.col("first.doc_id").alias("_keep"), F.col("first.text_hash").alias("_hash")
    )
    rows = packed(docs)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("text_hash") == F.col("_hash"))
    kept = rows.join(keep.distinct(), same)
    # Only rows equal in both meet in a window, and each task keeps one of them before the exchange.
    once = Window.partitionBy("doc_id", "text_hash").orderBy(*[c for c in ("source",) if c in docs.columns] or ["doc_id"])
    return kept.withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row.*")


def running_sum(df, keys, chunk, order, value, into):
    """Adds the sum of value over all earlier rows of the same keys, hot keys split.

    chunk must grow with the order, so the rows of a chunk follow those of earlier ones.  A
    task sorts one chunk; only one sum a chunk is ordered by key.  df is read twice.
    """
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    starts = sums.select(
        *keys,
        chunk,
        F.coalesce(
            F.sum("_sum").over(before.partitionBy(*keys).orderBy(chunk)), F.lit(0)
        ).alias("_start"),
    )
    inside = before.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.join(starts, [*keys, chunk])
        .withColumn(
            into,
            F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)),
        )
        .drop("_start")
    )


def lower_ascii(text):
    """A-Z lower-cased, all else as it is; null is empty."""
    return F.translate(
        F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def words_of(text, separators):
    """The non-empty pieces of text between runs of separators (a character class)."""
    return F.array_remove(F.split(text, f"[{separators}]+"), "")


def gram_hash(words, start, offsets):
    """Hash of the words at the offsets from a zero-based start."""
    return F.xxhash64(*[F.get(words, start + F.lit(o)) for o in offsets])
