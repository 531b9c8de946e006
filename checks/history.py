"""Scans against the catalogue of their time, heavy misses, and the contents of input files."""

from pyspark.sql import functions as F

from checks.analysis import enriched, scan_sql
from checks.bindings import oracle, table
from checks.registry import register
from larder.operators import history, scans
from larder.sources import export, record_log
from larder.sources.scratch import new_folder


def of_their_time(spark, d):
    rows = scans.with_scanned_key(table(spark, d, "scan_rows")).where("gtin is not null")
    distinct = rows.select("user_id", "gtin", "scanned_at").distinct()
    spans = history.versions(table(spark, d, "version_rows"))
    return history.scans_as_of(distinct, spans, keep=("user_id",), width=7 * 86400)


register(
    "scans_as_of", of_their_time,
    oracle(
        "select s.user_id, s.gtin, s.scanned_at, coalesce(not v.deleted, false) as found, case when not v.deleted then v.name end "
        "as name from (select distinct user_id, gtin14 as gtin, scanned_at from {scan_rows} where event_id % 7 in (0, 1, 2, 6)) s "
        "left join lateral (select name, deleted from {version_rows} w where w.gtin = s.gtin and w.valid_at <= s.scanned_at order "
        "by w.valid_at desc, w.batch desc limit 1) v on true"
    ),
)
register(
    "heavy_misses", lambda spark, d: scans.heavy_misses(enriched(spark, d), "1 day", 200),
    scan_sql(
        "select window_start, gtin, scans, total::bigint as total from (select *, sum(scans) over (partition by window_start) as "
        "total from (select time_bucket(interval '1 day', scanned_at) as window_start, gtin, count(*) as scans from scans where "
        "not found group by all) c) t where scans * 200 > total"
    ),
)


def contents(spark, d):
    lines = table(spark, d, "documents").select("source", F.explode(F.split("text", "\n")).alias("value"))
    return export.file_contents(lines, "source")


CONTENTS = (
    "select source as file, count(*) as lines, sum(length(value))::bigint as characters, concat(count(*), '-', "
    "sum(('0x' || substr(md5(value), 1, 15))::bigint), '-', sum(('0x' || substr(md5(value), 18, 15))::bigint)) as content "
    "from (select source, unnest(string_split(text, chr(10))) as value from documents where text is not null) l group by source"
)
register("file_contents", contents, CONTENTS)


def unseen(spark, d):
    """The sources as files, of which a snapshot knows those whose number of lines is even."""
    found = contents(spark, d)
    return export.unseen_files(found, found.where("lines % 2 = 0"))


register("unseen_files", unseen, f"select * from ({CONTENTS}) c where lines % 2 = 1")


def merged_log(spark, d):
    """Fingerprints from the merged runs of a log whose batches double in size."""
    root = new_folder(spark, "log")
    rows = table(spark, d, "version_rows").groupBy("gtin", F.expr("int(log2(batch + 1))").alias("batch")).agg(
        F.max_by(F.struct(F.md5("name").alias("substance"), "deleted"), "batch").alias("_v")
    )
    rows.select("gtin", "batch", "_v.*").repartition("batch").write.partitionBy("batch").parquet(root)
    for before in (10, 40):
        record_log.merge_runs(spark, root, before, fan=2)
    return record_log.fingerprints(spark, root, 40).where(~F.col("deleted")).select("gtin", "substance")


register(
    "merged_log", merged_log,
    oracle(
        "select gtin, md5(name) as substance from (select * from {version_rows} qualify row_number() over (partition by gtin "
        "order by batch desc) = 1) v where not deleted"
    ),
)
