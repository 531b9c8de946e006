"""WARC not-modified revisits resolved to the response they stand for.

A crawler that is told 304 writes a revisit record without a body.  Its content is that of
the latest earlier full response for the same canonical URL, if its validators agree; its own
headers update the permitted ones of that response.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

ROWS_A_CHUNK = 8192

# The header fields that a 304 may update (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that name no other content.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url):
    """One spelling of a url: no scheme, user, default port, fragment, tracking or last slash.

    The host is lower-cased, parameters are sorted.  Null stays null; a text without :// is
    taken as host and path.
    """
    text = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    parameters = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    )
    tail = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&")))
    return F.concat(host, path, F.coalesce(tail, F.lit("")))


def latest_before(events, key, time, wanted, value):
    """Adds `value` of the last wanted event of the same key at an earlier time: an as-of join.

    Hot keys are split by time: a task orders one stretch of a key's events, and of the
    earlier stretches only the last wanted event is carried over.  Events of one time do not
    see each other; of several wanted ones at a time the largest value counts.
    """
    bounds = events.agg(F.count("*"), F.min(time), F.max(time)).first()
    rows, low, high = (x or 0 for x in bounds)
    width = max(1, (high - low) // (1 + rows // ROWS_A_CHUNK) + 1)
    chunked = events.withColumn("_chunk", F.floor((F.col(time) - low) / width))
    own = F.when(wanted, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    ends = chunked.groupBy(key, "_chunk").agg(F.max(own).alias("_own"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_chunk", F.max("_own").over(earlier).alias("_carried"))
    inside = (
        Window.partitionBy(key, "_chunk").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        chunked.join(ends, [key, "_chunk"])
        .withColumn("_before", F.coalesce(F.max(own).over(inside), F.col("_carried"))["v"])
        .drop("_chunk", "_carried")
    )


def weak(etag):
    return F.regexp_replace(F.trim(etag), r"^[Ww]/", "")


def resolve(records, permitted=PERMITTED):
    """Per revisit: record_id, canonical, time, refers_to, outcome, status, headers, payload.

    records: record_id (long), kind ('response' or 'revisit'; others are left out),
    url, time (long), status, headers (map, lower-case names), payload; other columns are
    left out.  A full response has status 200; a revisit refers to the latest one of the same
    canonical url at an earlier time.  Entity tags are compared weakly if both have one, else
    Last-Modified; outcomes: resolved, mismatch (validators differ), unverified (nothing to
    compare), no_response.  Only resolved ones have a referred record, its status, merged
    headers (permitted ones of the revisit over the response's own) and its payload.  Null
    urls or times resolve to no_response.  Each revisit is one row, whether its id is repeated
    or null; a response without an id is never referred to, and ids of responses are distinct.  Headers and payloads are joined last, by record.
    """
    records = records.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    events = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id",
        "kind",
        canonical_url(F.col("url")).alias("canonical"),
        F.col("time").cast("long").alias("time"),
        # A response without an id cannot be referred to.
        ((F.col("kind") == "response") & F.col("record_id").isNotNull() & F.coalesce(F.col("status") == 200, F.lit(False)))
        .alias("full"),
        # A revisit carries its headers along: its row is never looked up by its id again.
        F.when(F.col("kind") == "revisit", F.col("headers")).alias("own"),
    )
    usable = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    found = latest_before(
        events.where(usable), "canonical", "time", F.col("full"), "record_id"
    ).where("kind = 'revisit'")
    lost = events.where(~usable & (F.col("kind") == "revisit"))
    revisits = found.select("record_id", "canonical", "time", "own", "_before").unionByName(
        lost.select("record_id", "canonical", "time", "own", F.lit(None).cast("long").alias("_before"))
    )
    answers = records.where("kind = 'response'").select(
        F.col("record_id").alias("_before"), "status", "headers", "payload"
    )
    both = revisits.join(answers, "_before", "left")
    tag, own_tag = weak(F.col("headers")["etag"]), weak(F.col("own")["etag"])
    date, own_date = F.col("headers")["last-modified"], F.col("own")["last-modified"]
    outcome = (
        F.when(F.col("_before").isNull(), "no_response")
        .when(tag.isNotNull() & own_tag.isNotNull(), F.when(tag == own_tag, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & own_date.isNotNull(), F.when(date == own_date, "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    updates = F.map_filter("own", lambda k, v: k.isin(*permitted))
    kept = F.map_filter("headers", lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    resolved = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id",
        "canonical",
        "time",
        F.when(resolved, F.col("_before")).alias("refers_to"),
        "outcome",
        F.when(resolved, F.col("status")).alias("status"),
        F.when(resolved, F.map_concat(kept, updates)).alias("headers"),
        F.when(resolved, F.col("payload")).alias("payload"),
    )
