import random

from pyspark.sql import functions as F

from larder.llm import revisits

RECORDS = (
    "record_id long, kind string, url string, time long, status int, "
    "headers map<string,string>, payload string"
)


def resolved(spark, rows):
    return {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}


def test_one_spelling_of_a_url(one):
    for url in (
        "HTTP://User@Example.COM:80/a/b/?utm_source=x&b=2&a=1#top",
        "https://example.com/a/b?a=1&b=2&gclid=7",
    ):
        assert one(lambda: revisits.canonical_url(F.col("u")), u=url) == "example.com/a/b?a=1&b=2"
    assert one(lambda: revisits.canonical_url(F.col("u")), u=None) is None


def test_validators_and_headers(spark):
    tag = {"etag": '"1"', "content-type": "text/html", "date": "d1", "x": "kept"}
    rows = [
        (1, "response", "http://a/x", 10, 200, tag, "one"),
        (2, "response", "http://a/x", 20, 404, {}, "missing"),
        (3, "revisit", "https://a/x/", 30, 304, {"etag": 'W/"1"', "date": "d2", "content-type": "no"}, None),
        (4, "revisit", "http://a/x", 30, 304, {"etag": '"2"'}, None),
        (5, "revisit", "http://a/x", 10, 304, {"etag": '"1"'}, None),
        (6, "revisit", "http://a/x", 11, 304, None, None),
        (7, "revisit", None, 11, 304, None, None),
        (8, "revisit", "http://a/x", None, 304, None, None),
        (9, "response", "http://b/", 1, 200, {"last-modified": "m"}, "b"),
        (10, "revisit", "http://b", 2, 304, {"last-modified": "m", "etag": "new"}, None),
        (11, "request", "http://b", 2, None, None, None),
        (12, "response", "http://b/", 5, 200, None, None),
        (13, "revisit", "http://b", 6, 304, {"last-modified": "m"}, None),
    ]
    found = resolved(spark, rows)
    assert {i: r.outcome for i, r in found.items()} == {
        3: "resolved", 4: "mismatch", 5: "no_response", 6: "unverified", 7: "no_response",
        8: "no_response", 10: "resolved", 13: "unverified",
    }
    assert (found[3].refers_to, found[3].status, found[3].payload) == (1, 200, "one")
    assert found[3].headers == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2", "x": "kept"}
    assert found[10].headers == {"last-modified": "m", "etag": "new"}
    assert found[4].payload is None and found[4].headers is None


def test_hot_urls_match_a_scan_in_time_order(spark, monkeypatch):
    monkeypatch.setattr(revisits, "ROWS_A_CHUNK", 50)
    draw = random.Random(5)
    rows, last, want = [], {}, {}
    for i in range(1500):
        url = "http://hot/" if draw.random() < 0.6 else f"http://u{draw.randrange(40)}/"
        rows.append((i, draw.choice(("response", "revisit")), url, draw.randrange(3000), 200, {"etag": "e"}, "p"))
    for time in sorted({r[3] for r in rows}):
        now = [r for r in rows if r[3] == time]
        want |= {r[0]: last.get(r[2]) for r in now if r[1] == "revisit"}
        for r in now:
            if r[1] == "response":
                last[r[2]] = max(r[0], last.get(r[2], -1) if any(x[0] == last.get(r[2]) for x in now) else -1)
    assert {i: r.refers_to for i, r in resolved(spark, rows).items()} == want


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], RECORDS)
    assert revisits.resolve(empty).collect() == []
    rows = [(1, "response", "http://a", 1, 200, {"etag": "e"}, "p"), (2, "revisit", "http://a", 2, 304, {"etag": "e"}, None)]
    more = spark.createDataFrame(rows, RECORDS).withColumns(
        {c: F.lit("own") for c in ("canonical", "full", "own", "_before", "_chunk", "outcome", "refers_to")}
    )
    assert [r.refers_to for r in revisits.resolve(more).collect()] == [1]


def test_repeated_revisits_and_null_ids_stay_one_row_each(spark):
    rows = [
        (1, "response", "http://a", 1, 200, {"etag": "e"}, "p"), (None, "response", "http://a", 2, 200, {"etag": "f"}, "q"),
        (2, "revisit", "http://a", 5, 304, {"etag": "e"}, None), (2, "revisit", "http://a", 5, 304, {"etag": "e"}, None),
        (None, "revisit", "http://a", 6, 304, {"etag": "e", "date": "own"}, None), (None, "revisit", None, 6, 304, None, None),
    ]
    found = revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()
    assert sorted((str(r.record_id), r.outcome, r.refers_to) for r in found) == [
        ("2", "resolved", 1), ("2", "resolved", 1), ("None", "no_response", None), ("None", "resolved", 1),
    ]
    assert [r.headers["date"] for r in found if r.record_id is None and r.headers] == ["own"]
