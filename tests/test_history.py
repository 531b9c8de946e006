"""As-of scans, bounded demand and file contents."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from larder.operators import history
from larder.sources import export
from larder.streaming import demand

T0 = datetime(2026, 1, 1)
LOG = "gtin string, valid_at timestamp, batch long, name string, deleted boolean"
SCANS = "user_id long, gtin string, scanned_at timestamp"


def at(hours):
    return T0 + timedelta(hours=hours)


def slow(log, scans):
    out = []
    for user, gtin, when in scans:
        if gtin is not None:
            upto = [r for r in log if r[0] == gtin and r[1] is not None and r[1] <= when]
            last = max(upto, key=lambda r: (r[1], r[2])) if upto else None
            held = last is not None and not last[4]
            out.append((user, gtin, when, held, last[3] if held else None))
    return sorted(out)


@pytest.mark.parametrize("width", [None, 3600, 86400 * 400])
def test_scans_see_the_catalogue_of_their_time(spark, width):
    draw = random.Random(1)
    log = [(f"g{draw.randrange(5)}", at(draw.randrange(60)), b, f"n{b}", draw.random() < 0.2) for b in range(80)]
    log += [("g1", at(30), 100, "same time, later batch", False), ("g1", at(30), 99, "same time", False)]
    log += [(None, at(1), 101, "no key", False), ("g2", None, 102, "no time", False)]
    # A hot code, scans at the time of a batch, before all, long after all, and without a code.
    scans = [(i, "g1" if i % 3 == 0 else f"g{draw.randrange(7)}", at(draw.randrange(-5, 90))) for i in range(300)]
    scans += [(900, None, at(3)), (901, "g1", at(30)), (901, "g1", at(30)), (902, "g1", at(9000))]
    spans = history.versions(spark.createDataFrame(log, LOG))
    found = history.scans_as_of(spark.createDataFrame(scans, SCANS), spans, keep=("user_id",), width=width)
    assert sorted(map(tuple, found.collect())) == slow(log, scans)


def test_no_scans_or_no_versions(spark):
    log, scans = spark.createDataFrame([("g", T0, 1, "n", False)], LOG), spark.createDataFrame([(1, "g", T0)], SCANS)
    spans = history.versions(log)
    assert history.scans_as_of(scans.limit(0), spans, width=3600).collect() == []
    none = history.scans_as_of(scans, spans.limit(0), width=3600).collect()
    assert [(r.gtin, r.found, r.name) for r in none] == [("g", False, None)]


def test_late_scans_of_a_stream_see_their_own_time(spark, tmp_path):
    log = [("g", at(0), 1, "old", False), ("g", at(10), 2, "new", False)]
    spans = history.versions(spark.createDataFrame(log, LOG))
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, rows in enumerate([[(1, "g", at(12))], [(2, "g", at(3)), (3, "g", at(10)), (4, "h", at(3))]]):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        history.scans_as_of(stream, spans, keep=("user_id",)).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert {r.user_id: r.name for r in spark.read.parquet(out).collect()} == {1: "new", 2: "old", 3: "new", 4: None}


def test_places_bound_the_count_and_keep_heavy_codes():
    draw = random.Random(2)
    size, stream = 50, []
    for i in range(20_000):
        stream.append(f"c{int(draw.paretovariate(0.6))}")
    true = Counter(stream)
    halves = [{}, {}]
    for i, code in enumerate(stream):
        demand.offer(halves[i % 2], code, 1, size)
        assert len(halves[i % 2]) <= size
    one = demand.merged(*halves, size)
    assert len(one) == size and len(true) > 100 * size / 10
    for code, (count, error) in one.items():
        assert count - error <= true[code] <= count and error <= len(stream) / size
    assert {c for c, n in true.items() if n > 2 * len(stream) / size} <= set(one)


def test_demand_stream_reports_every_heavy_code(spark, tmp_path):
    draw = random.Random(4)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = "gtin string, found boolean, scanned_at timestamp"
    heavy, batches = ["hot", "warm"], []
    for day in range(2):
        # A hundred times more codes than places, each missed once or twice.
        one = [("hot", False, at(24 * day + draw.random() * 23)) for _ in range(400)]
        one += [("warm", False, at(24 * day + draw.random() * 23)) for _ in range(250)]
        one += [(f"c{draw.randrange(1500)}", False, at(24 * day + draw.random() * 23)) for _ in range(1000)]
        one += [("known", True, at(24 * day))] * 50
        draw.shuffle(one)
        batches += [one[:800], one[800:]]
    batches.append([("end", False, at(24 * 30))])
    # The last scan of a hot code is late by far more than the watermark.
    batches.append([("hot", False, at(2)), ("end", False, at(24 * 30))])
    for batch in batches:
        spark.createDataFrame(batch, rows).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("scanned_at", "1 day")
    query = (
        demand.heavy_misses_stream(stream, "1 day", size=15, shards=3).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(out).collect()
    days = {r.window_start for r in found}
    assert len(days) == 2 and len(found) <= 2 * 3 * 15
    true = Counter((t.date(), c) for b in batches[:-1] for c, known, t in b if not known)
    for r in found:
        assert r.scans - r.error <= true[r.window_start.date(), r.gtin] <= r.scans and r.error * 15 <= r.total
    for day in days:
        assert set(heavy) <= {r.gtin for r in found if r.window_start == day}


def test_contents_do_not_depend_on_splits(spark):
    lines = [(f, v) for f, n in (("a", 40), ("b", 40), ("c", 3)) for v in [f"line {i}" for i in range(n)]] + [("c", ""), ("c", None)]
    make = lambda rows, parts: spark.createDataFrame(rows, "file string, value string").repartition(parts)
    of = lambda rows, parts=1: {r.file: r.content for r in export.file_contents(make(rows, parts)).collect()}
    one, many = of(lines), of(lines, 7)
    assert one == many and one["a"] == one["b"] != one["c"]
    assert of([*lines, ("a", "line 3")])["a"] != one["a"] != of([("a", "line 3!") if x == ("a", "line 3") else x for x in lines])["a"]
    assert of([x for x in lines if x != ("c", "")])["c"] != one["c"]
    found = export.file_contents(make(lines, 3))
    assert [r.file for r in export.unseen_files(found, found.where("file = 'c'")).collect()] == ["a"]
    assert export.unseen_files(found, found).collect() == []
