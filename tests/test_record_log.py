"""The record log's runs against a replay of all batches."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from larder.sources import record_log
from larder.sources.record_log import fingerprints, heads, merge_runs, next_merge

ROWS = "gtin string, substance string, deleted boolean"


def append(spark, root, batch, rows):
    record_log.append_batch(spark.createDataFrame(rows, ROWS).coalesce(1), root, batch)


def live(df):
    return {r.gtin: r.substance for r in df.collect() if not r.deleted}


def test_merged_runs_say_what_the_batches_say(spark, tmp_path):
    draw, root, state = random.Random(3), str(tmp_path / "log"), {}
    usual = spark.conf.get(record_log.IN_FILTER)
    spark.conf.set(record_log.IN_FILTER, 5)  # keys go in several lots
    for batch in range(9):
        size = 60 if batch == 5 else 0 if batch == 3 else 8  # a large batch, and one without changes
        rows = [(f"g{k}", f"{batch}", draw.random() < 0.3) for k in draw.sample(range(80), size)]
        for _ in range(2 if batch in (4, 8) else 1):  # a repeated batch changes nothing
            assert live(fingerprints(spark, root, batch)) == state
            some = [f"g{k}" for k in range(0, 90, 7)]
            found = live(fingerprints(spark, root, batch, some))
            assert found == {k: v for k, v in state.items() if k in some}
            append(spark, root, batch, rows)
            merge_runs(spark, root, batch, fan=2)
        for gtin, substance, deleted in rows:
            state.pop(gtin, None)
            if not deleted:
                state[gtin] = substance
    assert live(fingerprints(spark, root, 9)) == state
    assert live(fingerprints(spark, root, 9, [])) == {}
    spark.conf.set(record_log.IN_FILTER, usual)
    runs = record_log._listed(spark, root, 9)[1]
    assert len(runs) <= 4 and any(merged for *_, merged in runs)
    assert live(record_log.latest_fingerprints(record_log.read_log(spark, root))) == state


def test_a_log_without_rows_is_empty(spark, tmp_path):
    root = str(tmp_path / "log")
    assert fingerprints(spark, root, 0).collect() == []
    merge_runs(spark, root, 0)
    assert fingerprints(spark, root, 5, ["a"]).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 5000), max_size=120), st.integers(2, 5))
def test_few_runs_remain_and_rows_move_seldom(batches, fan):
    runs, moved = [], 0
    for size in batches:
        runs.append(size)
        while stretch := next_merge(runs, fan):
            start, end = stretch
            moved += sum(runs[start:end])
            runs[start:end] = [sum(runs[start:end])]
    steps = 1
    while fan**steps <= sum(batches):
        steps += 1
    assert len(runs) <= (fan - 1) * steps
    assert moved <= 2 * steps * sum(batches)


def scanned(df):
    """Rows that the scans of a plan without exchanges gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_few_keys_read_few_rows_however_long_the_log_is(spark, tmp_path):
    read = {}
    for size in (100_000, 400_000):
        root = str(tmp_path / f"log{size}")
        rows = spark.range(size).selectExpr("lpad(cast(id as string), 14, '0') as gtin", "md5(cast(id as string)) as substance",
                                            "false as deleted", "id % 2 as batch")
        rows.write.partitionBy("batch").parquet(root)
        merge_runs(spark, root, 2, fan=2)
        keys = sorted([f"{k:014d}" for k in range(0, size, size // 12)][:12] + ["absent"])
        found = heads(spark, root, 2, keys)
        read[size] = scanned(found)
        assert found.count() == 12
    assert all(n <= 12 * 2 * record_log.PAGE_ROWS for n in read.values())
