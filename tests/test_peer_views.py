"""Maintained peer cut-offs against a full recount."""

import json
import math
import random
from collections import defaultdict
from pathlib import Path

from larder.operators import peer_views, peers
from larder.plans.peering import follow_log, record_panels
from larder.sources.export import OPEN_DATABASE
from larder.sources.record_log import current_records, read_log
from larder.streaming.imports import export_stream, start_import

RULE = {
    "nutrients": ["sugars_g", "fat_g"], "minimum_peers": 3, "lower_percentile": 25, "higher_percentile": 75,
    "rule_id": "r", "rule_version": "1",
}
LOG = "gtin string, batch long, deleted boolean, category_id string, basis string, sugars_g double, fat_g double"


def recounted(records):
    groups = defaultdict(list)
    for panels in records.values():
        for category, basis, sugars, fat in panels:
            if category is not None and basis in ("per_100g", "per_100ml"):
                for name, value in (("sugars_g", sugars), ("fat_g", fat)):
                    if value is not None:
                        groups[category, basis, name].append(value)
    out = set()
    for group, values in groups.items():
        n = len(values)
        if n >= 3:
            low, high = (sorted(values)[max(1, min(n, math.ceil(p / 100 * n))) - 1] for p in (25, 75))
            out.add((*group, n, low, high, "r", "1"))
    return out


def panel(draw):
    category = draw.choice(["hot", "hot", "hot", "a", "b", None])
    basis = draw.choice(["per_100g", "per_100g", "per_100ml", "per_serving", None])
    return category, basis, draw.choice([None, 1.0, 2.0, 2.5, 7.25]), draw.choice([None, 0.0, 3.0])


def test_view_equals_a_recount_after_every_batch(spark, tmp_path):
    draw, root, records, log = random.Random(5), str(tmp_path / "view"), {}, []
    for batch in range(10):
        if batch != 6:  # a batch that writes nothing
            for gtin in draw.sample([f"g{i}" for i in range(40)], 40 if batch == 0 else 12):
                # Two panels of a record may be equal; some records go, some that never were.
                panels = [panel(draw) for _ in range(draw.choice([1, 1, 2]))]
                gone = batch > 0 and draw.random() < 0.4
                records[gtin] = [] if gone else panels
                log += [(gtin, batch, gone or None, *p) for p in panels]
        log.append((None, batch, False, "hot", "per_100g", 99.0, 99.0))
        rows = spark.createDataFrame(log, LOG)
        for _ in range(2 if batch in (3, 7) else 1):  # a repeated batch changes nothing
            before, after = peer_views.batch_changes(rows, batch)
            peer_views.update(spark, root, batch, before, after, RULE, fold_every=3)
        got = [tuple(r) for r in peer_views.cut_off_view(spark, root).collect()]
        assert len(got) == len(set(got)) and set(got) == recounted(records)
    assert sorted(p.name for p in Path(root, "base").iterdir() if p.is_dir()) == ["batch=2", "batch=5", "batch=8"]


def test_a_batch_computes_the_groups_it_touches_and_no_others(spark, tmp_path):
    root = str(tmp_path / "view")
    first = [(f"g{i}", 0, False, c, "per_100g", float(i), None) for i in range(6) for c in ("a", "b")]
    log = spark.createDataFrame(first + [("g9", 1, False, "a", "per_100g", 50.0, None)], LOG)
    peer_views.update(spark, root, 0, *peer_views.batch_changes(log, 0), RULE)
    # Another rule shows which cut-offs are computed anew.
    peer_views.update(spark, root, 1, *peer_views.batch_changes(log, 1), {**RULE, "rule_version": "2"})
    got = {(r.category_id, r.peer_count, r.rule_version) for r in peer_views.cut_off_view(spark, root).collect()}
    assert got == {("a", 7, "2"), ("b", 6, "1")}
    assert {r.rule_version for r in peer_views.cut_off_view(spark, root, before=1).collect()} == {"1"}


def test_a_view_of_nothing_is_empty(spark, tmp_path):
    root = str(tmp_path / "view")
    assert peer_views.cut_off_view(spark, root).collect() == []
    empty = spark.createDataFrame([], LOG)
    peer_views.update(spark, root, 0, *peer_views.batch_changes(empty, 0), RULE)
    assert peer_views.cut_off_view(spark, root).collect() == []


def test_view_follows_a_streamed_import(spark, tmp_path):
    source, root, view = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "view")
    rule = {**RULE, "minimum_peers": 1}
    source.mkdir()

    def line(i, sugars):
        body = f"{i:011d}"
        digit = -sum(int(d) * (3 if k % 2 == 0 else 1) for k, d in enumerate(body)) % 10
        return json.dumps({
            "code": f"{body}{digit}", "product_name": "Biscuits", "countries_tags": ["en:india"], "brands": "x",
            "categories_tags": ["en:biscuits"], "nutrition_data_per": "100g", "nutriments": {"sugars_100g": sugars, "fat_100g": 3},
        })

    # Two products change, one is added; the change of one puts it in error, so it is pruned.
    batches = [[line(i, i) for i in range(1, 7)], [line(2, 30), line(3, 130), line(8, 9)]]
    for n, batch in enumerate(batches):
        (source / f"{n}.jsonl").write_text("\n".join(batch) + "\n")
        start_import(
            export_stream(spark, str(source)), root, str(tmp_path / "cp"), OPEN_DATABASE, "2026-08-27", "2026-09-01",
            then=lambda s, b: follow_log(s, root, view, b, rule),
        ).awaitTermination(240)
        panels = record_panels(current_records(read_log(spark, root)))
        want = peers.peer_stats(peers.peer_values(panels, rule["nutrients"]), 1, 25, 75, "r", "1").collect()
        assert want and sorted(map(tuple, want)) == sorted(map(tuple, peer_views.cut_off_view(spark, view).collect()))
