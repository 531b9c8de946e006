import random

from larder.llm import decontaminate

ITEMS = "item_id long, text string"


def words(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefgh", k=5)) for _ in range(n)]


def found(spark, docs, items):
    return {
        (r.doc_id, r.item_id): r
        for r in decontaminate.overlaps(
            spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
        ).collect()
    }


def test_substituted_words_are_tolerated(spark):
    item = words(30, 1)
    docs = []
    for i in range(8):
        copy = list(item)
        for at in range(i % 5, 30, 6):
            copy[at] = f"zz{i}{at}"
        docs.append((i, " ".join(words(40, 50 + i) + copy + words(10, 80 + i))))
    docs.append((100, " ".join(words(90, 7))))
    rows = found(spark, docs, [(1, " ".join(item).upper() + "."), (2, " ".join(words(30, 2)))])
    assert {d for d, _ in rows} == set(range(8)) and {i for _, i in rows} == {1}
    assert all(r.first_word == 40 and r.n_words == 30 and r.n_same >= 24 for r in rows.values())


def slow(docs, items):
    """Pairs with an alignment that has a mask's words equal and a window of enough."""
    out = set()
    for d, text in docs:
        w = decontaminate_words(text)
        for i, passage in items:
            p = decontaminate_words(passage)
            for start in range(-len(p) + 1, len(w)):
                same = [0 <= start + j < len(w) and w[start + j] == p[j] for j in range(len(p))]
                seeded = any(
                    all(a + o < len(p) and same[a + o] for o in mask)
                    and 0 <= start + a and start + a + max(mask) < len(w)
                    for mask in decontaminate.MASKS
                    for a in range(len(p) - max(mask))
                )
                width = min(decontaminate.WINDOW, len(p))
                if seeded and any(
                    sum(same[a : a + width]) >= decontaminate.SHARE * width for a in range(len(p) - width + 1)
                ):
                    out.add((d, i))
    return out


def decontaminate_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def test_overlaps_match_all_alignments(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.limit(60).collect() if len(r.text) < 4000]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    # Parts of items inside texts, some with words replaced.
    for n, (i, passage) in enumerate(items[:12]):
        p = passage.split()
        p[len(p) // 2] = "replaced"
        docs.append((10_000 + n, "Begin " + " ".join(p[n % 4 :][: 10 + 2 * n]) + " end"))
    assert set(found(spark, docs, items)) == slow(docs, items)


def test_odd_rows(spark, odd, clashing, empty):
    items = [(1, "one two three four"), (2, None), (3, ""), (4, "word " * 20), (4, "word " * 20)]
    benchmark = spark.createDataFrame(items, ITEMS)
    rows = decontaminate.overlaps(odd, benchmark).collect()
    # The whole item of four words stands in two documents, one of them given twice.
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(3, 1), (4, 1), (6, 4)]
    assert decontaminate.overlaps(empty, benchmark).collect() == []
    assert decontaminate.overlaps(odd, spark.createDataFrame([], ITEMS)).collect() == []
    kept = decontaminate.clean_documents(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == odd.count() - 4


def test_short_items_are_found_whole(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "Delta, epsilon zeta."), (4, "eta theta iota kappa")]
    docs = [
        (1, "x alpha y"), (2, "gamma beta"), (3, "beta gamma"), (4, "delta epsilon Zeta"), (5, "delta epsilon eta"),
        (6, "so eta theta iota kappa"), (7, "eta theta iota"), (8, "ALPHA beta x gamma"), (9, ""), (10, None),
    ]
    rows = found(spark, docs, items)
    assert set(rows) == {(1, 1), (8, 1), (3, 2), (4, 3), (6, 4)}
    assert (rows[6, 4].first_word, rows[6, 4].n_words, rows[6, 4].n_same) == (1, 4, 4)
