import random

from larder.llm import licenses


def scanned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs, **options).collect()}


def test_phrases_count_all_places(spark):
    found = scanned(
        spark,
        [
            "The MIT license; mit-license. MIT\nLicense mit  licensee",
            "General Public General Public License",
            "Apache (License) v2 and the mit license",
            "éMIT License",
            "mit",
        ],
    )
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in map(found.get, range(5))] == [
        (3, 1, 5, "mit"),
        (1, 2, 2, "gpl"),
        (2, 0, 5, "apache,mit"),
        (0, None, None, ""),
        (0, None, None, ""),
    ]
    assert [found[i].n_words for i in range(5)] == [9, 5, 7, 2, 1]
    assert found[0].score == 1.0 and found[4].score == 0.0


def test_notices_with_words_put_in_and_left_out(spark):
    notice = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software)"
    )
    changed = notice.replace("any person", "any other person").replace("a copy of", "copy of")
    found = scanned(spark, [notice, "intro words " + changed, "Permission is hereby granted to nobody"])
    assert found[0].labels == "mit-text" and found[0].score == 1.0
    assert found[1].labels == "mit-text" and 0.7 <= found[1].score < 1
    assert found[2].labels == "" and found[2].n_base == 0
    assert scanned(spark, ["Licensed under the Apache License, Version 2.0."])[0].labels == "apache,apache-2.0"


NOTICE = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files"
).split()


def test_scattered_or_shuffled_grams_are_no_notice(spark):
    grams = [NOTICE[i : i + 3] for i in range(len(NOTICE) - 2)]
    scattered = " ".join(" ".join([*g, "filler"]) for g in grams)
    halves = " ".join(NOTICE[10:] + NOTICE[:10])
    found = scanned(spark, [scattered, halves, " ".join(NOTICE[:8] + ["x", "y", "z"] + NOTICE[8:])])
    assert [found[i].labels for i in range(3)] == ["", "", "mit-text"]
    assert found[2].score == 16 / 18


def longest(hits):
    """The most pairs in strict order of both parts, by comparing all with all."""
    hits = sorted(hits)
    best = []
    for i, (place, t_place) in enumerate(hits):
        best.append(1 + max((best[j] for j in range(i) if hits[j][0] < place and hits[j][1] < t_place), default=0))
    return max(best, default=0)


def test_spans_equal_a_search_of_all_chains(spark):
    draw = random.Random(4)
    template = [draw.choice("abcdefgh") for _ in range(24)]
    texts = []
    for _ in range(60):
        words = list(template)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(words))
            words[at : at + draw.choice([0, 0, 1])] = [draw.choice("abx")] * draw.choice([0, 1, 3])
        if draw.random() < 0.3:
            cut = draw.randrange(len(words))
            words = words[cut:] + words[:cut]
        texts.append(" ".join(words * draw.choice([1, 1, 2])))
    n = len(template) - 2
    drift = 3 * int(n * 0.3 / 2 + 1e-9)
    found = scanned(spark, texts, phrases=(), notices=[(" ".join(template), "t")])
    scores = []
    for i, text in enumerate(texts):
        words = text.split()
        hits = [(p, t) for p in range(len(words) - 2) for t in range(n) if words[p : p + 3] == template[t : t + 3]]
        starts = {p - t for p, t in hits}
        score = max((longest([h for h in hits if d <= h[0] - h[1] <= d + drift]) / n for d in starts), default=0.0)
        scores.append(score if score >= 0.7 else 0.0)
        assert (found[i].score, found[i].labels) == (scores[-1], "t" if scores[-1] else "")
    assert 10 < sum(s > 0 for s in scores) < 60


def test_many_places_in_a_long_text(spark):
    found = scanned(spark, ["mit license word " * 4000])
    assert (found[0].n_base, found[0].first_word, found[0].last_word) == (4000, 0, 11997)


def test_odd_rows(spark, odd, clashing, empty):
    rows = licenses.scan(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_words for r in rows if r.doc_id in (1, 2, 5)) == [0, 0, 0]
    assert len([r for r in rows if r.doc_id == 3]) == 2
    assert licenses.scan(empty).collect() == []
    assert sorted(map(str, licenses.scan(clashing).collect())) == sorted(map(str, rows))
    twice = spark.createDataFrame([(1, "mit license")] * 2 + [(1, "none")], "doc_id long, text string")
    assert sorted(r.n_base for r in licenses.scan(twice).collect()) == [0, 1, 1]
