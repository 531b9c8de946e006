import zlib

import numpy as np
from pyspark.sql import functions as F

from larder.llm import toxicity


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and r.doc_id in known]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    right = sum(r.predicted == 1 for r in rows if known[r.doc_id] == 1)
    wrong = sum(r.predicted == 1 for r in rows if known[r.doc_id] == 0)
    toxic = sum(known[r.doc_id] for r in rows)
    assert right >= 0.85 * toxic and wrong <= 0.02 * len(rows)


def made(spark, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        sentences = [f"Plain words {j} go {(i * 7 + j) % 97} here" for j in range(6)]
        if bad:
            sentences[i % 6] = f"You nasty{i % 3} thing {i % 11}"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_the_offending_sentence_is_located(spark):
    docs, labels = made(spark)
    weights = toxicity.fit(docs, labels)
    found = {r.doc_id: r for r in toxicity.offending_sentences(docs, weights).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(found) == set(range(0, 600, 5))
    for doc_id, r in found.items():
        assert "nasty" in r.sentence and texts[doc_id][r.start : r.end] == r.sentence


def test_score_is_the_noisy_or_of_its_sentences(spark):
    docs, labels = made(spark)
    scorer = toxicity.Scorer(toxicity.fit(docs, labels))
    odd = "You nasty1, (nasty1) NASTY1 nasty2 thing 3! ... you nasty0, 'nasty0' nasties. ,,, ?! nasty1"
    for text in ("You nasty1 thing 3. Plain words 2 go 5 here", "Plain words", "", "...\n!?", odd):
        p = np.array([s[2] for s in scorer.sentence_scores(text)])
        assert abs(scorer.score(text) - (1 - np.prod(1 - p))) < 1e-9


def test_scores_match_a_plain_reading_of_the_weights(spark):
    """Word by word: the features of a sentence's distinct bare words, each once."""
    docs, labels = made(spark)
    weights = toxicity.fit(docs, labels).astype(float)
    draw = np.random.default_rng(1)
    pieces = ["you", "nasty1", "nasty1,", "(Nasty2)", "nast", "nastier", "plain", ",", "...", "words.", "go!", "\n", "x" * 300]
    for _ in range(200):
        text = " ".join(draw.choice(pieces, draw.integers(0, 25)))
        clean, places = 1.0, []
        for m in toxicity.SENTENCE.finditer(text):
            bare = {w.strip(toxicity.EDGES) for w in m.group().lower().split()} - {""}
            if bare:
                features = {f for w in bare for f in toxicity.word_features(w)}
                z = min(max(weights[-1] + sum(weights[f] for f in features), -30), 30)
                p = 1 / (1 + np.exp(-z))
                clean *= 1 - p
                places.append((p, -m.start(), m.end()))
        scorer = toxicity.Scorer(weights)
        assert abs(scorer.score(text) - (1 - clean)) < 1e-9
        told = [x for x in places if x[0] >= 0.5]
        worst = max(told) if told else (None, None, None)
        start = None if worst[1] is None else -worst[1]
        assert scorer.judged(text)[1:] == (len(told), start, worst[2])


def test_the_fit_reads_whole_texts_and_an_id_once(spark):
    docs, labels = made(spark, 300)
    # The offending sentence comes after 5,000 words; a third of the rows share one id.
    late = docs.withColumn("text", F.concat(F.repeat(F.lit("so on "), 2500), F.lit(". "), "text"))
    plain = toxicity.fit(docs, labels)
    found = toxicity.toxicity(late, labels).collect()
    assert {r.doc_id for r in found if r.predicted} == set(range(0, 300, 5))
    assert all(r.n_offending == 1 and r.worst_start > 15000 for r in found if r.predicted)
    many = docs.union(docs.where("doc_id = 7").crossJoin(spark.range(150)).select("doc_id", "text"))
    assert np.array_equal(toxicity.fit(many, labels), plain)


def test_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (3, None), (None, 1), (4, 5), (6, 0), (6, 1)], "doc_id long, toxic int"
    )
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(empty, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.toxicity(odd, none).collect())
    docs, labels = made(spark, 200)
    kept = toxicity.without_toxic(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == odd.count()
    assert toxicity.without_toxic(docs, labels).count() == 160
