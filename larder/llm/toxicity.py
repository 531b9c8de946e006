"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is toxic when some sentence is: its score is the noisy-or of its sentences',
1 - prod(1 - p).  Sentence scores are logistic in the words and word beginnings of the
sentence.  Only document labels are known, so the fit follows the gradient of the document
likelihood, which gives each sentence its share of a toxic document.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import stored

FIT_ROWS = 3000
BUCKETS = 1 << 18
EPOCHS = 80
RATIO = 4.0
MEMO, MEMO_BYTES = 200_000, 16 << 20
THRESHOLD = 0.7
OFFENDING = 0.5

SENTENCE = re.compile(r"[^.!?\n]+")
EDGES = ".,;:!?\"'()[]"


def word_features(word):
    """Hashed features of a lower-cased word: itself and its beginnings of 4 and 5 letters."""
    names = {"=" + word, "^" + word[:4], "^" + word[:5]}
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in sorted(names)]


class Words(dict):
    """What features(word) gives for each raw piece of text, remembered up to a bound in number and bytes.

    A piece is stripped of marks first; one of marks alone gives None.
    """

    def __init__(self, features):
        self.features, self.size = features, 0

    def __missing__(self, piece):
        bare = piece.strip(EDGES)
        found = tuple(self.features(word_features(bare))) if bare else None
        if len(piece) < 256:
            if len(self) >= MEMO or self.size > MEMO_BYTES:
                self.clear()
                self.size = 0
            self.size += len(piece)
            self[piece] = found
        return found


def sentence_features(sentence, words):
    """The features of a sentence, each once, or None when it has no words: for fit, score and place alike."""
    found = set(map(words.__getitem__, set(sentence.lower().split())))
    found.discard(None)
    return set().union(*found) if found else None


def training_rows(docs, labels, label, most_rows=FIT_ROWS):
    """A bounded sample of the labelled rows: at most most_rows of each label, by hash.

    Leaves out ids whose crc32 (of the id as text) leaves 1 when divided by 3: they are held
    out.  Only ids and labels are ordered; texts are joined to the sample.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max(label).alias("_y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.where("_y = 1").orderBy(*order).limit(most_rows).union(
        known.where("_y = 0").orderBy(*order).limit(most_rows)
    )
    # At most two limits of (id, label): small whatever the tables are.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # An id counts once, by the text of the smallest hash, however many rows share it.
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_y").cast("int").alias("_y"))


def fit(docs, labels, label="toxic", most_rows=FIT_ROWS):
    """Weights of the hashed features and the bias, as one float array (the bias last).

    Whole texts of at most most_rows documents of each label are read, in tasks: first to
    count in how many documents of a label a feature is, then for the telling features of
    each sentence.  The driver gets the counts, two for each feature bucket, and of the sampled
    documents the telling features alone.  Without documents of both labels the model scores
    0 everywhere.
    """
    rows = stored(training_rows(docs, labels, label, most_rows), "training")
    sizes = {r[0]: r[1] for r in rows.groupBy("_y").agg(F.count("*")).collect()}
    weights = np.zeros(BUCKETS + 1, np.float32)
    weights[-1] = -30.0
    if len(sizes) < 2:
        return weights

    def count(batches):
        words, counts = Words(lambda found: found), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist()):
                found = set().union(*(sentence_features(x, words) or () for x in SENTENCE.findall(text or "")))
                counts[y, np.fromiter(found, np.int64, len(found))] += 1
        for y in (0, 1):
            at = np.flatnonzero(counts[y])
            yield pa.RecordBatch.from_pydict(
                {"y": pa.array(np.full(len(at), y, np.int32)), "feature": pa.array(at), "n": pa.array(counts[y, at])}
            )

    found = rows.select("text", "_y").mapInArrow(count, "y int, feature long, n long")
    found = found.groupBy("y", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS), np.int64)
    counts[found.column("y").to_numpy(), found.column("feature").to_numpy()] = found.column("n").to_numpy()
    mask = telling(counts, sizes[1], sizes[0])
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(np.flatnonzero(mask).tolist()))

    def bags(batches):
        words = Words(lambda found: shared.value.intersection(found))
        for batch in batches:
            out = []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("_y").to_pylist()):
                told = [f for x in SENTENCE.findall(text or "") if (f := sentence_features(x, words)) is not None]
                some = [sorted(f) for f in told if f]
                out.append((y, len(told) - len(some), [f for x in some for f in x], [len(x) for x in some]))
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["y", "plain", "ids", "sizes"]
            )

    kinds = "y int, plain long, ids array<long>, sizes array<long>"
    # Sorted, so that sums do not depend on the order of the tasks.
    bag = rows.select("text", "_y").mapInArrow(bags, kinds).orderBy("y", "plain", "sizes", "ids").toArrow()
    shared.destroy()
    y = bag.column("y").to_numpy().astype(float)
    flat = lambda c: np.array([x for part in bag.column(c).to_pylist() for x in part], np.int64)
    lengths = np.array([len(x) for x in bag.column("sizes").to_pylist()])
    # Sentences without a telling feature are alike: one of a document stands for all of them.
    doc_of = np.concatenate((np.repeat(np.arange(len(y)), lengths), np.arange(len(y))))
    times = np.concatenate((np.ones(int(lengths.sum())), bag.column("plain").to_numpy().astype(float)))
    sentence_of = np.repeat(np.arange(int(lengths.sum())), flat("sizes"))
    return train(flat("ids"), sentence_of, doc_of, times, y, mask)


def telling(counts, n1, n0):
    """Features that toxic documents hold far more often than clean ones (a mask).

    counts: by label (clean, toxic) and feature the documents that hold it, of n1 toxic and n0
    clean ones.  The features pass the universal threshold sqrt(2 ln F) for F features on the
    two-proportion score, and are at least RATIO times as frequent; all others weigh nothing.
    """
    b, a = counts
    p = (a + b) / (n1 + n0)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
    score = (a / n1 - b / n0) / spread
    least = np.sqrt(2 * np.log(max(2, np.count_nonzero(a + b))))
    return (score >= least) & (a / n1 >= RATIO * (b + 0.5) / n0)


def train(ids, sentence_of, doc_of, times, y, mask, epochs=EPOCHS, rate=0.3):
    """Full-batch adaptive gradient on the noisy-or likelihood, both labels weighing alike.

    ids: telling features; sentence_of: the sentence of each; doc_of: the document of each
    sentence, times: how many sentences of the document it stands for.  Only features of the mask get a weight, and none below zero.
    """
    w, b = np.where(mask, 1.0, 0.0), -6.0
    seen, seen_b = np.full(BUCKETS, 1e-8), 1e-8
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    n_docs = len(y)
    for _ in range(epochs):
        z = np.clip(b + np.bincount(sentence_of, w[ids], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(doc_of, times * np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)
        some = np.maximum(1 - np.exp(clean), 1e-9)
        # d log P(y) / dz of a sentence: -p for clean documents, p (1 - P) / P for toxic ones.
        gain = np.where(y == 1, np.exp(clean) / some, -1.0) * each
        g = gain[doc_of] * p * times
        gw = np.bincount(ids, g[sentence_of], BUCKETS)
        seen += gw * gw
        w = np.maximum(w + rate * gw / np.sqrt(seen), 0) * mask
        gb = g.sum()
        seen_b += gb * gb
        b += rate * gb / np.sqrt(seen_b)
    out = np.zeros(BUCKETS + 1, np.float32)
    out[:-1], out[-1] = w, b
    return out


class Scorer:
    """Sentence and document scores of texts; pieces without weight are looked up once."""

    def __init__(self, weights):
        self.bias = float(weights[-1])
        self.weights = {int(i): float(weights[i]) for i in np.flatnonzero(weights[:-1])}
        self.words = Words(lambda found: [f for f in found if f in self.weights])
        self.plain = float(np.logaddexp(0, self._bounded(self.bias)))

    @staticmethod
    def _bounded(z):
        return min(max(z, -30.0), 30.0)

    def _log_odds(self, features):
        return self._bounded(self.bias + sum(self.weights[f] for f in sorted(features)))

    def sentence_scores(self, text):
        """(start, end, probability) of each sentence with words."""
        out = []
        for m in SENTENCE.finditer(text):
            features = sentence_features(m.group(), self.words)
            if features is not None:
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-self._log_odds(features)))))
        return out

    def score(self, text):
        """The noisy-or over the sentences; 0 without any."""
        plain, clean = 0, 0.0
        for sentence in SENTENCE.findall(text):
            features = sentence_features(sentence, self.words)
            if features:
                clean += float(np.logaddexp(0, self._log_odds(features)))
            elif features is not None:
                plain += 1
        return float(-np.expm1(-clean - plain * self.plain))

    def judged(self, text, least=OFFENDING):
        """(score, offending sentences, start and end of the worst one or None)."""
        score = self.score(text)
        # Only a document that scores as much can hold a sentence that does.
        told = [s for s in self.sentence_scores(text) if s[2] >= least] if score >= least else []
        worst = max(told, key=lambda s: (s[2], -s[0])) if told else (None, None)
        return score, len(told), worst[0], worst[1]


def scored(docs, weights, column="score"):
    """docs with a toxicity score (0 to 1) of each whole text; null and empty texts have 0.

    The weights (1 MB, whatever the input) go to the tasks once.  Other columns pass through,
    an earlier column of that name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    base = docs.drop(column)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            values = [scorer.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, column]
            )

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(column, T.DoubleType())]))


def offending_sentences(docs, weights, least=OFFENDING):
    """doc_id, start, end (characters), sentence, score of sentences scored at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [
                (i, a, b, t[a:b], float(p))
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for a, b, p in scorer.sentence_scores(t or "")
                if p >= least
            ]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "start", "end", "sentence", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, end long, sentence string, score double"
    )


def toxicity(docs, labels, label="toxic", threshold=THRESHOLD, least=OFFENDING):
    """Per row: doc_id, held_out, score, predicted (1 at the threshold), and where it offends.

    n_offending counts the sentences scored at least `least`; worst_start and worst_end
    (characters) are the first of the worst ones, null without any.  Null ids are not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [scorer.judged(t or "", least) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "score", "n_offending", "worst_start", "worst_end"],
            )

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, n_offending int, worst_start long, worst_end long"
    )
    return out.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "n_offending",
        "worst_start",
        "worst_end",
    )


def without_toxic(docs, labels, threshold=THRESHOLD):
    """docs without those that the model rejects; columns as they are."""
    weights = fit(docs, labels)
    score = "score"
    while score in docs.columns:
        score = f"_{score}"
    return scored(docs, weights, score).where(F.col(score) < threshold).select(*docs.columns)
