"""Quality by logistic regression on hashed word n-grams, fitted with FTRL-proximal updates.

A document's words, as they are written, give runs of one and two words; their shapes
(letters of a case, digits and marks, each stretch once) give runs of one to three.
Whether a word is the one before it again, or stood earlier in the document, is an
n-gram feature of its own kind.  All are hashed into 2**BITS places; a document is the
sparse vector of its places' log counts, of length 1 in each family, so that long texts
weigh as much as short ones.

Training walks over a bounded sample of labelled documents in a drawn order, EPOCHS
times, in one task that holds a chunk of texts and the weights.  Each document updates
only its own places, with a rate for each place, and an L1 bound that keeps rare places
at zero.  The weights (2**BITS numbers, 1 MB) go to all tasks; a score is a sparse dot
product inside the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textcols import NOT_SPACE, Texts, Words, chunks, mix64, paired

U64 = np.uint64
#: Hashed places, without the one for what all documents have.
BITS = 18
#: Labelled documents of each label that the weights are fitted on, at most.
SAMPLE_DOCS = 2000
EPOCHS = 4
#: FTRL-proximal: rate, its smoothing, and the L1 and L2 bounds.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
#: A document is predicted to be of quality from this score on.
LEAST_SCORE = 0.7

#: Kinds of bytes: lower and upper case, digits; other ASCII stays, bytes beyond ASCII count as lower case.
KIND = np.arange(256, dtype=np.uint8)
KIND[0x61:0x7B] = KIND[0x80:] = 0x61
KIND[0x41:0x5B] = 0x41
KIND[0x30:0x3A] = 0x30


def held_out() -> Column:
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _shapes(words: Words) -> Texts:
    """The words' shapes in place of the words, a row for each word."""
    data, first = words.spaced()
    kind = KIND[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[first[1:] - 1] = False  # the spaces
    keep[first[:-1]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return Texts(kind[keep], at[first])


def _families(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: the row and the 64-bit hash of each occurrence."""
    words = Words(texts, NOT_SPACE)
    row = words.row
    if not len(words):
        return []
    one = words.hashes()
    shape = Words(_shapes(words), np.ones(256, bool)).hashes(seed=1)
    follows = row[1:] == row[:-1]
    out = [(row, one), (row[1:][follows], paired(one[:-1], one[1:])[follows]), (row, mix64(shape ^ U64(2)))]
    for k in (2, 3):
        at, runs = words.windows(shape, k)
        out.append((row[at], mix64(runs ^ U64(k << 8))))
    order = np.lexsort((np.arange(len(one)), one, row))
    again = np.zeros(len(one), bool)
    again[order[1:]] = (one[order[1:]] == one[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    twice = np.zeros(len(one), bool)
    twice[1:] = follows & (one[1:] == one[:-1])
    out.append((row, mix64(again.astype(U64) | twice.astype(U64) << U64(1) | U64(1 << 20))))
    return out


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First feature of each row (and the last one's end), places and values; each place once a row and family."""
    rows, places, values = [], [], []
    for row, grams in _families(texts):
        key = row.astype(U64) << U64(BITS) | grams >> U64(64 - BITS)
        key, count = np.unique(key, return_counts=True)
        owner = (key >> U64(BITS)).astype(np.int64)
        value = np.log1p(count)
        length = np.sqrt(np.bincount(owner, value * value, len(texts)))
        rows.append(owner)
        places.append((key & U64((1 << BITS) - 1)).astype(np.int64))
        values.append(value / length[owner])
    rows.append(np.arange(len(texts)))
    places.append(np.full(len(texts), 1 << BITS))
    values.append(np.ones(len(texts)))
    row, place, value = (np.concatenate(x) for x in (rows, places, values))
    order = np.argsort(row, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), place[order], value[order]


class Ftrl:
    """FTRL-proximal logistic regression: per place the sum of adjusted gradients and that of their squares."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        """One document; a place that several families fell on counts as their sum."""
        at, inverse = np.unique(place, return_inverse=True)
        x = np.bincount(inverse, value, len(at))
        w = self.weights(at)
        g = (_sigmoid(x @ w) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    first, place, value = features(texts)
    return _sigmoid(np.add.reduceat(weights[place] * value, first[:-1])) if len(texts) else np.zeros(0)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, seen = Ftrl(), 0
    for rows, texts in chunks(batches):
        first, place, value = features(texts)
        for i, label in enumerate(rows["label"].to_pylist()):
            model.learn(place[first[i] : first[i + 1]], value[first[i] : first[i + 1]], label)
        seen += len(texts)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and text of the documents to learn from: at most SAMPLE_DOCS of each label, drawn by a hash of doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") != 0).cast("int")).alias("label"))
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """The weights, or None without a labelled document.

    The task that updates them reads a bounded sample, in an order drawn by hashes, once
    for each epoch.
    """
    sample = training_sample(docs, labels).withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(EPOCHS)))))
    walked = sample.repartition(1).sortWithinPartitions("epoch", F.xxhash64("doc_id", "epoch"), "text").select("label", "text")
    found = walked.mapInArrow(_fit, "weights binary").collect()
    return np.frombuffer(found[0].weights, np.float32).astype(float) if found else None


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs: doc_id, held_out, score, predicted.

    Whole texts are scored; a null text counts as empty, and an empty one has the score
    of what all documents share.  Labels that are null or belong to no document are not
    used; of several labels of one document the largest counts.  Without any label all
    scores are 0.  Equal texts have equal scores; no rows give no rows; other columns
    are ignored.
    """
    weights = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            score = scores(texts, weights) if weights is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(np.round(score, 6))], ["doc_id", "held_out", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))
