"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the hashed terms
of a text, x being 1 + ln(occurrences), so pairs of terms (an insult and a group, say) carry weight
that an additive model can't give them.

Training takes at most ``SAMPLE_ROWS`` labelled ids, the first by a hash, and one
row an id: that bounded list of ids is broadcast, the rows that match are written
once (only they are shuffled) and read by all later steps. Term counts by class
(at most ``BUCKETS`` rows) choose ``TERMS`` buckets by their chi-square; the rows
of the sample come to the driver as their chosen buckets only, at most
``SAMPLE_ROWS * TERMS`` two-byte numbers. Scoring is one pass over all documents.

Defined results: null text counts as empty; an empty text gets the model's bias;
very long texts are read whole; a null id is scored and counts as '' for the
fold; a label above 0 means toxic, of repeated labels of an id the largest
counts, null labels are ignored; of rows that share a labelled id the one with
the least text is learned from; equal scores of terms choose the smaller bucket;
without both classes in the training rows every score is the share of toxic rows
(0 if there are none); repeated rows each get a score; an empty table gives no
rows; extra columns are ignored, whatever their names; ids keep their type.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, materialise, slices, text_bytes
from .decontaminate import words

SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
TERMS = 2048
#: Rows of the sample that must hold a term for it to be chosen.
LEAST_ROWS = 3
#: Lengths in bytes of the word beginnings that are terms of their own.
PREFIXES = (4, 5, 6, 7, 8)
FACTORS = 8
#: Passes over the sample; more on a small one, until so many steps are made.
EPOCHS, LEAST_STEPS = 30, 200
BATCH = 512
RATE = 0.05
L2 = 1e-5
FOLDS = 5
HELD_OUT = 0


def term_counts(text: bytes) -> dict[int, int]:
    """Occurrences by bucket of a text's terms: its words and, for inflected
    forms, the words' first ``PREFIXES`` bytes."""
    crc, mask = zlib.crc32, BUCKETS - 1
    whole = Counter(words(text))
    found: dict[int, int] = {}
    for term, n in whole.items():
        bucket = crc(term) & mask
        found[bucket] = found.get(bucket, 0) + n
    for size in PREFIXES:
        heads: dict[bytes, int] = {}
        for term, n in whole.items():
            head = term[:size]
            heads[head] = heads.get(head, 0) + n
        for head, n in heads.items():
            bucket = crc(head, size) & mask
            found[bucket] = found.get(bucket, 0) + n
    return found


@dataclass
class Model:
    """A trained machine; ``place`` maps a bucket to its row of ``w`` and ``v`` or -1."""

    bias: float
    place: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        parts = [self.features(t) for t in texts]
        n = len(texts)
        of = np.repeat(np.arange(n), [len(at) for at, _ in parts])
        flat = np.concatenate([at for at, _ in parts]) if parts else np.zeros(0, np.int64)
        x = np.concatenate([value for _, value in parts]) if parts else np.zeros(0)
        z = self.bias + np.bincount(of, x * self.w[flat], n)
        for f in range(self.v.shape[1]):
            xv = x * self.v[flat, f]
            z += 0.5 * (np.bincount(of, xv, n) ** 2 - np.bincount(of, xv * xv, n))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, values) of the chosen terms: 1 + ln(occurrences)."""
        counts = term_counts(text)
        at = self.place[np.fromiter(counts, np.int64, len(counts))]
        n = np.fromiter(counts.values(), float, len(counts))
        return at[at >= 0].astype(np.int64), 1 + np.log(n[at >= 0])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, terms: int, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors by Adam on the logistic loss.
    ``rows`` hold the term numbers and values of each text."""
    rng = np.random.default_rng(seed)
    share = labels.mean()
    params = [np.array([np.log(share / (1 - share))]), np.zeros(terms), rng.normal(0, 0.01, (terms, FACTORS))]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    epochs = max(EPOCHS, math.ceil(LEAST_STEPS / math.ceil(len(rows) / BATCH)))
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), RATE / (1 + epoch * EPOCHS / epochs / 10)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            x = np.zeros((len(part), terms), np.float32)
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            bias, w, v = params
            xv = x @ v
            z = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - (x**2) @ (v**2).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) / len(part)
            back = x.T @ error
            grads = [np.array([error.sum()]), back + L2 * w, x.T @ (error[:, None] * xv) - v * ((x**2).T @ error)[:, None] + L2 * v]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled rows of ``docs`` outside the held-out fold."""
    none = np.full(BUCKETS, -1, np.int16)
    known = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", FOLDS) != HELD_OUT)
    sample = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    picked = [(r[0], r[1]) for r in sample.collect()]
    if not picked:
        return Model(-35.0, none, np.zeros(0), np.zeros((0, FACTORS)))
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = F.broadcast(spark.createDataFrame(picked, f"doc_id {kind}, label int"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(mine, "doc_id")
    texts = materialise(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity_sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            for label, text in zip(batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                counts[label, np.fromiter(term_counts(text), np.int64)] += 1
                rows[label] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        # bucket -1 carries the number of rows
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[rows[0], counts[0, at]]), pa.array(np.r_[rows[1], counts[1, at]])], names=["bucket", "clean", "toxic"])

    sums = map_arrow(texts, counted, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).collect()
    table = {r[0]: (r[1], r[2]) for r in sums}
    n0, n1 = table.pop(-1, (0, 0))
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Model(float(np.clip(np.log(max(share, 1e-20) / max(1 - share, 1e-20)), -35, 35)), none, np.zeros(0), np.zeros((0, FACTORS)))
    buckets = np.array(sorted(table), np.int64)
    a, b = (np.array([table[k][i] for k in buckets.tolist()], float) for i in (1, 0))
    gap = a * (n0 - b) - b * (n1 - a)
    chi = (n0 + n1) * gap**2 / np.maximum((a + b) * (n0 + n1 - a - b) * n0 * n1, 1)
    chi[a + b < LEAST_ROWS] = 0
    chosen = np.sort(buckets[np.lexsort((buckets, -chi))[:TERMS]])
    place = none
    place[chosen] = np.arange(len(chosen))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(0.0, place, np.zeros(0), np.zeros((0, 0)))
        for batch in slices(batches, "text"):
            found = [model.features(t) for t in text_bytes(batch.column(2))]
            at = pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary())
            value = pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), at, value], names=["doc_id", "label", "terms", "x"])

    found = map_arrow(texts, featured, f"doc_id {kind}, label int, terms binary, x binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[2]), bytes(r[3])))
    rows = [(np.frombuffer(bytes(r[2]), np.uint16).astype(np.int64), np.frombuffer(bytes(r[3]), np.float32)) for r in found]
    return Model(*_placed(train(rows, np.array([r[1] for r in found], float), len(chosen)), place))


def _placed(trained: tuple, place: np.ndarray) -> tuple:
    bias, w, v = trained
    return bias, place, w, v


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = model.scores(text_bytes(batch.column(2)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array(scores >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; columns stay as they are."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = model.scores(text_bytes(batch.column("text")))
            yield batch.filter(pa.array(scores < 0.5))

    return map_arrow(docs, run, docs.schema)
