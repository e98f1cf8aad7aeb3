"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased bytes; their 5-, 6- and 8-grams are hashed into buckets. The log-count ratio of a
bucket compares how large a share of the toxic and of the other training texts has it. The buckets with
the largest evidence, scaled by their ratio, feed a logistic regression with an absolute-value penalty
(proximal gradient steps), so few weights stay. A text's score is the logistic of the sum over the distinct
n-grams it has; whole texts are scored, in one pass without a shuffle.

Training reads at most `MAX_POSITIVE` toxic and `MAX_NEGATIVE` other labelled texts, those that come first by a hash of
the id, and of these as many as `MAX_BYTES` bytes hold: a bounded sample whatever the size of the corpus. It is drawn
from documents that have a text, and a text that is in it is read whole. Only rows
whose crc32(doc_id as text) mod 3 is not 1 are learned from; a document with several labels is toxic if one says so.

Null and empty texts score as texts without n-grams; null ids are never learned from and aren't held out.
With no labels, or labels of one kind only, the score is the share of toxic labels (0 without any).
Repeated rows give repeated results; only doc_id and text of the documents are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrays as A

MAX_POSITIVE = 1500
MAX_NEGATIVE = 3000
MAX_BYTES = 64 << 20
GRAMS = (5, 6, 8)
BUCKET_BITS = 20
MAX_FEATURES = 4_000
#: A toxic training text counts as often as so many others.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[9:14] = 0x20


def _grams(chunk: A.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket of the n-gram at each place, and the places where a whole one starts."""
    data = _FOLD[chunk.data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[accented] += 32  # capitals of Latin-1
    prefix = A.prefix_hash(data)
    row = np.repeat(np.arange(chunk.last - chunk.first, dtype=np.int32), np.diff(chunk.offsets))
    for n in GRAMS:
        if len(data) < n:
            continue
        start = np.arange(len(data) - n + 1)
        buckets = (A.span_hash(prefix, start, start + n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        whole = row[: len(start)] == row[n - 1 :]
        yield buckets, np.where(whole, row[: len(start)], -1)


@dataclass
class Model:
    """feature: of each bucket, its place in weights or -1."""

    feature: np.ndarray
    weights: np.ndarray
    bias: float

    def sums(self, chunk: A.Chunk) -> np.ndarray:
        n = chunk.last - chunk.first
        found = []
        for buckets, row in _grams(chunk):
            feature = self.feature[buckets]
            at = np.flatnonzero((feature >= 0) & (row >= 0))
            found.append(row[at].astype(np.int64) * len(self.weights) + feature[at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        total = np.full(n, self.bias)
        if len(pairs):
            total += np.bincount(pairs // len(self.weights), weights=self.weights[pairs % len(self.weights)], minlength=n)
        return total


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _present(texts: pa.Array, feature: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each chunk: its first text, and the pairs of text and bucket, once each, for buckets whose feature isn't -1."""
    for chunk in A.chunks(texts, 1 << 20):
        pairs = np.zeros(0, np.int64)
        for buckets, row in _grams(chunk):
            some = np.flatnonzero((row >= 0) & (feature[buckets] >= 0))
            pairs = np.union1d(pairs, (row[some].astype(np.int64) << BUCKET_BITS) + buckets[some])
        yield chunk.first, pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def fit(texts: pa.Array, toxic: np.ndarray, penalty: float = 0.0003, rounds: int = 200) -> Model:
    """Ratios, choice of buckets, and the regression."""
    none = np.full(1 << BUCKET_BITS, -1, dtype=np.int32)
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return Model(none, np.zeros(0), -40.0 if share == 0 else 40.0)
    y = toxic.astype(np.float64)
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    weight /= weight.mean()
    size = 1 << BUCKET_BITS
    # twice over the sample, a chunk at a time: first how many texts have each bucket, then the chosen buckets of each text
    with_toxic, with_other = np.zeros(size), np.zeros(size)
    for first, doc, gram in _present(texts, np.zeros(size, dtype=np.int32)):
        with_toxic += np.bincount(gram, weights=y[first + doc], minlength=size)
        with_other += np.bincount(gram, weights=1 - y[first + doc], minlength=size)
    p, q = (with_toxic + 0.5) / (y.sum() + 1), (with_other + 0.5) / ((1 - y).sum() + 1)
    ratio = np.log(p / q)
    evidence = np.where(with_toxic + with_other >= 4, np.abs(p - q) * np.abs(ratio), 0)
    chosen = np.argsort(-evidence, kind="stable")[: min(MAX_FEATURES, int((evidence > 0).sum()))]
    if not len(chosen):
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))))
    feature = none.copy()
    feature[chosen] = np.arange(len(chosen))
    found = [(first + doc, feature[gram]) for first, doc, gram in _present(texts, feature)]
    doc, at = (np.concatenate(x) for x in zip(*found))
    scaled = ratio[chosen]
    n, m = len(y), len(chosen)
    value = scaled[at]
    # step: the largest squared row norm bounds the curvature
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    momentum_w, momentum_b, t = w.copy(), b, 1.0
    power = np.ones(m)
    for _ in range(20):  # largest singular value
        power = np.bincount(at, weights=value * np.bincount(doc, weights=value * power[at], minlength=n)[doc], minlength=m)
        norm = np.linalg.norm(power)
        power /= norm or 1
    step = 4 * n / ((norm + n) * weight.max())
    for _ in range(rounds):
        error = _logistic(momentum_b + np.bincount(doc, weights=value * momentum_w[at], minlength=n)) - y
        error *= weight
        slope = np.bincount(at, weights=value * error[doc], minlength=m) / n
        new = momentum_w - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = momentum_b - step * error.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum_w, momentum_b = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    stays = np.flatnonzero(w)
    feature = none.copy()
    feature[chosen[stays]] = np.arange(len(stays))
    return Model(feature, w[stays] * scaled[stays], b)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the bounded sample of labelled rows."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    # ids and sizes alone are sorted; a repeated id counts once, with its least text
    sizes = text.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash")).join(known, "doc_id")
    sizes = sizes.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("size", "text_hash")).alias("least"))
    picked = []
    for toxic, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        picked += sizes.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic", "least.size", "least.text_hash").collect()
    room, chosen = MAX_BYTES, []
    for r in sorted(picked, key=lambda r: zlib.crc32(str(r.doc_id).encode())):
        if r.size <= room:
            room -= r.size
            chosen.append((r.doc_id, r.toxic, r.text_hash))
    # at most MAX_POSITIVE + MAX_NEGATIVE rows of three numbers
    sample = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int, text_hash long")
    rows = text.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "text_hash"]).dropDuplicates(["doc_id"])
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toArrow()
    return fit(got["text"].combine_chunks(), got["toxic"].to_numpy())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and prediction of each document. The model's size is fixed by its parameters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for chunk in A.chunks(batch.column("text")):
                part = batch.slice(chunk.first, chunk.last - chunk.first)
                score = _logistic(own.sums(chunk))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(scored, SCHEMA)
