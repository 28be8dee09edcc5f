"""Supervised quality classifier: hashed word and character n-gram vectors, averaged, softmax, numpy SGD."""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import SpanHash, code_points, mix, pieces, tasks_for

#: Learned vectors and their length.
BUCKETS, DIMENSIONS = 1 << 18, 8
#: Labelled rows that the classifier is fitted on, at most this many of each class, chosen by a hash of the id.
ROWS_PER_CLASS = 5000
EPOCHS, RATE, SEED = 3, 1.0, 7
THRESHOLD = 0.7
GRAMS = (2, 3, 4)
_WHITE = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_TABLE = 1 << 16


@dataclass
class Model:
    """Feature vectors, the output layer's weights and biases for labels 0 and 1."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, weights=self.weights, bias=self.bias)
        return out.getvalue()

    @staticmethod
    def loads(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as f:
            return Model(f["vectors"], f["weights"], f["bias"])

    def margins(self) -> tuple[np.ndarray, float]:
        """Per feature, what it adds to the log-odds of label 1; the softmax of two outputs needs no more."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


class Features:
    """Hashed features of texts: character n-grams inside words (word ends marked), words, and word pairs.

    Words are what white space separates, in their own case.
    """

    def __init__(self, buckets: int = BUCKETS):
        self.shift = np.uint64(64 - int(buckets).bit_length() + 1)
        self.table = mix(np.arange(_TABLE, dtype=np.uint64) + np.uint64(11))
        self.white = np.zeros(_TABLE, bool)
        self.white[_WHITE] = True
        self.factors = mix(np.arange(1, 9, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)

    def _bucket(self, x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(29))) * self.factors[7]
        return (x >> self.shift).astype(np.int32)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (bucket, text), one pair per kind of feature."""
        points, offsets = code_points(texts)
        n = len(points)
        if n == 0:
            return
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
        at = np.minimum(points, _TABLE - 1)
        inside = ~self.white[at]
        m = self.table[at]
        far = np.flatnonzero(points >= _TABLE)
        if len(far):
            m[far] = mix(points[far].astype(np.uint64) + np.uint64(11))
        joint = inside[:-1] & inside[1:] & (owner[:-1] == owner[1:])
        start = inside.copy()
        start[1:] &= ~joint
        end = inside.copy()
        end[:-1] &= ~joint
        value = m * self.factors[0] + start * self.factors[5]
        whole = np.ones(n, bool)
        for size in range(2, max(GRAMS) + 1):
            if n < size:
                break
            value = value[: n - size + 1] + m[size - 1 :] * self.factors[size - 1]
            whole = whole[: n - size + 1] & joint[size - 2 :]
            if size in GRAMS:
                keep = np.flatnonzero(whole)
                yield self._bucket(value[keep] + end[keep + size - 1] * self.factors[6]), owner[keep]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        words = SpanHash(m)(starts, ends)
        text = owner[starts]
        yield self._bucket(words), text
        pair = text[1:] == text[:-1]
        both = words[:-1] * self.factors[1] + words[1:] * self.factors[2]
        yield self._bucket(both[pair]), text[1:][pair]


def bags(features: Features, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their share of its features."""
    found = list(features(texts))
    bucket = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int32)
    owner = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int32)
    keys, counts = np.unique(owner.astype(np.int64) << 32 | bucket, return_counts=True)
    edges = np.searchsorted(keys >> 32, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        total = counts[a:b].sum()
        yield (keys[a:b] & 0xFFFFFFFF).astype(np.int32), (counts[a:b] / max(1, total)).astype(np.float32)


class Shelf(Sequence):
    """Bags in an unnamed temporary file, each read as it is asked for; memory holds only where each one ends."""

    def __init__(self):
        self.file, self.ends = tempfile.TemporaryFile(buffering=0), [0]

    def add(self, index: np.ndarray, amount: np.ndarray) -> None:
        raw = memoryview(index.tobytes() + amount.tobytes())
        self.ends.append(self.ends[-1] + len(raw))
        while raw:
            raw = raw[self.file.write(raw) :]

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, end = self.ends[i], self.ends[i + 1]
        raw = bytearray()
        while len(raw) < end - at:
            part = os.pread(self.file.fileno(), end - at - len(raw), at + len(raw))
            if not part:
                raise EOFError(f"bag {i} ends early")
            raw += part
        half = len(raw) // 2
        return np.frombuffer(raw[:half], np.int32), np.frombuffer(raw[half:], np.float32)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, buckets: int = BUCKETS, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over bags; classes weigh the same, the rate falls linearly.

    With one class only, all features stay neutral and the bias names that class; without rows the score is 0.5.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (buckets, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) if len(labels) else np.zeros(2)
    if share.min() == 0:
        bias[:] = [10.0 * (share[0] > 0), 10.0 * (share[1] > 0)]
        return Model(np.zeros_like(vectors), weights, bias)
    balance = len(labels) / (2.0 * share)
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)).tolist():
            index, amount = rows[i]
            now = rate * (1 - step / steps)
            step += 1
            mean = amount @ vectors[index] if len(index) else np.zeros(DIMENSIONS, np.float32)
            z = weights @ mean + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[i]] -= 1
            error *= now * balance[labels[i]]
            back = error @ weights
            weights -= np.outer(error, mean).astype(np.float32)
            bias -= 0.1 * error
            if len(index):
                vectors[index] -= np.outer(amount, back).astype(np.float32) * 10
    return Model(vectors, weights, bias)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all texts and labels that come, in one task; whatever their length, their bags do not fill its memory."""
    features, rows, found = Features(), Shelf(), []
    for batch in batches:
        for piece in pieces(batch, "text"):
            for bag in bags(features, piece.column("text")):
                rows.add(*bag)
            found += piece.column("label").to_pylist()
    yield pa.RecordBatch.from_pydict({"model": [train(rows, np.array(found, np.int64)).dumps()]})


def fit_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", usable: Column | None = None, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Fit the classifier on whole texts of at most ``rows_per_class`` labelled rows of each class.

    Rows are taken in the order of a hash of their id, so the sample is the same in every run.  Labels other than 0 and
    1 and null ids are left out, as are rows for which ``usable`` (a column over the labels) does not hold.
    """
    tasks = tasks_for(labels)
    chosen = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("label"), (F.lit(True) if usable is None else usable).alias("ok"))
    chosen = chosen.where("ok AND l_id IS NOT NULL AND label IN (0, 1)").select("l_id", "label").distinct().coalesce(tasks)
    order = [F.xxhash64("l_id"), F.col("l_id")]
    sample = chosen.where("label = 0").orderBy(*order).limit(rows_per_class).union(chosen.where("label = 1").orderBy(*order).limit(rows_per_class))
    # the sample is bounded by its two limits
    texts = docs.select(F.col(id_col).alias("l_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "l_id")
    # of rows that repeat an id one is learned, the first in order
    one = texts.groupBy("l_id", "label").agg(F.min("text").alias("text"))
    texts = one.select("l_id", "label", "text").coalesce(tasks).orderBy(F.xxhash64("l_id"), "l_id", "label").coalesce(1)

    made = texts.mapInArrow(_learned, "model binary").collect()
    return Model.loads(bytes(made[0]["model"])) if made else train([], np.zeros(0, np.int64))


def score_quality(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1 for every whole text; a null or empty text gets that of the bias alone.

    Only the text is read for the score.  An input column named ``score_col`` is replaced, all others stay.
    """
    margin, base = model.margins()
    shared = docs.sparkSession.sparkContext.broadcast((margin, base))
    kept = [c for c in docs.columns if c != score_col]
    schema = docs.select(*kept, F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        margin, base = shared.value
        for batch in batches:
            for piece in pieces(batch, text_col):
                total, count = np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                for bucket, owner in features(piece.column(text_col)):
                    total += np.bincount(owner, weights=margin[bucket], minlength=piece.num_rows)
                    count += np.bincount(owner, minlength=piece.num_rows)
                odds = total / np.maximum(count, 1) + base
                score = 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(score)], names=[*kept, score_col])

    return docs.mapInArrow(run, schema)
