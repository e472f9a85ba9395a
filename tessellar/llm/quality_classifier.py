"""Ordinal quality grades by a cumulative-link (proportional odds) regression on hashed text.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all grades and
increasing thresholds t_0 < t_1 < ...; x counts hashed features of the words
(the lower-cased word, its last two bytes, the classes of its outer bytes)
over the square root of the number of words. The expected grade is the sum of
the P(grade > j), the tail probability that of the highest grade.

The model is fitted on the driver from at most `max_rows` labelled rows (those
with the smallest hash of their id, the same ones each time); everything else
is one pass without a shuffle. The broadcast is the weight vector, of fixed
size.

Defined cases: a null or wordless text has x = 0, so the thresholds alone
grade it; rows of `labels` without a grade or without a document are ignored;
repeated rows give equal scores; with no usable label all grades are equally
likely; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BITS = 18
MAX_ROWS = 8000
EPOCHS = 12
BATCH = 128
RATE = 0.5
RIDGE = 1e-6

_CLASS = np.zeros(256, np.uint64)
for _low, _high, _value in ((0x30, 0x3A, 1), (0x41, 0x5B, 2), (0x61, 0x7B, 3), (0x80, 0x100, 4)):
    _CLASS[_low:_high] = _value


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words (three each) and the word offsets of the rows."""
    data, offsets = K.utf8(column)
    starts, ends, rows = K.words(data, offsets, K.BLANK_SEPARATED)
    if not len(starts):
        return np.empty((0, 3), np.int32), rows
    word = K.word_hashes(K.LOWER[data], starts, ends)
    last = data[ends - 1].astype(np.uint64)
    previous = np.where(ends - starts > 1, data[ends - 2], 0).astype(np.uint64)
    tail = K.mix(last * np.uint64(256) + previous + np.uint64(1 << 20))
    shape = K.mix(_CLASS[data[starts]] * np.uint64(64) + _CLASS[data[ends - 1]] * np.uint64(8) + np.minimum(ends - starts, 7).astype(np.uint64) + np.uint64(1 << 21))
    return np.stack([word, tail, shape], 1).view(np.int64).__and__((1 << bits) - 1).astype(np.int32), rows


class Model:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def score(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """P(grade > j), one column per threshold."""
        z = sums / np.sqrt(np.maximum(words, 1))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, *, bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Maximum likelihood by minibatch Adagrad; thresholds stay ordered as a first value and positive steps."""
    weights, second = np.zeros(1 << bits), np.full(1 << bits, 1e-6)
    shares = np.array([(grades > j).mean() if len(grades) else 0 for j in range(n_grades - 1)])
    if not len(grades):
        shares = 1 - np.arange(1, n_grades) / n_grades
    shares = np.clip(shares, 1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(np.log((1 - shares) / shares) + 1e-3 * np.arange(n_grades - 1))
    base = np.concatenate(([thresholds[0]], np.log(np.maximum(np.diff(thresholds), 1e-3))))
    base_second = np.full(len(base), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(grades) else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            sizes = np.array([len(rows[i]) for i in pick])
            index = np.concatenate([rows[i] for i in pick])
            scale = 1 / np.sqrt(np.maximum(sizes / 3, 1))
            owner = np.repeat(np.arange(len(pick)), sizes)
            z = np.bincount(owner, weights[index], len(pick)) * scale
            steps = np.concatenate(([base[0]], np.exp(base[1:])))
            cuts = np.cumsum(steps)
            # P(grade > j) with +-inf outside: likelihood of a grade is the difference of neighbours
            upper = 1 / (1 + np.exp(np.clip(cuts[None, :] - z[:, None], -50, 50)))
            full = np.concatenate([np.ones((len(pick), 1)), upper, np.zeros((len(pick), 1))], 1)
            y = grades[pick]
            row = np.arange(len(pick))
            p = np.maximum(full[row, y] - full[row, y + 1], 1e-9)
            slope = full * (1 - full)
            gz = (slope[row, y] - slope[row, y + 1]) / p
            gc = np.zeros((len(pick), n_grades + 1))
            gc[row, y] -= slope[row, y] / p
            gc[row, y + 1] += slope[row, y + 1] / p
            gc = gc[:, 1:-1].mean(0)
            gradient = np.bincount(index, (gz * scale / len(pick))[owner], 1 << bits) - RIDGE * weights
            second += gradient**2
            weights += RATE * gradient / np.sqrt(second)
            tail = np.cumsum(gc[::-1])[::-1]
            g = np.concatenate(([tail[0]], tail[1:] * np.exp(base[1:])))
            base_second += g**2
            base += 0.1 * g / np.sqrt(base_second)
    return Model(weights, np.cumsum(np.concatenate(([base[0]], np.exp(base[1:])))))


def train(docs: DataFrame, graded: DataFrame, n_grades: int, *, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """Fit on at most `max_rows` rows of `graded` (id, grade), chosen by hash of the id."""
    chosen = graded.select(F.col(id_col).cast("bigint").alias("id"), F.col("grade").cast("int").alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL").orderBy(F.xxhash64("id"), "id", "grade").limit(max_rows)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(F.broadcast(chosen), "id").select("grade", "text")  # at most max_rows short rows are broadcast

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches, "text"):
            found, rows = features(part.column("text"), bits)
            yield pa.RecordBatch.from_arrays([part.column("grade"), K.binary_array([found[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])])], ["grade", "x"])

    got = joined.mapInArrow(kernel, "grade int, x binary").collect()
    got.sort(key=lambda r: (r.grade, bytes(r.x)))
    return fit([np.frombuffer(r.x, np.int32) for r in got], np.array([r.grade for r in got], np.int64), n_grades, bits=bits)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_words, expected_grade, tail_probability (of the highest grade), selected."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(*shared.value)
        for part in K.slices(batches, "text"):
            found, rows = features(part.column("text"), bits)
            sums = np.concatenate(([0.0], np.cumsum(local.weights[found].astype(np.float64).sum(1))))
            words = np.diff(rows)
            p = local.score(sums[rows[1:]] - sums[rows[:-1]], words)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(p.sum(1).round(6)), pa.array(p[:, -1].round(6)), pa.array(p[:, -1] >= threshold)], ["doc_id", "n_words", "expected_grade", "tail_probability", "selected"])

    return source.mapInArrow(kernel, "doc_id bigint, n_words bigint, expected_grade double, tail_probability double, selected boolean")


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """Train on the labelled part of `docs` and score all of it."""
    graded = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(docs, train(docs, graded, 3), threshold=threshold)
