"""Quality: random Fourier features of document statistics, ridge regression by partition sums, isotonic calibration.

Statistics describe a text's bytes, words and lines (shares of character classes, lengths, repetition). Standardised, they go
through random Fourier features, which approximate a Gaussian kernel. Each partition sums its labelled rows' normal equations,
a matrix of fixed size; the sums give the ridge weights. A fifth of the learning rows is kept out of the fit: their scores, in bins,
fit an isotonic curve from raw score to the probability of label 1.

Defined results: a null or empty text has all statistics zero and is scored like any other; without learning rows of both classes
every score is the share of class 1 among the labels (0.5 without any); repeated label rows of an id count once (the largest label); rows
that repeat an id are scored each for itself and learned from each; a null id is scored and never learned from; texts of any length are
read whole; ties have equal scores; further columns of the input are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, lists_of, small_batches, staged, texts

_ascii = np.arange(256)
#: Byte classes whose shares are statistics.
CLASSES = np.stack([
    np.isin(_ascii, list(b"abcdefghijklmnopqrstuvwxyz")),
    np.isin(_ascii, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    np.isin(_ascii, list(b"0123456789")),
    np.isin(_ascii, list(b" \t")),
    np.isin(_ascii, list(b"\n\r")),
    np.isin(_ascii, list(b".,;:!?")),
    np.isin(_ascii, list(b"'\"()-")),
    np.isin(_ascii, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    _ascii >= 0x80,
    np.isin(_ascii, list(b"eaoiu")),
]).astype(float)
N_STATS = len(CLASSES) + 11


def statistics(text: bytes | None) -> np.ndarray:
    out = np.zeros(N_STATS)
    if not text:
        return out
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    k = len(CLASSES)
    out[:k] = CLASSES @ bytes_ / len(text)
    p = bytes_[bytes_ > 0] / len(text)
    words, lines = text.lower().split(), text.split(b"\n")
    distinct = set(words)
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = len(words) - len(distinct)
    out[k:] = [
        np.log1p(len(text)), np.log1p(len(words)), -(p * np.log2(p)).sum(), lengths.mean(), lengths.std(), (lengths <= 3).mean(),
        counts / n, 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), sum(w[-1:] in b".!?" for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and stats, an array of N_STATS doubles."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in batch.column(1).to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists_of(flat, [N_STATS] * len(rows), pa.float64())], names=["doc_id", "stats"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, stats array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def summed(df: DataFrame, part, size: int) -> np.ndarray:
    """The sum over all rows of part(batch), an array of `size` doubles: per partition, then in groups, then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    parts = df.mapInArrow(run, "total binary")
    return sum((np.frombuffer(r.total) for r in parts.repartition(8).mapInArrow(join, "total binary").collect()), np.zeros(size))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(x @ self.omega + self.phase), x, np.ones((len(x), 1))], 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features(stats) @ self.weight, self.raw, self.calibrated)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising fit to positive / total, weighted by total."""
    blocks: list[list[float]] = []
    for p, n in zip(positive.tolist(), total.tolist()):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.concatenate([np.full(int(k), p / n) for p, n, k in blocks])


BINS = 512


def quality_model(stats: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality", features: int = 192, gamma: float = 0.12, ridge: float = 1.0, seed: int = 11) -> Model:
    """A model of stats (doc_id, stats) learned from the labelled rows that `where` (on doc_id) admits."""
    known = labels.where(where & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("label"))
    rows = staged(stats.where(where).join(known, "doc_id").withColumn("kept_out", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0), "labelled")
    model = fitted(rows, features, gamma, ridge, seed)
    dropped(rows)
    return model


def fitted(rows: DataFrame, features: int, gamma: float, ridge: float, seed: int) -> Model:
    """A model of staged rows (doc_id, stats, label, kept_out); those kept out calibrate it."""
    rng = np.random.default_rng(seed)
    size = N_STATS
    first = summed(rows, lambda b: (lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]))(matrix(b.column(1), size), np.asarray(b.column(2))), 2 + 2 * size)
    n = max(first[0], 1.0)
    mean = first[2 : 2 + size] / n
    scale = np.sqrt(np.maximum(first[2 + size :] / n - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 * gamma), (size, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + size + 1), np.array([0.0]), np.array([first[1] / n if first[0] else 0.5]))
    if not 0 < first[1] < first[0]:
        return model
    width = len(model.weight)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        fit = ~np.asarray(batch.column(3))
        z = model.features(matrix(batch.column(1), size)[fit])
        return np.concatenate([(z.T @ z).ravel(), z.T @ np.asarray(batch.column(2))[fit]])

    sums = summed(rows, equations, width * (width + 1))
    gram = sums[: width * width].reshape(width, width)
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    model.weight = np.linalg.solve(gram + np.diag(penalty), sums[width * width :])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        out = np.asarray(batch.column(3))
        raw = model.features(matrix(batch.column(1), size)[out]) @ model.weight
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, np.asarray(batch.column(2))[out], BINS), np.bincount(at, minlength=BINS), np.bincount(at, raw, BINS)])

    positive, total, raw = np.split(summed(rows, bins, 3 * BINS), 3)
    some = total > 0
    if some.any():
        model.raw, model.calibrated = raw[some] / total[some], isotonic(positive[some], total[some])
    else:
        model.raw, model.calibrated = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= threshold) of every row of stats."""
    held = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.clip(held.value.score(matrix(batch.column(1), N_STATS)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
