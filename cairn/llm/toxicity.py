"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of the word itself, all hashed into one table; a span's
vector is the mean of its words'; a linear softmax gives its class. A toxic remark in a long text would drown in a mean over
the whole text, so a text's score is that of its most toxic span of `span` consecutive words (of all words, if it has fewer):
training first learns from means over whole texts, then from each text's currently most toxic span. Because the softmax is
linear, a word's share of a span's score is one number, worked out once per distinct word.

Learning uses at most about `rows` labelled texts of each class, chosen by a hash of doc_id alone, whole whatever their length:
tasks split them into rows of at most PART words, as numbers of the row's distinct words, and the driver keeps four bytes a word.
The bias is corrected by the classes' shares among all labels; scoring reads every whole text.

Defined results: a null or empty text, or one without words, is scored as an empty span (the learned bias alone); without labelled
rows of both classes every score is the share of class 1 among the labels (0 without any); rows with a null id are scored as well and
never learned from; rows that repeat an id are scored each for itself, and each is learned from; of spans that tie the first counts; of
several labels of an id the largest counts; texts of any length are scored whole; further columns of the input are not needed.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import labelled_sample, lists_of, small_batches, texts
from cairn.llm.decontaminate import words_of
from cairn.llm.subwords import WordIds, WordTable, ngrams

SIZES = (3, 4, 5, 6, 7)
BUCKETS = 1 << 19
#: An n-gram bucket that fewer training texts hold isn't learned: it would only memorise them.
LEAST_TEXTS = 4
#: Words of a sampled text in one row.
PART = 8192


@dataclass
class Model:
    """weight: of each n-gram bucket, its vector times the difference of the softmax's two rows; learned: which buckets have one."""

    weight: np.ndarray
    learned: np.ndarray
    bias: float
    span: int

    def words(self, words: list[bytes]) -> np.ndarray:
        owner, bucket = ngrams(words, SIZES, BUCKETS)
        count = np.bincount(owner, self.learned[bucket], len(words))
        return np.bincount(owner, self.weight[bucket], len(words)) / np.maximum(count, 1)

    def logit(self, shares: np.ndarray) -> float:
        """Of a text, from its words' shares."""
        return self.bias + (top_span(shares, self.span)[1] if len(shares) else 0.0)


def top_span(shares: np.ndarray, span: int) -> tuple[int, float]:
    """Where the span of consecutive words with the largest mean starts, and that mean."""
    if len(shares) <= span:
        return 0, float(shares.mean())
    total = np.cumsum(np.concatenate([[0.0], shares]))
    means = (total[span:] - total[:-span]) / span
    at = int(means.argmax())
    return at, float(means[at])


def log_odds(share: float) -> float:
    return float(np.log((share + 1e-9) / (1 - share + 1e-9)))


def train(sample: list[tuple[bytes, int]], share: float | None = None, **how) -> Model:
    """share: of class 1 among all labelled texts, if the sample's differs from it."""
    vocabulary = WordIds()
    docs = [(np.array([vocabulary[w] for w in words_of(t)], np.int32), y) for t, y in sample]
    return fit(list(vocabulary), docs, share, **how)


def fit(vocabulary: list[bytes], docs: list[tuple[np.ndarray, int]], share: float | None = None, span: int = 2, dims: int = 8, seed: int = 7, rounds: int = 40, warm: int = 12, rate: float = 0.1) -> Model:
    """docs: the numbers of a text's words in the vocabulary, in order, and its class."""
    rng = np.random.default_rng(seed)
    docs = [(i, y) for i, y in docs if len(i)]
    positive = sum(y for _, y in docs)
    if share is None:
        share = positive / len(docs) if docs else 0.0
    if not positive or positive == len(docs):
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), log_odds(share), span)
    ids = [i for i, _ in docs]
    y = np.array([y for _, y in docs], float)
    owner, bucket = grams_by_word(vocabulary)
    sizes = np.bincount(owner, minlength=len(vocabulary))
    first = np.cumsum(sizes) - sizes
    texts_with = np.zeros(BUCKETS, np.int32)
    bags = [np.unique(i, return_counts=True) for i in ids]
    for words, _ in bags:
        texts_with[np.unique(bucket[spread(first[words], sizes[words])])] += 1
    learned = texts_with >= LEAST_TEXTS
    keep = learned[bucket]
    sizes = np.bincount(owner[keep], minlength=len(vocabulary))
    # From here on a bucket's number is its place among the learned ones.
    bucket = (np.cumsum(learned, dtype=np.int32) - 1)[bucket[keep]]
    del owner, keep
    first = np.cumsum(sizes) - sizes
    table = rng.normal(0, 0.1, (BUCKETS, dims))[learned].astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (2, dims)).astype(np.float32), np.zeros(2, np.float32)
    moments: dict[int, list[np.ndarray]] = {}
    for step in range(1, rounds + 1):
        if step > warm:
            weight = table @ (soft[1] - soft[0])
            shares = np.zeros(len(vocabulary))
            for part, grams, of in gram_parts(np.arange(len(vocabulary)), first, sizes, bucket):
                shares[part] = np.bincount(of, weight[grams], part.stop - part.start)
            shares /= np.maximum(sizes, 1)
            picked = [i if len(i) <= span else i[(at := top_span(shares[i], span)[0]) : at + span] for i in ids]
            times = np.ones(sum(map(len, picked)))
        else:
            picked = [words for words, _ in bags]
            times = np.concatenate([count for _, count in bags]).astype(float)
        text = np.repeat(np.arange(len(picked)), [len(i) for i in picked])
        used, word = np.unique(np.concatenate(picked), return_inverse=True)
        n = np.bincount(text, times, len(picked))
        some = np.maximum(sizes[used], 1)[:, None]
        vectors = np.zeros((len(used), dims))
        for part, grams, of in gram_parts(used, first, sizes, bucket):
            for d in range(dims):
                vectors[part, d] = np.bincount(of, table[grams, d], part.stop - part.start)
        vectors /= some
        means = np.stack([np.bincount(text, vectors[word, d] * times, len(picked)) for d in range(dims)], 1) / n[:, None]
        z = means @ soft.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.stack([1 - y, y], 1)) / len(y)
        to_mean = (g @ soft) / n[:, None]
        to_word = np.stack([np.bincount(word, to_mean[text, d] * times, len(used)) for d in range(dims)], 1) / some
        touched, to_table = np.zeros(len(table), bool), np.zeros((dims, len(table)))
        for part, grams, of in gram_parts(used, first, sizes, bucket):
            touched[grams] = True
            for d in range(dims):
                to_table[d] += np.bincount(grams, to_word[part, d][of], len(table))
        rows = np.flatnonzero(touched)
        to_table = to_table[:, rows].T
        for k, (value, slope, where) in enumerate(((table, to_table, rows), (soft, g.T @ means + 1e-4 * soft, slice(None)), (bias, g.sum(0), slice(None)))):
            m = moments.setdefault(k, [np.zeros_like(value), np.zeros_like(value)])
            m[0][where] = 0.9 * m[0][where] + 0.1 * slope
            m[1][where] = 0.99 * m[1][where] + 0.01 * slope**2
            value[where] -= rate * (m[0][where] / (1 - 0.9**step)) / (np.sqrt(m[1][where] / (1 - 0.99**step)) + 1e-8)
    shift = log_odds(share) - log_odds(positive / len(docs))
    weight = np.zeros(BUCKETS, np.float32)
    weight[learned] = table @ (soft[1] - soft[0])
    return Model(weight, learned.astype(np.float32), float(bias[1] - bias[0]) + shift, span)


def gram_parts(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, part: int = 8192) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For each part of the words: where it stands, its n-grams' buckets and each one's word within the part; to bound the driver's memory."""
    for i in range(0, len(words), part):
        some = words[i : i + part]
        yield slice(i, i + len(some)), bucket[spread(first[some], sizes[some])], np.repeat(np.arange(len(some)), sizes[some])


def grams_by_word(words: list[bytes], part: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """ngrams() sorted by word; in parts and with narrow numbers, to bound the driver's memory."""
    owners, buckets = [], []
    for i in range(0, len(words), part):
        owner, bucket = ngrams(words[i : i + part], SIZES, BUCKETS)
        order = np.argsort(owner, kind="stable")
        owners.append((owner[order] + i).astype(np.int32))
        buckets.append(bucket[order].astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first to first + size - 1 of each pair, in order."""
    return np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    table = WordTable(model.words)
    for batch in batches:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        shares = table([w for ws in words for w in ws])
        ends = np.cumsum([len(w) for w in words])
        logits = np.array([model.logit(shares[e - len(w) : e]) for w, e in zip(words, ends)])
        yield batch, 1 / (1 + np.exp(-np.clip(logits, -60, 60)))


def numbered(sample: DataFrame) -> tuple[list[bytes], list[tuple[np.ndarray, int]]]:
    """The words of all texts of (doc_id, text, label), and each text as their numbers with its label, in the order of doc_id."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns)):
                words, row, digest = words_of(text), int.from_bytes(os.urandom(7)), xxhash.xxh64_intdigest(text or b"") >> 1
                for at in range(0, len(words), PART):
                    own = WordIds()
                    spots = np.array([own[w] for w in words[at : at + PART]], np.int32)
                    columns = [pa.array([x], pa.int64()) for x in (doc_id, digest, row, at, label)]
                    columns += [lists_of(np.array(list(own), object), [len(own)], pa.binary()), lists_of(spots, [len(spots)], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "row", "at", "label", "words", "spots"])

    parts = sample.mapInArrow(run, "doc_id long, digest long, row long, at long, label long, words array<binary>, spots array<int>").toArrow()
    keys = [parts.column(k).to_pylist() for k in ("doc_id", "digest", "row", "at", "label")]
    vocabulary, found = WordIds(), {}
    for doc_id, digest, row, at, label, k in sorted(zip(*keys, range(parts.num_rows))):
        number = np.array([vocabulary[w] for w in parts.column("words")[k].as_py()], np.int32)
        found.setdefault((doc_id, digest, row), ([], label))[0].append(number[parts.column("spots")[k].values.to_numpy()])
    return list(vocabulary), [(np.concatenate(spots), label) for spots, label in found.values()]


def toxicity_model(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "toxic", rows: int = 1500) -> Model:
    """A model learned from at most about `rows` labelled texts of each class that `where` (on doc_id) admits."""
    sample, share = labelled_sample(docs, labels, label_col, rows, where)
    return fit(*(([], []) if sample is None else numbered(sample)), share)


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= threshold) of every row of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches, held.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows that score at or above the threshold."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    base = docs.select(row.alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in scored(batches, held.value):
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(score < threshold))

    return base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}").select("row.*")
