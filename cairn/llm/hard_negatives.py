"""Hard negatives: for every anchor and each of its nearest rows of the same label, the best rows of other labels that score a little less.

Scores are inner products of whole numbers. Every vector is coded by product quantisation: its components are taken two by two, and each pair
becomes the number of the nearest of 256 codewords, which are whole numbers as well, fitted on a bounded sample. What the code leaves
of the vector is kept as its norm. A row's score for an anchor is then its sum over the anchor's lookup table, give or take the
residual norm times the anchor's norm (Cauchy and Schwarz), so a row whose upper bound stays below what an anchor has already, or
whose bounds miss its window, is surely not among the results. Whoever stays is scored exactly, as whole numbers, and the exact scores
fill the windows. The sample changes only how much is left to score.

Anchors are a stated query set against all rows. They go in blocks of bounded size to all tasks, and each task keeps for each anchor of the block, and for
each window, no more than the rows asked for; so what is shuffled is a few rows per task, and no task holds more than a batch of rows.
A block takes two passes over the coded rows: one for the positives, one for the windows below them.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do empty vectors and those whose squared
norm reaches 2^62, beyond which scores are no longs; vectors of different length never meet; a row that has the anchor's id is neither
its positive nor its negative; rows that repeat an id count each by themselves, and so do anchors; an anchor without positives has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import dropped, grown, hash_number, small_batches, staged

#: Components coded together, codewords of each such part, and rows of each vector length that these are fitted on, at most about.
PART = 2
WORDS = 256
SAMPLE = 20_000
ROUNDS = 8
#: Anchors of one block, anchors and rows scored together, and pairs scored exactly together.
BLOCK = 4096
ANCHORS_AT_ONCE, ROWS_AT_ONCE, PAIRS_AT_ONCE = 256, 2048, 1 << 17
#: Vectors beyond this squared norm don't take part.
MOST_SQUARE = float(1 << 62)
#: What rounding of double bounds can amount to, as a share of the product of two norms.
SLACK = 1e-9


def fitted(sample: np.ndarray) -> np.ndarray:
    """[parts, WORDS, PART] codewords in whole numbers for vectors [rows, components], by a few rounds of k-means in each part."""
    rows, size = sample.shape
    rng = np.random.default_rng(7)
    padded = np.zeros((rows, -(-size // PART) * PART))
    padded[:, :size] = sample
    books = []
    for part in range(0, padded.shape[1], PART):
        x = padded[:, part : part + PART]
        words = x[rng.choice(rows, WORDS, replace=rows < WORDS)].copy()
        for _ in range(ROUNDS):
            near = nearest(x, words)
            count = np.bincount(near, minlength=WORDS)
            for k in range(PART):
                total = np.bincount(near, x[:, k], WORDS)
                words[:, k] = np.where(count > 0, total / np.maximum(count, 1), words[:, k])
        books.append(np.rint(words))
    return np.array(books)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1)[None, :] - 2 * x @ words.T).argmin(1)


def coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code [rows, parts] of vectors in whole numbers, and the norm of what it leaves of each."""
    padded = np.zeros((len(x), len(books) * PART))
    padded[:, : x.shape[1]] = x
    code, square = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
    for part, words in enumerate(books):
        own = padded[:, part * PART : (part + 1) * PART]
        code[:, part] = near = nearest(own, words)
        square += ((own - words[near]) ** 2).sum(1)
    return code, np.sqrt(square)


def vectors(column: pa.Array) -> np.ndarray:
    """[rows, components] of binary vectors of equal length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), -1)


def whole_numbers(embeddings: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, size, v): the rows that take part, their components as whole numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector_col) > 0)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = embeddings.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    return rows.where(square < MOST_SQUARE).select("vec_id", "label", F.size("v").alias("size"), F.transform("v", lambda x: x.cast("long")).alias("v"))


def codebooks(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, codewords fitted on about SAMPLE rows chosen by a hash of their ids."""
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}
    chosen = F.lit(False)
    for size, count in counts.items():
        chosen = chosen | ((F.col("size") == size) & (hash_number("vec_id") < SAMPLE / count))
    sample = rows.where(chosen).select("size", "v").toArrow() if counts else None
    books = {}
    for size in counts:
        some = sample.filter(pa.array(np.asarray(sample.column("size")) == size)).column("v").combine_chunks()
        books[size] = fitted(np.asarray(some.flatten(), float).reshape(len(some), -1) if len(some) else np.zeros((1, size)))
    return books


def coded_rows(rows: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, label, size, v, code, rest): rows with their codes and residual norms, vectors and codes as bytes."""
    held = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                x = np.asarray(own.column(3).flatten(), np.int64).reshape(own.num_rows, -1)
                code, rest = coded(x.astype(float), held.value[int(size)])
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays([*own.columns[:3], raw(x), raw(code), pa.array(rest)], names=["vec_id", "label", "size", "v", "code", "rest"])

    return rows.mapInArrow(run, "vec_id long, label long, size int, v binary, code binary, rest double")


class Best:
    """For each list of a block (an anchor, or a window of one), the best rows so far: falling exact scores, ties by the smaller id."""

    def __init__(self, lists: int, most: int):
        self.most = most
        self.score = np.full((lists, most), np.iinfo(np.int64).min, np.int64)
        self.id = np.zeros((lists, most), np.int64)
        self.size = np.zeros(lists, np.int64)

    def least(self) -> np.ndarray:
        """The score that a row needs at least to enter each list."""
        return np.where(self.size == self.most, self.score[:, -1].astype(float), -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        if not len(at):
            return
        lists = np.unique(at)
        old = np.repeat(lists, self.size[lists])
        slot = np.arange(len(old)) - np.repeat(np.cumsum(self.size[lists]) - self.size[lists], self.size[lists])
        at, score, vec_id = np.append(at, old), np.append(score, self.score[old, slot]), np.append(vec_id, self.id[old, slot])
        # The complement falls where the score rises, without overflow.
        order = np.lexsort((vec_id, ~score, at))
        at, score, vec_id = at[order], score[order], vec_id[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        kept = place < self.most
        self.score[at[kept], place[kept]], self.id[at[kept], place[kept]] = score[kept], vec_id[kept]
        self.size[lists] = np.minimum(np.diff(np.append(first, len(at))), self.most)

    def rows(self, names: list[str]) -> pa.RecordBatch:
        at, place = np.nonzero(np.arange(self.most)[None, :] < self.size[:, None])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(self.score[at, place]), pa.array(self.id[at, place])], names=names)


class Block:
    """Anchors of one vector length: numbers within the whole block, ids, labels, vectors, and the lookup table of each."""

    def __init__(self, number: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray, books: np.ndarray):
        self.number, self.vec_id, self.label, self.v = number, vec_id, label, v
        self.norm = np.sqrt((v.astype(float) ** 2).sum(1))
        padded = np.zeros((len(v), len(books) * PART))
        padded[:, : v.shape[1]] = v
        self.table = np.einsum("apk,pwk->apw", padded.reshape(len(v), len(books), PART), books)

    def bounds(self, some: slice, code: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[anchors, rows] between which each exact score surely lies."""
        table = self.table[some]
        middle = np.zeros((len(table), len(code)))
        for part in range(table.shape[1]):
            middle += np.take(table[:, part], code[:, part], axis=1)
        reach = self.norm[some, None] * (rest + SLACK * norm)[None, :] + 1e-6
        return middle - reach, middle + reach


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of rows i of a with rows j of b, as whole numbers."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS_AT_ONCE):
        out[k : k + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", a[i[k : k + PAIRS_AT_ONCE]], b[j[k : k + PAIRS_AT_ONCE]])
    return out


def scan(held, visit: Callable[[Block, slice, pa.RecordBatch], None], out: Callable[[], Iterator[pa.RecordBatch]]):
    """A task's pass over coded rows: every row meets the anchors of its vector length, some rows and some anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for size in np.unique(sizes).tolist():
                block = held.value.get(size)
                if block is None:
                    continue
                own = batch.filter(pa.array(sizes == size))
                for k in range(0, own.num_rows, ROWS_AT_ONCE):
                    rows = own.slice(k, ROWS_AT_ONCE)
                    for s in range(0, len(block.number), ANCHORS_AT_ONCE):
                        visit(block, slice(s, s + ANCHORS_AT_ONCE), rows)
        yield from out()

    return run


def parts_of(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Ids, labels, vectors, codes, residual norms and norms of coded rows."""
    v = vectors(rows.column("v"))
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return np.asarray(rows.column("vec_id")), np.asarray(rows.column("label")), v, code, np.asarray(rows.column("rest")), np.sqrt((v.astype(float) ** 2).sum(1))


def nearest_alike(held, anchors: int, most: int):
    """Per task: for each anchor the `most` best rows of its own label (anchor, score, vec_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(anchors, most)

        def visit(block: Block, some: slice, rows: pa.RecordBatch) -> None:
            vec_id, label, v, code, rest, norm = parts_of(rows)
            number = block.number[some]
            alike = (block.label[some, None] == label[None, :]) & (block.vec_id[some, None] != vec_id[None, :])
            _, high = block.bounds(some, code, rest, norm)
            i, j = np.nonzero(alike & (high >= best.least()[number][:, None]))
            best.add(number[i], exact(block.v[some], i, v, j), vec_id[j])

        yield from scan(held, visit, lambda: iter([best.rows(["anchor", "score", "vec_id"])]))(batches)

    return run


def windows_below(held, score_of: np.ndarray, held_places: np.ndarray, most: int, low: int, high: int):
    """Per task: for each window (anchor * positives + place of the positive) the `most` best rows of other labels in it (window, score, vec_id).

    score_of: [anchors, positives] the positives' scores; held_places: which of them there are.
    """
    anchors, positives = score_of.shape
    edge = np.where(held_places, score_of.astype(float), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(anchors * positives, most)

        def visit(block: Block, some: slice, rows: pa.RecordBatch) -> None:
            vec_id, label, v, code, rest, norm = parts_of(rows)
            unlike = (block.label[some, None] != label[None, :]) & (block.vec_id[some, None] != vec_id[None, :])
            lower, upper = block.bounds(some, code, rest, norm)
            least, number = best.least(), block.number[some]
            window = number[:, None] * positives + np.arange(positives)
            # Slack makes up for rounding of the window's ends; what passes is decided by whole numbers.
            top = edge[number]
            slack = np.where(np.isfinite(top), 1 + SLACK * np.abs(top), 0)
            end, begin = top * high / 100, np.maximum(top * low / 100, least[window])
            fits = np.zeros(unlike.shape, bool)
            for w in range(positives):
                fits |= (lower <= (end + slack)[:, w, None]) & (upper >= (begin - slack)[:, w, None])
            i, j = np.nonzero(unlike & fits)
            if not len(i):
                return
            score = exact(block.v[some], i, v, j)
            for w in range(positives):
                inside = held_places[number[i], w] & within(score_of[number[i], w], score, low, high) & (score >= least[window[i, w]])
                best.add(window[i, w][inside], score[inside], vec_id[j][inside])

        yield from scan(held, visit, lambda: iter([best.rows(["window", "score", "vec_id"])]))(batches)

    return run


def within(positive: np.ndarray, negative: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether low percent of the positive's score <= the negative's <= high percent of it, in whole numbers."""
    if max(np.abs(positive).max(initial=0), np.abs(negative).max(initial=0)) >= 1 << 54:
        positive, negative = positive.astype(object), negative.astype(object)
    return ((low * positive <= 100 * negative) & (100 * negative <= high * positive)).astype(bool)


def ranked(found: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` best rows (score, vec_id) of each key, with their rank from 1."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    embeddings: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor and each of its first `positives` rows of the
    same label, the first `negatives` rows of other labels whose score is between `low` and `high` percent of the positive's.

    A component x counts as floor(scale * x). Higher scores come first, ties by the smaller id. anchors: a condition on vec_id, by
    default that 100 divides it.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    rows = staged(whole_numbers(embeddings, scale, id_col, label_col, vector_col), "vectors")
    books = codebooks(rows)
    codes = staged(coded_rows(rows, books), "codes")
    asked = codes.where(anchors if anchors is not None else F.col("vec_id") % 100 == 0).select("vec_id", "label", "size", "v")
    asked = staged(asked.withColumn("at", F.monotonically_increasing_id()), "anchors")
    blocks = -(-asked.count() // block)
    out = None
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == k).drop("at").toArrow()
        if not own.num_rows:
            continue
        sizes = np.asarray(own.column("size"))
        held = {}
        for size in np.unique(sizes).tolist():
            number = np.flatnonzero(sizes == size)
            some = own.take(pa.array(number))
            held[size] = Block(number, np.asarray(some.column("vec_id")), np.asarray(some.column("label")), vectors(some.column("v")), books[size])
        sent = spark.sparkContext.broadcast(held)
        kinds = "score long, vec_id long"
        alike = ranked(codes.mapInArrow(nearest_alike(sent, own.num_rows, positives), f"anchor long, {kinds}"), "anchor", positives).toArrow()
        at, place = np.asarray(alike.column("anchor")), np.asarray(alike.column("rank")) - 1
        score, there = np.zeros((own.num_rows, positives), np.int64), np.zeros((own.num_rows, positives), bool)
        score[at, place], there[at, place] = np.asarray(alike.column("score")), True
        below = ranked(codes.mapInArrow(windows_below(sent, score, there, negatives, low, high), f"window long, {kinds}"), "window", negatives)
        # One row for each anchor of the block and place: at most block * positives or so.
        of_window = pa.table({"window": at * positives + place, "anchor_id": np.asarray(own.column("vec_id"))[at], "positive_id": np.asarray(alike.column("vec_id")), "positive_score": np.asarray(alike.column("score"))})
        named = below.join(F.broadcast(spark.createDataFrame(of_window)), "window")
        out = grown(out, named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        sent.destroy()
    dropped(rows, asked, codes)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
