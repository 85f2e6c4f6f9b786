"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every token window of the training texts.

Test items are cut into windows of `window` words (a shorter item is one window of its own length). Words of the test set get
numbers, windows get a hash of those numbers, and each hit is verified word by word. The test set goes out in blocks of at most
`block_words` words, which bounds the broadcast at any size of the test set; with several blocks each makes its own pass over
the texts and the hits are united per document.

Defined results: a null or empty text has no words and no hits; an item without words hits nothing; rows that repeat an id are
scanned each for itself; null item ids never count; item ids may be of any type and are compared as text;
repeated item rows count once; further columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cairn.llm.common import small_batches, staged, texts

#: Every byte that is no word byte becomes a space: ASCII other than 0-9 and a-z, after lower-casing A-Z.
WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(WORD_BYTES).split()


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` consecutive word numbers."""
    n = len(ids) - length + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length if n > 0 else 0):
        out = (out ^ (ids[k : k + n].astype(np.uint64) + (out << np.uint64(7)))) * BASE
    return out


class TestSet:
    """The windows of a block of test items, to be broadcast."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = list(dict.fromkeys(item for item, _ in items))
        number = {item: k for k, item in enumerate(self.names)}
        self.numbers: dict[bytes, int] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, words in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            length = min(window, len(ids))
            if length:
                found.setdefault(length, []).append((ids, number[item]))
        for length, parts in found.items():
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, length) for ids, _ in parts])
            items_of = np.concatenate([np.full(len(ids) - length + 1, item, np.int64) for ids, item in parts])
            hashes = np.concatenate([window_hashes(ids, length) for ids, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.tables[length] = (hashes[order], rows[order].astype(np.int32), items_of[order])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """Starts and ends of the hit windows, and the items whose windows they are."""
        starts, ends, items = [], [], set()
        ids = np.fromiter(map(self.numbers.get, words, [0] * len(words)), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for length, (hashes, rows, items_of) in self.tables.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            view = np.lib.stride_tricks.sliding_window_view(ids, length)[at]
            h = np.zeros(len(at), np.uint64)
            for k in range(length):
                h = (h ^ (view[:, k].astype(np.uint64) + (h << np.uint64(7)))) * BASE
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(high > low):
                same = (rows[low[i] : high[i]] == view[i]).all(1)
                if same.any():
                    starts.append(at[i])
                    ends.append(at[i] + length)
                    items.update(items_of[low[i] : high[i]][same].tolist())
        return np.array(starts, np.int64), np.array(ends, np.int64), {self.names[k] for k in items}


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(test, text_in: int | None = None):
    """Of (doc_id, text and others), or of (doc_id, row) with the text as field text_in of the row: what is found, before the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = test.value
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in (batch.column(1) if text_in is None else batch.column(1).field(text_in).cast(pa.binary())).to_pylist():
                words = words_of(text)
                a, b, found = table.hits(words)
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(a, b)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string())), *batch.columns[1:]],
                names=["doc_id", "n_words", "spans", "items", *batch.schema.names[1:]],
            )

    return run


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most block_words words; a longer item goes in parts that overlap by all but one word of a window."""
    block, size, most = [], 0, max(window, block_words)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text")).where("item is not null and text is not null").distinct()
    for r in rows.toLocalIterator():
        words = words_of(r.text)
        for at in range(0, max(1, len(words) - window + 1), most - window + 1) if len(words) > most else [0]:
            part = words[at : at + most]
            if block and size + len(part) > most:
                yield block
                block, size = [], 0
            block.append((r.item, part))
            size += len(part)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = 1_000_000, rest: bool = False) -> DataFrame:
    """doc_id, n_words, spans (of word numbers, start to end, disjoint) and items (whose windows occur) of every row of docs.

    rest=True adds the whole row of docs as a struct `row`.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base, text_in = texts(docs, id_col, text_col), None
    if rest:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if text_col in docs.columns and docs.schema[text_col].dataType == StringType():  # the row holds it: a text travels once
            base, text_in = base.drop("text"), docs.columns.index(text_col)
    others = base.columns[1:]
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in others)
    figures = f"doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, {kinds}"
    out, passes = base, 0
    for block in test_blocks(benchmark, item_col, item_text_col, window, block_words):
        held = spark.sparkContext.broadcast(TestSet(block, window))
        if passes:
            before = out.withColumn("before", F.struct("n_words", "spans", "items"))
            out = staged(before.select("doc_id", *others, "before"), "hits").mapInArrow(unite(scan(held, text_in)), figures)
        else:
            out = base.mapInArrow(scan(held, text_in), figures)
        passes += 1
    return out.drop("text")


def unite(run):
    """run, with the spans and items of an earlier pass added."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            before = batch.column(names.index("before")).to_pylist()
            plain = pa.RecordBatch.from_arrays([c for n, c in zip(names, batch.columns) if n != "before"], names=[n for n in names if n != "before"])
            (new,) = run(iter([plain]))
            spans = [[{"start": s, "end": e} for s, e in merged(np.array([x["start"] for x in [*a, *b["spans"]]]), np.array([x["end"] for x in [*a, *b["spans"]]]))] for a, b in zip(new.column(2).to_pylist(), before)]
            items = [sorted({*a, *b["items"]}) for a, b in zip(new.column(3).to_pylist(), before)]
            yield pa.RecordBatch.from_arrays([new.column(0), new.column(1), pa.array(spans, new.column(2).type), pa.array(items, pa.list_(pa.string())), *new.columns[4:]], names=new.schema.names)

    return both


def figures(found: DataFrame) -> DataFrame:
    """The contract's columns out of contamination()."""
    ids = F.array_join(F.array_sort("items"), ",")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without its words numbered start to end, each span from the first byte of its first word to the last of its last."""
    flat = np.frombuffer(text.lower().translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : first[s]])
        at = after[e - 1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", **how) -> DataFrame:
    """docs without the documents that hold a test window (mode "documents"), or with those windows' words cut out ("spans")."""
    text_col = how.get("text_col", "text")
    found = contamination(docs, benchmark, rest=True, **how)
    if mode == "documents":
        return found.where(F.size("spans") == 0).select("row.*")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else without_spans(t.encode(), [(s["start"], s["end"]) for s in spans]).decode("utf-8", "replace") for t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(2)], names=["clean", "row"])

    kind = found.schema["row"].dataType
    done = found.select(F.col(f"row.`{text_col}`").alias("t"), "spans", "row").mapInArrow(cut, f"clean string, row {kind.simpleString()}")
    return done.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])

