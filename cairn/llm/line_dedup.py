"""Line deduplication: two Bloom filters find suspected repeats; only those shuffle, to be confirmed by a digest of the whole key.

A task hashes the line keys of its documents and notes, for each key, whether one or more of its documents hold it. The bits
these keys set in the once-seen and twice-seen filters are merged by filter segment. The filters grow with the number of lines, `LINE_BITS`
bits for each, between 2 MB and `MOST_BITS` (128 MB), the bound of what is broadcast: some 170 million lines, 30 GB or more of texts, fit below
it with fewer than one single line in a hundred suspected. An input that outgrows the bound has more lines suspected and shuffled (all of
them in the end); the result stays the same.

Defined results: a null or empty text is one empty line (a null text comes back null); rows with a null id keep all lines and count for no other document;
rows that repeat an id are one document and lose the same lines; further columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import map_groups, small_batches, staged, texts

SPACE = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 17
LINE_BITS = 6
LEAST_BITS, MOST_BITS = 1 << 24, 1 << 30
PROBES = 3


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def spots(hashes: np.ndarray, filter_bits: int) -> np.ndarray:
    """[n, PROBES] bit numbers, all of a key within one segment."""
    segments = filter_bits // SEGMENT_BITS
    base = (hashes >> np.uint64(52)) % np.uint64(segments) * np.uint64(SEGMENT_BITS) if segments <= 4096 else (hashes >> np.uint64(32)) % np.uint64(segments) * np.uint64(SEGMENT_BITS)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([base + ((mixed >> np.uint64(s)) & np.uint64(SEGMENT_BITS - 1)) for s in (0, 20, 46)], 1)


def bits_for(docs: DataFrame, text_col: str) -> int:
    """Filter bits for as many keys as docs has lines: the next power of two, within the bounds."""
    text = F.col(text_col).cast("string")
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    return min(MOST_BITS, max(LEAST_BITS, 1 << (LINE_BITS * lines - 1).bit_length()))


def seen_bits(filter_bits: int, least: int):
    """Per task and filter segment: the bits set once and those set by two documents."""

    def emit(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        at = spots(keys, filter_bits)
        flat = at.ravel()
        twice = np.repeat(counts > 1, PROBES)
        # A bit that two different keys of this task set is a twice-seen bit as well: a filter can't tell them apart.
        bits, first, n = np.unique(flat, return_index=True, return_counts=True)
        twice_bits = np.union1d(bits[n > 1], flat[twice])
        segment, offsets = np.unique(bits // np.uint64(SEGMENT_BITS), return_index=True)
        ends = np.append(offsets[1:], len(bits))
        low = np.searchsorted(twice_bits, segment * np.uint64(SEGMENT_BITS))
        high = np.searchsorted(twice_bits, (segment + np.uint64(1)) * np.uint64(SEGMENT_BITS))
        part = lambda x: (x % np.uint64(SEGMENT_BITS)).astype("<u4").tobytes()
        rows = [(int(s), part(bits[a:b]), part(twice_bits[c:d])) for s, a, b, c, d in zip(segment, offsets, ends, low, high)]
        for i in range(0, len(rows), 256):
            s, once, two = zip(*rows[i : i + 256])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(once, pa.binary()), pa.array(two, pa.binary())], names=["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None or not text:
                    continue
                keys = {k for k in map(key_of, text.split(b"\n")) if long_enough(k, least)}
                if keys:
                    held.append(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)))
                    size += len(keys)
            if size > 2_000_000:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return run


def merged_segment(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The twice-seen bits of one segment over all tasks."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for a, b in zip(table.column("once"), table.column("twice")):
        bits = np.frombuffer(a.as_py(), "<u4")
        twice[bits[once[bits]]] = True
        once[bits] = True
        twice[np.frombuffer(b.as_py(), "<u4")] = True
    if twice.any():
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["segment", "bits"])


def twice_filter(docs: DataFrame, filter_bits: int, least: int) -> np.ndarray:
    """The twice-seen filter of (doc_id, text), filter_bits / 8 bytes."""
    parts = docs.mapInArrow(seen_bits(filter_bits, least), "segment int, once binary, twice binary")
    out = np.zeros(filter_bits // 8, np.uint8)
    for r in map_groups(parts, ["segment"], merged_segment, "segment int, bits binary").collect():
        at = r.segment * SEGMENT_BITS // 8
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def suspects(held, filter_bits: int, least: int, with_text: bool):
    """Adds the digests of suspected lines; a document without any is finished at once, and its text goes on only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            n_lines, sha, found, kept_text = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (text or b"").split(b"\n")
                keys = list({k for k in map(key_of, lines) if long_enough(k, least)}) if doc_id is not None else []
                digests = []
                if keys:
                    at = spots(np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)), filter_bits).astype(np.int64)
                    for i in np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)) & 1).all(1)):
                        digests.append(hashlib.sha256(keys[i]).digest())
                n_lines.append(len(lines))
                found.append(digests)
                sha.append(None if digests else hashlib.sha256(text or b"").hexdigest())
                kept_text.append(text if digests or with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept_text, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.binary())), *batch.columns[2:]],
                names=["doc_id", "text", "n_lines", "sha", "suspects", *batch.schema.names[2:]],
            )

    return run


def without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the lines whose key's digest is in drop; finishes the digest of what is kept."""
    for batch in batches:
        names = batch.schema.names
        column = {n: batch.column(i) for i, n in enumerate(names)}
        texts_out, n_dropped, sha_out = [], [], []
        for text, sha, drop in zip(column["text"].to_pylist(), column["sha"].to_pylist(), column["drop"].to_pylist()):
            gone = 0
            if drop:
                drop, lines = set(drop), text.split(b"\n")
                kept = [x for x in lines if hashlib.sha256(key_of(x)).digest() not in drop]
                gone, text = len(lines) - len(kept), b"\n".join(kept)
            texts_out.append(text)
            n_dropped.append(gone)
            sha_out.append(sha or hashlib.sha256(text).hexdigest())
        rest = [n for n in names if n not in ("doc_id", "text", "n_lines", "sha", "drop")]
        yield pa.RecordBatch.from_arrays(
            [column["doc_id"], pa.array(texts_out, pa.binary()), column["n_lines"], pa.array(n_dropped, pa.int64()), pa.array(sha_out, pa.string()), *(column[n] for n in rest)],
            names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256", *rest],
        )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, filter_bits: int | None = None, with_text: bool = True) -> DataFrame:
    """docs without the lines that an earlier document (a smaller id) holds, and n_lines, n_dropped and kept_sha256.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys under min_chars code points never count.
    with_text=False returns only doc_id and the three figures; texts are then shuffled only for documents with suspected lines.
    Further columns of docs come back under their names, but for those named like a figure, which the figures replace.
    """
    spark = docs.sparkSession
    small_batches(spark)
    filter_bits = filter_bits or bits_for(docs, text_col)
    base = texts(docs, id_col, text_col)
    figures = {"n_lines", "n_dropped", "kept_sha256"}
    extra = [c for c in docs.columns if c not in {id_col, text_col} | figures] if with_text else []
    if with_text:
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), F.struct(*extra).alias("rest") if extra else F.lit(None).cast("int").alias("rest"))
    held = spark.sparkContext.broadcast(twice_filter(texts(docs, id_col, text_col), filter_bits, min_chars))
    kinds = "doc_id long, text binary, n_lines long, sha string, suspects array<binary>" + (f", rest {base.schema['rest'].dataType.simpleString()}" if with_text else "")
    marked = staged(base.mapInArrow(suspects(held, filter_bits, min_chars, with_text), kinds), "lines")
    pairs = marked.where(F.size("suspects") > 0).select("doc_id", F.explode("suspects").alias("digest"))
    firsts = pairs.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = staged(firsts, "firsts")
    drops = pairs.join(firsts, "digest").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))
    touched = marked.where(F.size("suspects") > 0).drop("suspects").join(drops, "doc_id", "left")
    clean = marked.where(F.size("suspects") == 0).drop("suspects").withColumn("drop", F.lit(None).cast("array<binary>"))
    rest = f", rest {base.schema['rest'].dataType.simpleString()}" if with_text else ""
    order = ["doc_id", "text", "n_lines", "sha", "drop", *(["rest"] if with_text else [])]
    out = touched.select(order).mapInArrow(without_lines, f"doc_id long, text binary, n_lines long, n_dropped long, kept_sha256 string{rest}")
    done = clean.select("doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("sha").alias("kept_sha256"), *(["rest"] if with_text else []))
    if not with_text:
        return out.drop("text").union(done.drop("text"))
    full = out.union(done)
    first = {id_col: F.col("doc_id").alias(id_col), text_col: F.col("text").cast("string").alias(text_col)}
    return full.select(*[first[c] if c in first else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c in first or c in extra], "n_lines", "n_dropped", "kept_sha256")
