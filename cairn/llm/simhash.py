"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees, and their connected components.

A document's fingerprint takes the majority of its shingles' hashes bit by bit. Equal fingerprints are one class, so copies cost
nothing. Classes are partitioned by Hamming distance on groups of bits: the 64 bits form `blocks` blocks, and two fingerprints
within `radius` bits agree in at least blocks - radius of them, so they meet in the shard of one choice of agreeing blocks
(distance zero from the shard's centre on those bits). Whole-fingerprint vantage balls can't serve as shards: distances between
unrelated fingerprints gather around 32 with a deviation of 4, so at radius 4 some 70 % of all rows would cross each boundary
and follow both branches. Inside a shard a vantage-point tree prunes by triangle bounds, and rows within the radius of a
boundary are compared across it.

The number of blocks follows the number of classes: more blocks make more choices, each of more agreeing bits (5 blocks: 5 choices of 12
bits; 6: 15 of 21; 7: 35 of 27; 8: 70 of 32), so a class is compared with about `tile` others a choice, however many there are.
A shard of more than `tile` rows is dealt into g = ceil(rows / tile) groups and compared as tiles of two groups each, so no task
holds more than two groups; nothing is dropped. Per tile only a spanning tree of the linked classes goes on, never all pairs.

Sets that are alike without being near copies need wider fingerprints: at a Jaccard similarity of 0.8 a share of 0.15 of all bits differ, which
64 bits can't tell from chance at any radius that shards. partners() therefore takes `WIDE` bits of each set. Sets meet in tables, each
keyed by some of these bits, and as many tables as miss a pair at 0.8 with a probability of `MISSED`. A table is a row of each set in
the shuffle, so keys are short (`KEY_BITS`, more only where a shard would outgrow a task) and tables few, as many for any input up to some
4 million sets. Within a shard, in memory, rows meet again by some of the bits compared (`alike()`); there `RADIUS` of `CHECKED` bits
decide, and of the pairs found `WIDE_RADIUS` of all bits.

Defined results: a text without words (null, empty, blank) has fingerprint zero, and links like any other; rows with a null id
get a fingerprint and no component (null); rows that repeat an id take part each and share the id's component; further columns of
the input are not needed and pass through drop_near_duplicates unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, grown, map_groups, small_batches, staged, texts, without
from cairn.llm.components import components, local_labels, tree_edges

#: Shingles hashed at once, so that a very long text needs no more memory than a short one.
CHUNK = 1 << 16
LEAF = 96
#: Cells of the sketch that makes a wide fingerprint, the fingerprint's bits, and the first of them, by which two sets are compared; radius over
#: half of these and over all.
CELLS, WIDE, CHECKED = 4096, 2048, 256
#: Votes of a hash in every bit: with a single one, sets of few hashes would tie often, and differ in more bits.
VOTES = 3
HALF_RADIUS, RADIUS = 46, 76
#: The share of bits in which sets of Jaccard similarity 0.8 differ: the angle between two such sets over half a turn.
DIFFERING = float(np.arccos(2 * 0.8 / 1.8) / np.pi)
MISSED = 1e-8
#: The radius over all bits, for sets of `SMALL` hashes or more; the bits of smaller ones depend on each other, and they go without.
WIDE_RADIUS, SMALL = 440, 24
#: Bits of a table's key at least (of an input that has more than `NEAR_ROWS` sets), rows that are compared at once within a shard, and the share of a
#: shard's pairs at 0.8 that meet there.
KEY_BITS, NEAR_ROWS, FOUND = 4, 2048, 0.9
#: Pairs that a row lists in a shard; one with more is a partner without them, and so are those near it.
LISTED = 32
#: Pairs compared at once, which bounds memory where many rows agree in the bits that group them.
AT_ONCE = 1 << 17
#: Tables whose rows are shuffled at once, which bounds the disk.
TABLES_AT_ONCE = 48
#: Rows of an Arrow batch of numbers alone.
NUMBER_ROWS = 4096
_side = 1 << (CELLS.bit_length() - 1) // 2
_SIGNS = np.array([[1 - 2 * ((i & j).bit_count() & 1) for j in range(_side)] for i in range(_side)], np.float32)
_VOTE = np.random.default_rng(37).integers(0, 2**64, VOTES, dtype=np.uint64) | np.uint64(1)
_BITS_AT = np.random.default_rng(29).permutation(CELLS)[:WIDE]


def fingerprint(text: bytes | None, words_in_shingle: int) -> int:
    """The SimHash of the lower-cased text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    first, last = starts[: len(words) - k + 1], (starts + lengths)[k - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(first))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within the radius, by a vantage-point tree."""
    left, right = [], []

    def compare(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for s in range(0, len(a), 1024):
            part = a[s : s + 1024]
            near = np.bitwise_count(fp[part, None] ^ fp[None, b]) <= radius
            if same:
                near &= part[:, None] < b[None, :]
            i, j = np.nonzero(near)
            left.append(part[i])
            right.append(b[j])

    todo = [np.arange(len(fp))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            compare(rows, rows, True)
            continue
        distance = np.bitwise_count(fp[rows] ^ fp[rows[len(rows) // 2]]).astype(np.int64)
        cut = int(np.median(distance))
        inner, outer = distance <= cut, distance > cut
        if not outer.any():
            inner, outer = distance < cut, distance >= cut
            cut -= 1
            if not inner.any():
                compare(rows, rows, True)
                continue
        todo += [rows[inner], rows[outer]]
        # The triangle bound: a pair across the boundary lies within the radius of it on both sides, the two gaps together.
        for d in range(max(0, cut - radius + 1), cut + 1):
            across = rows[outer & (distance <= d + radius)]
            if len(across) and len(at := rows[distance == d]):
                compare(at, across, False)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shard_columns(blocks: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each choice of agreeing blocks, their (first bit, bits)."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in combinations(spans, blocks - radius)]


def blocks_for(classes: int, radius: int, tile: int) -> int:
    """The fewest blocks by which shards of unrelated fingerprints hold no more than a tile."""
    for blocks in range(radius + 1, 2 * radius + 1):
        bits = min(sum(n for _, n in spans) for spans in shard_columns(blocks, radius))
        if classes <= tile << bits:
            return blocks
    return 2 * radius + 1


def tile_links(radius: int):
    """Spanning edges of the links within a tile, between two groups or within one."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        fp = np.asarray(table.column("fp")).view(np.uint64)
        rep = np.asarray(table.column("rep"))
        i, j = close_pairs(fp, radius)
        if len(i):
            a, b = tree_edges(local_labels(len(fp), i, j), rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def class_links(classes: DataFrame, radius: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """Edges (a, b) that connect just those classes (fp, rep) that links within the radius connect."""
    if blocks is None:
        blocks = blocks_for(classes.count(), radius, tile)
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    shards = []
    for n, spans in enumerate(shard_columns(blocks, radius)):
        value = F.lit(0).cast("long")
        for first, bits in spans:
            value = F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        shards.append(F.struct(F.lit(n).alias("choice"), value.alias("value")))
    rows = classes.select("fp", "rep", F.explode(F.array(*shards)).alias("s")).select("fp", "rep", "s.choice", "s.value")
    sizes = rows.groupBy("choice", "value").count().where(F.col("count") > 1)
    large = staged(sizes.where(F.col("count") > tile).select(F.col("choice").alias("c"), F.col("value").alias("v"), F.ceil(F.col("count") / tile).cast("int").alias("groups")), "large-shards")
    dealt = rows.join(large, (F.col("choice") == F.col("c")) & (F.col("value") == F.col("v")), "left").select("choice", "value", "fp", "rep", F.coalesce("groups", F.lit(1)).alias("groups"))
    own = F.pmod(F.xxhash64("fp"), F.col("groups")).cast("int")
    tiles = dealt.withColumn("own", own).select("choice", "value", "fp", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("other"))
    tiles = tiles.select("choice", "value", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "fp", "rep")
    return map_groups(tiles, ["choice", "value", "g", "h"], tile_links(radius), "a long, b long")


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE bits of each set of 64-bit hashes, packed; bit by bit what the hashes' majority says.

    A hash votes in every bit b with `VOTES` votes: the parities of b and its cells, each flipped by one more of its bits. So the sums of
    all bits are one Walsh-Hadamard transform of a sketch, which holds the sum of the votes in every cell.
    """
    sketch = np.zeros((len(sets), CELLS), np.float32)
    for row, s in zip(sketch, sets):
        s = (s[:, None] * _VOTE).ravel()
        row += np.bincount((s >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64), 1.0 - 2.0 * ((s >> np.uint64(40)) & np.uint64(1)), CELLS)
    sums = _SIGNS @ sketch.reshape(-1, _side, _side) @ _SIGNS
    return np.packbits(sums.reshape(-1, CELLS)[:, _BITS_AT] > 0, axis=1)


def key_bits(sets: int, tile: int) -> np.ndarray:
    """Of each table, the bits that are its key."""
    k = max(bits_for_rows(sets, tile), min(KEY_BITS, bits_for_rows(sets, NEAR_ROWS)))
    tables = int(np.ceil(np.log(MISSED) / np.log1p(-FOUND * (1 - DIFFERING) ** k))) if k else 1
    rng = np.random.default_rng(31)
    return np.stack([CHECKED + rng.permutation(WIDE - CHECKED)[:k] for _ in range(tables)])


def bits_for_rows(sets: int, rows: int) -> int:
    """Key bits by which a shard has `rows` sets or fewer, though some bits divide unevenly."""
    return max(0, int(np.ceil(np.log2(max(1, 4 * sets / rows)))))


def table_keys(wide: np.ndarray, at: np.ndarray, first: int = 0) -> np.ndarray:
    """One number for each packed fingerprint and table, the tables numbered from first."""
    bits = np.unpackbits(wide, axis=1)[:, at.ravel()].reshape(len(wide), *at.shape)
    return (np.arange(first, first + len(at)) << 40) + bits.astype(np.int64) @ (1 << np.arange(at.shape[1], dtype=np.int64))


def packed_bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDE // 8)


def shard_sizes(at: np.ndarray, first: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own, n = np.unique(table_keys(packed_bits(batch.column(0).slice(i, 512)), at, first), return_counts=True)
                keys, place = np.unique(np.append(keys, own), return_inverse=True)
                counts = np.bincount(place, np.append(counts, n), len(keys)).astype(np.int64)
            if len(keys) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return run


def in_tables(at: np.ndarray, first: int = 0):
    """Of (wide, rep): a row for each table, with the bits to be compared as longs."""
    words = CHECKED // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                wide = packed_bits(batch.column(0).slice(i, 512))
                rep = np.asarray(batch.column(1).slice(i, 512))
                checked = np.ascontiguousarray(wide[:, : CHECKED // 8]).view(np.int64)
                columns = [table_keys(wide, at, first).ravel(), np.repeat(rep, len(at)), *(np.repeat(checked[:, w], len(at)) for w in range(words))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "rep", *(f"w{w}" for w in range(words))])

    return run


def alike(words: np.ndarray, table: int) -> Iterator[np.ndarray]:
    """Groups of rows, in one of which at least two near ones meet with a probability of `FOUND`: those that agree in some bits."""
    rows = words.shape[1]
    if rows <= NEAR_ROWS:
        yield np.arange(rows)
        return
    k = bits_for_rows(rows, NEAR_ROWS)
    rng = np.random.default_rng([41, table])
    for _ in range(int(np.ceil(np.log1p(-FOUND) / np.log1p(-((1 - DIFFERING) ** k))))):
        own = np.zeros(rows, np.uint64)
        for bit in rng.permutation(CHECKED)[:k].tolist():
            own = own << np.uint64(1) | words[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)
        order = np.argsort(own, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(own[order])) + 1)


def near_pairs(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row of a and another one of b within the radius."""
    first = np.bitwise_count(words[0][a, None] ^ words[0][None, b]) + np.bitwise_count(words[1][a, None] ^ words[1][None, b])
    i, j = np.divmod(np.flatnonzero(first <= HALF_RADIUS), len(b))
    i, j = a[i], b[j]
    distance = np.bitwise_count(words[:, i] ^ words[:, j]).sum(0, dtype=np.int64)
    near = (distance <= RADIUS) & (i != j)
    return i[near], j[near]


def tile_partners(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of the rows of one group, or of two: pairs (a, b) of reps within the radius (of two groups: one of each). A row that has more than
    `LISTED` such is given as a pair with itself, and so are those; they need not be compared with each other any more, so a crowd of near
    copies costs no square."""
    words = np.stack([np.asarray(table.column(f"w{w}")) for w in range(CHECKED // 64)]).view(np.uint64)
    rep, own = np.asarray(table.column("rep")), np.asarray(table.column("own"))
    sure = np.zeros(len(rep), bool)
    pairs = []

    def compare(left: np.ndarray, right: np.ndarray, within: bool) -> None:
        step = max(1, min(64, AT_ONCE // max(1, len(right))))
        for s in range(0, len(left), step):
            a = left[s : s + step]
            a = a[~sure[a]]
            b = np.concatenate([right[:s][sure[right[:s]]], right[s:]]) if within else right
            if not len(a) or not len(b):
                continue
            i, j = near_pairs(words, a, b)
            if len(i):
                many = np.bincount(i, minlength=len(rep)) > LISTED
                sure[j[many[i]]] = True
                sure[many] = True
                pairs.append(np.stack([np.minimum(i, j), np.maximum(i, j)])[:, ~many[i]])

    for rows in alike(words, key[0] >> 40):
        if key[1] == key[2]:
            compare(rows, rows, True)
        else:
            left, right = rows[own[rows] == key[1]], rows[own[rows] == key[2]]
            compare(left, right, False)
            compare(right, left[sure[left]], False)
    alone = np.flatnonzero(sure)
    i, j = np.unique(np.concatenate([np.stack([alone, alone]), *pairs], 1), axis=1)
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["a", "b"])


def within_wide_radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n, a_wide, b_wide), n the larger set's hashes: the reps of the pairs that are near over all bits, or too small to tell."""
    for batch in batches:
        distance = np.bitwise_count(packed_bits(batch.column(3)) ^ packed_bits(batch.column(4))).sum(1, dtype=np.int64)
        near = (distance <= WIDE_RADIUS) | (np.asarray(batch.column(2)) < SMALL)
        reps = np.unique(np.concatenate([np.asarray(batch.column(c))[near] for c in (0, 1)]))
        yield pa.RecordBatch.from_arrays([pa.array(reps)], names=["rep"])


def partners(sets: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """The reps of those sets (rep, wide) that have another within the radius, each once; a staged table. Where the number n of a set's hashes
    is given as well, pairs must also be near over all bits."""
    spark = sets.sparkSession
    rows_in = sets.count()
    every, found = key_bits(rows_in, tile), None
    words = [f"w{w}" for w in range(CHECKED // 64)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NUMBER_ROWS))
    for first in range(0, len(every), TABLES_AT_ONCE):
        at = every[first : first + TABLES_AT_ONCE]
        rows, large = sets.select("wide", "rep").mapInArrow(in_tables(at, first), f"key long, rep long, {', '.join(f'{w} long' for w in words)}"), None
        dealt = rows.withColumn("groups", F.lit(1))
        if rows_in > tile:
            sizes = sets.select("wide").mapInArrow(shard_sizes(at, first), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
            large = staged(sizes.where(F.col("n") > tile).select(F.col("key").alias("k"), F.ceil(F.col("n") / tile).cast("int").alias("groups")), "large-shards")
            dealt = rows.join(large, F.col("key") == F.col("k"), "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        tiles = dealt.withColumn("own", F.pmod(F.xxhash64("rep", *words), F.col("groups")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        tiles = tiles.select("key", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "rep", *words)
        found = grown(found, map_groups(tiles, ["key", "g", "h"], tile_partners, "a long, b long"), "near")
        if large is not None:
            dropped(large)
    pairs = staged(found.distinct(), "near-pairs")
    dropped(found)
    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    if "n" in sets.columns:
        own = staged(sets.join(reps, "rep", "left_semi").select("rep", "n", "wide"), "wide")
        a, b = (own.select(F.col("rep").alias(x), F.col("n").alias(f"{x}_n"), F.col("wide").alias(f"{x}_wide")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").select("a", "b", F.greatest("a_n", "b_n").alias("n"), "a_wide", "b_wide")
        reps = both.mapInArrow(within_wide_radius, "rep long").distinct()
        once = staged(reps, "partners")
        dropped(own)
    else:
        once = staged(reps, "partners")
    dropped(pairs)
    small_batches(spark)
    return once


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id (the smallest doc_id reachable by links)."""
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = staged(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = staged(class_links(classes, radius, blocks, tile), "links")
    label = components(links)
    dropped(links)
    of_class = staged(classes.join(label, F.col("rep") == F.col("v"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component")), "components")
    dropped(classes, label)
    out = prints.join(of_class, F.col("fp") == F.col("class_fp"), "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stand first in their group: those whose id is the smallest of its component. Null ids stay."""
    gone = near_duplicates(docs, id_col, text_col, **how).where("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, id_col, gone)
