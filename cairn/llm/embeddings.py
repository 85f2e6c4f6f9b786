"""Embedding near-duplicates: all pairs of vectors by cosine, compared in tiles along the principal axes.

Equal vectors are one class. Classes are projected on the principal axes of all vectors (second moments summed over
partitions, then in groups) and dealt into tiles of about `tile` vectors, ordered along the first axis; vectors that stand at one place
of it are dealt over several tiles by a hash. Two unit vectors whose cosine reaches the threshold t are at most sqrt(2 - 2t) apart, so a
vector meets only tiles whose range on that axis comes that near. Within a pair of tiles, products over the leading axes are accumulated first; the rest of a product is at most the product of the two suffix
norms, and a pair is given up as soon as even that can't reach t. What remains is decided by the cosine in double precision.

The number of comparisons grows with the square of the number of classes where the data have no dominant axis: no exact method
is known that avoids this for vectors spread in all directions. A task holds two tiles at any time, and no pair list leaves it: only
counts per class and a spanning tree of what is linked.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing and form their own
component; vectors of different length never link; rows that repeat a vec_id are vectors of their own under one component id;
a null vec_id gets its links and, if nothing smaller is reachable, a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, map_groups, small_batches, staged
from cairn.llm.components import components, local_labels, tree_edges

#: Leading axes of the two passes that can give a pair up; float32 products stay well within MARGIN of the true ones.
LEADS = (16, 32)
MARGIN = 1e-4
NO_ID = 1 << 62


def unit_vectors(column: pa.Array) -> np.ndarray:
    """[rows, components] of lists of equal length, each brought to length 1."""
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def second_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (size, embedding): per size, the sum of the outer products of the unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = np.asarray(batch.column(0))
        for size in np.unique(sizes):
            x = unit_vectors(batch.filter(pa.array(sizes == size)).column(1))
            sums[int(size)] = sums.get(int(size), 0) + x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["size", "moments"])


def principal_axes(valid: DataFrame) -> dict[int, np.ndarray]:
    """For each vector size, the orthonormal axes by falling second moment."""

    def added(rows) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for size, moments in rows:
            sums[size] = sums.get(size, 0) + np.frombuffer(moments).reshape(size, -1)
        return sums

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = added(row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["size", "moments"])

    kinds = "size int, moments binary"
    parts = valid.select("size", "embedding").mapInArrow(second_moments, kinds).repartition(8).mapInArrow(joined, kinds)
    return {size: np.linalg.eigh(m)[1][:, ::-1] for size, m in added((r["size"], r.moments) for r in parts.collect()).items()}


def tile_cuts(placed: DataFrame, tile: int) -> list[tuple[int, list[float]]]:
    """For each vector size, the places on the first axis between its tiles of about `tile` vectors."""
    groups = {r["size"]: -(-r["count"] // tile) for r in placed.groupBy("size").count().collect()}
    most = max(groups.values(), default=1)
    if most == 1:
        return [(size, []) for size in groups]
    places = F.percentile_approx("axis", [k / most for k in range(1, most)], 20 * most).alias("places")
    found = {r["size"]: r.places for r in placed.groupBy("size").agg(places).collect()}
    return [(size, [found[size][most * k // n - 1] for k in range(1, n)]) for size, n in groups.items()]


@dataclass
class Rows:
    rep: np.ndarray
    copies: np.ndarray
    exact: np.ndarray
    unit: np.ndarray
    suffix: list[np.ndarray]

    @staticmethod
    def of(table: pa.Table, axes: np.ndarray) -> Rows:
        exact = unit_vectors(table.column("embedding").combine_chunks())
        unit = exact @ axes
        left = [np.sqrt(np.maximum((unit[:, k:] ** 2).sum(1), 0)).astype(np.float32) for k in LEADS]
        return Rows(np.asarray(table.column("rep")), np.asarray(table.column("copies")), exact, unit.astype(np.float32), left)


def linked(a: Rows, b: Rows, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a and b) whose cosine is at least `least`; of one tile with itself, each pair once."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(a.rep), 1024):
        rows = slice(s, s + 1024)
        product = a.unit[rows, : LEADS[0]] @ b.unit[:, : LEADS[0]].T
        product += a.suffix[0][rows, None] * b.suffix[0][None, :]
        i, j = np.nonzero(product >= least - MARGIN)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            reach = np.einsum("ij,ij->i", a.unit[p, : LEADS[1]], b.unit[q, : LEADS[1]]) + a.suffix[1][p] * b.suffix[1][q]
            p, q = p[reach >= least - MARGIN], q[reach >= least - MARGIN]
            near = np.einsum("ij,ij->i", a.exact[p], b.exact[q]) >= least
            left.append(p[near])
            right.append(q[near])
    return np.concatenate(left), np.concatenate(right)


def tile_links(held, least: float):
    """Of a pair of tiles: per class, the vectors linked to it; and tree edges of what is linked."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        size, g, h = key
        own = np.asarray(table.column("own"))
        if not (own == g).any() or not (own == h).any():
            return
        a = Rows.of(table.filter(pa.array(own == g)), held.value[size])
        b = a if g == h else Rows.of(table.filter(pa.array(own == h)), held.value[size])
        i, j = linked(a, b, least, g == h)
        if not len(i):
            return
        rep = a.rep if g == h else np.concatenate([a.rep, b.rep])
        copies = a.copies if g == h else np.concatenate([a.copies, b.copies])
        j = j if g == h else j + len(a.rep)
        n = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        some = n > 0
        x, y = tree_edges(local_labels(len(rep), i, j), rep)
        empty = lambda k: pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(rep[some]), empty(len(x))]), pa.concat_arrays([pa.array(n[some].astype(np.int64)), empty(len(x))]), pa.concat_arrays([empty(int(some.sum())), pa.array(x)]), pa.concat_arrays([empty(int(some.sum())), pa.array(y)])],
            names=["rep", "n", "a", "b"],
        )

    return run


def first_axis(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(batch.schema.get_field_index("size")))
            at = np.zeros(batch.num_rows)
            for size in np.unique(sizes):
                own = sizes == size
                x = unit_vectors(batch.filter(pa.array(own)).column(batch.schema.get_field_index("embedding")))
                at[own] = x @ held.value[int(size)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "axis"])

    return run


def embedding_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile: int = 4096) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept, for every row."""
    spark = embeddings.sparkSession
    small_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = "array<float>" if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    rows = staged(rows.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), F.col("embedding")).alias("embedding")), "vectors")
    # A class is known by its smallest id; one without any id by a number beyond all ids.
    rep = F.coalesce(F.min("vec_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("embedding"), 2))
    classes = staged(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least_id"), rep.alias("rep"), F.count("*").alias("copies")), "classes")
    valid = classes.select("rep", "copies", F.size("embedding").alias("size"), "embedding")
    axes = principal_axes(valid)
    held = spark.sparkContext.broadcast(axes)
    placed = staged(valid.mapInArrow(first_axis(held), f"rep long, copies long, size int, embedding {kind}, axis double"), "placed")
    cuts = F.broadcast(spark.createDataFrame(tile_cuts(placed, tile), "size int, cuts array<double>"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + MARGIN
    before = lambda x: F.size(F.filter("cuts", lambda c: c < x))
    upto = lambda x: F.size(F.filter("cuts", lambda c: c <= x))
    axis = F.col("axis")
    own = before(axis) + F.pmod(F.xxhash64("embedding"), upto(axis) - before(axis) + 1).cast("int")
    tiled = placed.join(cuts, "size").withColumn("own", own).withColumn("other", F.explode(F.sequence(before(axis - reach), upto(axis + reach))))
    pairs = tiled.select("size", F.least("own", "other").alias("g"), F.greatest("own", "other").alias("h"), "own", "rep", "copies", "embedding")
    found = staged(map_groups(pairs, ["size", "g", "h"], tile_links(held, threshold), "rep long, n long, a long, b long"), "found")
    counts = found.where("rep is not null").groupBy(F.col("rep").alias("counted")).agg(F.sum("n").alias("n"))
    label = components(found.where("a is not null").select("a", "b"))
    of_class = staged(
        classes.join(counts, F.col("rep") == F.col("counted"), "left").join(label, F.col("rep") == F.col("v"), "left").select(F.col("embedding").alias("class_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")),
        "class-links",
    )
    dropped(classes, placed, found, label)
    out = rows.join(of_class, F.col("embedding") == F.col("class_vector"), "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
