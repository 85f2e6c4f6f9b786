"""What the search for near copies shuffles grows no faster than the sets: few tables, rows looked up again within a shard, pairs by all bits."""

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import similar, simhash


def fingerprints(sizes, rng):
    """Wide fingerprints of pairs of sets of (common, left, right) hashes, the left ones first."""
    left, right = [], []
    for common, a, b in sizes:
        both = rng.integers(0, 2**64, common, dtype=np.uint64)
        left.append(np.concatenate([both, rng.integers(0, 2**64, a, dtype=np.uint64)]))
        right.append(np.concatenate([both, rng.integers(0, 2**64, b, dtype=np.uint64)]))
    return left + right


def group(wide, own=None):
    words = np.ascontiguousarray(wide[:, : simhash.CHECKED // 8]).view(np.int64)
    n = len(wide)
    return pa.table({"rep": np.arange(n), "own": np.zeros(n, np.int32) if own is None else own, **{f"w{w}": words[:, w] for w in range(words.shape[1])}})


def found(key, table):
    return {(a, b) for batch in simhash.tile_partners(key, table) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}


def test_tables_do_not_grow_with_the_sets():
    few, many = (simhash.key_bits(n, 1 << 20) for n in (40_000, 4_000_000))
    assert few.shape == many.shape and len(few) <= 30
    assert 30 < len(simhash.key_bits(12_000_000, 1 << 20)) < 50


@pytest.mark.parametrize("rows, groups", [(1000, 1), (6000, 1), (6000, 2)])
def test_pairs_meet_within_a_shard(rows, groups):
    rng = np.random.default_rng(rows)
    half = rows // 2
    wide = simhash.wide_fingerprints(fingerprints([(40, 5, 5) if k % 10 == 0 else (0, 50, 50) for k in range(half)], rng))
    planted = {(k, half + k) for k in range(0, half, 10)}
    own = np.repeat([0, 1], half).astype(np.int32) if groups == 2 else None
    met = [found((t << 40, 0, groups - 1), group(wide, own)) for t in range(4)]
    assert all(m <= planted for m in met)
    assert all(len(m) > 0.8 * len(planted) for m in met) and set.union(*met) == planted


@pytest.mark.parametrize("groups", [1, 2])
def test_a_crowd_is_given_row_by_row(groups):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 100, dtype=np.uint64)
    crowd = [np.append(base, rng.integers(0, 2**64, 1 + k % 5, dtype=np.uint64)) for k in range(300)]
    wide = simhash.wide_fingerprints(crowd + [rng.integers(0, 2**64, 100, dtype=np.uint64) for _ in range(300)])
    own = (np.arange(600) % 2).astype(np.int32) if groups == 2 else None
    assert found((0, 0, groups - 1), group(wide, own)) == {(k, k) for k in range(300)}


def test_pairs_are_near_over_all_bits(spark):
    """Sets of a similarity of 0.54 may pass the bits that tables compare, not all bits; sets of fewer hashes than SMALL pass by the former alone."""
    rng = np.random.default_rng(6)
    sizes = [(80, 10, 10)] * 40 + [(70, 30, 30)] * 40 + [(4, 0, 1)] * 40
    sets = fingerprints(sizes, rng)
    rows = [(i, len(s), w.tobytes()) for i, (s, w) in enumerate(zip(sets, simhash.wide_fingerprints(sets)))]
    table = spark.createDataFrame(rows, "rep long, n int, wide binary")
    kinds = lambda df: [sum(r.rep % 120 // 40 == k for r in simhash.partners(df).collect()) for k in range(3)]
    loose, strict = kinds(table.drop("n")), kinds(table)
    assert loose[0] == strict[0] == 80 and loose[2] == strict[2] == 80
    assert loose[1] > 40 and strict[1] == 0


def test_signatures_count_the_hashes(spark):
    docs = spark.createDataFrame([(1, bytearray(b"a b c d e f g")), (2, bytearray(b"a")), (3, None)], "doc_id long, text binary")
    assert {r.doc_id: (r.n, r.wide is None) for r in similar.signatures(docs, 5).collect()} == {1: (3, False), 2: (1, False), 3: (0, True)}
