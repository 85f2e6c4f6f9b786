"""Near copies of the pipeline are found by SimHash: wide fingerprints, met in tables keyed by some of their bits."""

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from cairn.llm import similar, simhash
from tests.llm.test_similar import expected, planted


def pair(rng, common, left, right):
    a, b, c = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (common, left, right))
    return np.concatenate([a, b]), np.concatenate([a, c])


@pytest.mark.parametrize("common, left, right", [(4, 0, 1), (8, 1, 1), (8, 0, 2), (40, 5, 5), (400, 50, 50), (4000, 0, 1000)])
def test_similar_sets_differ_in_few_bits_and_meet(common, left, right):
    rng = np.random.default_rng(common)
    a, b = (simhash.wide_fingerprints(list(x)) for x in zip(*(pair(rng, common, left, right) for _ in range(100))))
    differ = np.unpackbits(a ^ b, axis=1)
    assert abs(differ.mean() - simhash.DIFFERING) < 0.02
    assert differ[:, : simhash.CHECKED // 2].sum(1).max() <= simhash.HALF_RADIUS and differ[:, : simhash.CHECKED].sum(1).max() <= simhash.RADIUS
    other = np.unpackbits(a ^ np.roll(b, 1, axis=0), axis=1)[:, : simhash.CHECKED].sum(1)
    assert common < 40 or other.min() > simhash.RADIUS
    at = simhash.key_bits(200_000, 2048)
    assert (simhash.table_keys(a, at) == simhash.table_keys(b, at)).any(1).all()


def test_a_bit_is_the_majority_of_the_votes():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**64, 30, dtype=np.uint64)
    got = np.unpackbits(simhash.wide_fingerprints([s, s[::-1]]), axis=1)
    votes = [(int(v) >> 52, 1 - 2 * (int(v) >> 40 & 1)) for h in s for v in h * simhash._VOTE]
    assert (got[0] == got[1]).all()
    assert got[0].tolist() == [int(sum(sign * (1 - 2 * ((cell & int(b)).bit_count() & 1)) for cell, sign in votes) > 0) for b in simhash._BITS_AT]


@pytest.mark.parametrize("tile, at_once", [(2048, 48), (64, 48), (20, 7)])
def test_partners_in_shards_and_tiles(spark, monkeypatch, tile, at_once):
    monkeypatch.setattr(simhash, "TABLES_AT_ONCE", at_once)
    rows = planted()
    sets = {i: similar.shingles((t or "").encode(), 5) for i, t in rows}
    sets = {i: s for i, s in sets.items() if len(s)}
    rng = random.Random(3)
    crowd = {10_000 + k: np.append(sets[1000][: 290 - k % 7], np.uint64(rng.getrandbits(64))) for k in range(90)}  # a large group in one shard
    lone = {20_000 + k: similar.shingles(" ".join(str(rng.random()) for _ in range(50)).encode(), 5) for k in range(60)}
    every = sets | crowd | lone
    wide = simhash.wide_fingerprints(list(every.values()))
    table = spark.createDataFrame([(i, w.tobytes()) for i, w in zip(every, wide)], "rep long, wide binary").repartition(3)
    found = [r.rep for r in simhash.partners(table, tile).collect()]
    assert len(found) == len(set(found)) and not set(found) & set(lone)
    near = {i for i, group in expected(rows).items() if i >= 1000 and group != i}
    assert near | set(crowd) <= set(found)


def test_the_stage_takes_its_rows_from_simhash(spark, monkeypatch):
    """Without SimHash partners only copies of a set are near duplicates."""
    rows = planted()
    docs = spark.createDataFrame([*rows, (9000, rows[-1][1].upper())], "doc_id long, text string")
    asked = []

    def none(sets):
        asked.append(sets.count())
        return sets.select("rep").limit(0)

    monkeypatch.setattr(similar, "partners", none)
    assert {r.doc_id for r in cp.dedup_documents(spark, docs, "").collect()} == {i for i, _ in rows} - {2, 4}
    assert asked == [len(rows) - 3]  # two have no words, two are one set
