"""Chains that meet are counted, not listed."""

import random

from cairn.operators import analysis, runs


def windows_of(chains, per_chain, seed):
    rng = random.Random(seed)
    out = []
    for c in range(chains):
        for k in range(per_chain):
            start = rng.randrange(5000) * runs.MICROS
            out.append((f"c{c}", f"{c}-{k}", start, start + rng.choice([0, 1, 40, 900]) * runs.MICROS))
    return out


def met(rows):
    found = {}
    for a, _, start, end in rows:
        for b, _, at, _ in rows:
            if a is not None and b is not None and start < end and start <= at < end:
                found.setdefault(a, set()).add(b)
    return {a: len(others - {a}) for a, others in found.items()}


def test_chains_met_over_many_tiles(spark):
    rows = windows_of(90, 7, 1) + [(None, "x", 0, 10**10)]
    w = spark.createDataFrame(rows, "chain_id string, log_id string, start_us long, end_us long")
    for others in (1 << 16, 64, 20):
        assert {r[0]: r[1] for r in runs.chains_met(w, others).collect()} == met(rows)


def test_slices_of_a_tile(monkeypatch):
    rows = windows_of(150, 9, 2)
    import pyarrow as pa

    left = pa.table({"chain_id": [r[0] for r in rows if r[2] < r[3]], "start_us": [r[2] for r in rows if r[2] < r[3]], "end_us": [r[3] for r in rows if r[2] < r[3]]})
    right = pa.table({"other": [r[0] for r in rows], "at": [r[2] for r in rows]})
    for slices in (1, 7, 64, 100_000):
        monkeypatch.setattr(runs, "SLICES", slices)
        out = runs.met_in_tile((0, 0), left, right).to_pydict()
        assert {c: n - 1 for c, n in zip(out["chain_id"], out["met"])} == met(rows)
    none = runs.met_in_tile((0, 0), left.slice(0, 0), right)
    assert none.num_rows == 0
    assert set(runs.met_in_tile((0, 0), left, right.slice(0, 0)).to_pydict()["met"]) == {0}

def test_findings_of_contention_ask_for_no_number_of_chains(spark, monkeypatch):
    """Whether a chain is disturbed needs no pairs of chains."""
    monkeypatch.setattr(runs, "chains_met", None)
    log = spark.createDataFrame([("a", "G")], "chain_id string, status string")
    minute = 60 * runs.MICROS
    steps = spark.createDataFrame([("a", "1", 0, 9 * minute), ("b", "1", 5 * minute, 6 * minute)], "chain_id string, log_id string, start_us long, end_us long")
    assert [tuple(r) for r in analysis.chain_findings(log, steps).collect()] == [("contention", "a", "medium")]


def test_assessment_works_findings_out_once(spark):
    """The findings of a scenario and the score of the whole come from one pass over the findings."""
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    found = spark.createDataFrame([("s", "a", "high"), ("s", "b", "low"), ("t", "c", "critical"), ("u", "d", "medium")], "scenario string, object string, severity string")
    scenarios = spark.createDataFrame([("s", "assessed"), ("t", "not_assessed"), ("v", "assessed")], "scenario string, status string")
    got = analysis.assessment(scenarios, found.mapInArrow(seen, found.schema)).orderBy("scenario").collect()
    assert [tuple(r) for r in got] == [("s", "assessed", 2, "high", 93.5, "A"), ("t", "not_assessed", None, "critical", 93.5, "A"), ("v", "assessed", 0, None, 93.5, "A")]
    assert passes.value == 4
