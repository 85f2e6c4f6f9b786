"""Parts of a graph by contraction, and whole parts solved within a task."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cairn.operators import graph, local


def parts_of(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {frozenset(x for x in label if label[x] == k) for k in set(label.values())}


@pytest.mark.parametrize("at_once", [2_000_000, 3, 0])
def test_parts_in_rounds(spark, at_once):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)} | {(f"p{k}", f"p{k + 1}") for k in range(40)})
    pairs = [(a, b) for a, b in pairs if a != b]
    edges = spark.createDataFrame([*pairs, ("alone", "alone")], "src string, dst string")
    part = {r["key"]: r["part"] for r in graph.weak_parts(edges, at_once).collect()}
    names = {r[1]: r[0] for r in spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "node string").selectExpr("node", "xxhash64(node)").collect()}
    found = {frozenset(names[k] for k in part if part[k] == p) for p in set(part.values())}
    assert found == parts_of(pairs)


def test_parts_go_on_with_fewer_edges(spark, monkeypatch):
    """A round works on what the one before left, not on all edges again."""
    seen = []
    keep = graph.cut

    def counting(df):
        out = keep(df)
        if out.columns == ["a", "b"]:
            seen.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counting)
    graph.weak_parts(spark.range(4000).selectExpr("id AS src", "id + 1 AS dst"), 20).collect()
    assert all(b <= 0.75 * a for a, b in zip(seen, seen[1:]))


def test_joined_labels():
    path = np.random.default_rng(5).permutation(3000)
    keys, label = local.joined(path[:-1], path[1:])
    assert keys.tolist() == list(range(3000)) and set(label.tolist()) == {0}


def test_solved_orders_nodes_by_bytes():
    nodes, component, size, layer = local.solved(pa.table({"src": ["z", "ä", "𝄞", "b"], "dst": ["ä", "z", "ä", "b"]}))
    assert list(zip(nodes.to_pylist(), component.to_pylist(), size.tolist(), layer.tolist())) == [("b", "b", 1, 0), ("z", "z", 2, 1), ("ä", "z", 2, 1), ("𝄞", "𝄞", 1, 0)]


def test_violations_read_the_typed_edges_once(spark):
    passes = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    rows = [("a", "b", "ADSO", "ADSO"), ("b", "c", "ADSO", "ODSO"), ("c", "d", "ODSO", "ADSO"), ("x", "y", "HCPR", "IOBJ"), ("y", "x", "IOBJ", "HCPR"), ("z", "z", "IOBJ", "IOBJ")]
    typed = spark.createDataFrame(rows, "src string, dst string, src_type string, dst_type string").mapInArrow(seen, "src string, dst string, src_type string, dst_type string")
    got = sorted(tuple(r) for r in graph.layer_violations(typed).collect())
    assert got == [("composite_to_characteristic", "x>y", "medium"), ("cycle", "x", "high"), ("deep_stack", "a:3", "high"), ("self_loop", "z", "high")]
    assert passes.value == len(rows)
