"""Graphs that fit into a task: whole weakly connected parts, several at a time, out of sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Edges of whole parts that a task takes up together.
TOGETHER = 100_000


def whole_parts(batches: Iterator[pa.RecordBatch], key: str, together: int = TOGETHER) -> Iterator[pa.Table]:
    """Tables of some `together` rows and more, cut only where the key changes, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            last = held[-1].column(key)[-1] if held else None
            if rows < together or last is None:
                held.append(batch)
                rows += batch.num_rows
                break
            same = pc.fill_null(pc.equal(batch.column(key), last), False)
            other = pc.index(same, False).as_py()
            if other < 0:
                held.append(batch)
                rows += batch.num_rows
                break
            if other:
                held.append(batch.slice(0, other))
            yield pa.Table.from_batches(held)
            held, rows, batch = [], 0, batch.slice(other)
    if held:
        yield pa.Table.from_batches(held)


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of edges between keys a and b, and for each the least key that it is connected with. Every key points to the root of its tree, and a
    round hangs roots that an edge connects below the least of them."""
    keys, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = np.split(ends, 2)
    label = np.arange(len(keys))
    while len(left):
        low = np.minimum(label[left], label[right])
        for root in (label[left], label[right]):
            np.minimum.at(label, root, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return keys, keys[label]


def strong_components(out: list[list[int]]) -> list[int]:
    """The number of each node's strongly connected component; one that leads to another has the higher number. Depth first, with a stack of
    its own: `low` is the least entry time that a node's subtree leads back to."""
    n = len(out)
    entered, low, component = [0] * n, [0] * n, [-1] * n
    open_nodes: list[int] = []
    clock = found = 0
    for root in range(n):
        if entered[root]:
            continue
        path = [(root, iter(out[root]))]
        clock += 1
        entered[root] = low[root] = clock
        open_nodes.append(root)
        while path:
            node, rest = path[-1]
            for to in rest:
                if not entered[to]:
                    clock += 1
                    entered[to] = low[to] = clock
                    open_nodes.append(to)
                    path.append((to, iter(out[to])))
                    break
                if component[to] < 0 and entered[to] < low[node]:
                    low[node] = entered[to]
            else:
                path.pop()
                if path and low[node] < low[path[-1][0]]:
                    low[path[-1][0]] = low[node]
                if low[node] == entered[node]:
                    while True:
                        member = open_nodes.pop()
                        component[member] = found
                        if member == node:
                            break
                    found += 1
    return component


def solved(edges: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Of edges (src, dst): nodes, the least node of each one's component, the component's size, and its layer: the most components that a path
    to it passes before."""
    ends = pa.chunked_array([*edges.column("src").chunks, *edges.column("dst").chunks]).combine_chunks().dictionary_encode()
    order = np.asarray(pc.sort_indices(ends.dictionary))
    nodes, count = ends.dictionary.take(order), len(order)
    number = np.empty(count, np.int64)
    number[order] = np.arange(count)
    a, b = np.split(number[np.asarray(ends.indices)], 2)
    a, b = a[a != b], b[a != b]
    to = b[by := np.argsort(a, kind="stable")].tolist()
    at = np.searchsorted(a[by], np.arange(count + 1)).tolist()
    component = np.array(strong_components([to[s:e] for s, e in zip(at, at[1:])]), np.int64)
    size = np.bincount(component)
    least = np.full(len(size), count)
    np.minimum.at(least, component, np.arange(count))
    a, b = component[a], component[b]
    a, b = a[a != b], b[a != b]
    layer = [0] * len(size)
    by = np.argsort(-a, kind="stable")  # a component leads to those of lower numbers only
    for x, y in zip(a[by].tolist(), b[by].tolist()):
        if layer[y] <= layer[x]:
            layer[y] = layer[x] + 1
    return nodes, nodes.take(least[component]), size[component], np.array(layer, np.int32)[component]
