"""Connected components of a graph of long ids, as joins and aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import dropped, staged

#: Children of a node in the trees that stand for a task's components: bounds degree and depth at once.
FAN_OUT = 32


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component, for links between indices a and b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tree_edges(label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each component of more than one, the edges of a tree over its ids in which none has many neighbours."""
    order = np.lexsort((ids, label))
    _, first, size = np.unique(label[order], return_index=True, return_counts=True)
    place = np.arange(len(order)) - np.repeat(first, size)
    start = np.repeat(first, size)
    child = place > 0
    parent = start[child] + (place[child] - 1) // FAN_OUT
    return ids[order[parent]], ids[order[child]]


def components(edges: DataFrame) -> DataFrame:
    """(v, component): for each id in edges (a, b), the smallest id it can reach.

    Every round takes the least label among neighbours and then follows labels once (pointer jumping), so rounds grow with
    the logarithm of the longest path. Labels are staged in the shared folder after each step; joins read staged tables, so
    AQE can split a partition that one popular id fills.
    """
    both = staged(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct(), "edges")
    label = staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("component")), "labels")
    total = F.sum(F.col("component").cast("decimal(38,0)"))
    was = None
    while True:
        near = both.join(label, F.col("a") == F.col("v")).select(F.col("b").alias("v"), "component")
        least = staged(near.union(label).groupBy("v").agg(F.min("component").alias("component")), "labels")
        now = least.agg(total).first()[0]
        if now is None or now == (label.agg(total).first()[0] if was is None else was):
            dropped(label, both)
            return least
        up = least.select(F.col("v").alias("w"), F.col("component").alias("up"))
        jumped = staged(least.join(up, F.col("component") == F.col("w")).select("v", F.col("up").alias("component")), "labels")
        dropped(label, least)
        label, was = jumped, jumped.agg(total).first()[0]
