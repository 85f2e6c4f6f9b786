"""Graphs of objects as edge tables (src, dst): bounded walks, cycles, layers, paths and hierarchies.

A loop keeps one small table a round and joins it with the edges; what it found stays where the round wrote it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.local import joined, solved, whole_parts
from cairn.plans.cut import cut, gone, keep


def edges_of(triples: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct (src, dst) with neither blank."""
    named = (F.col("src").cast("string") != "") & (F.col("dst").cast("string") != "")
    return triples.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(named).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, direction) of every node: up feeds it, down is fed by it."""
    down = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("down").alias("direction"))
    return down.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("up").alias("direction"))).distinct()


def statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(measure, value): nodes (node, type) and edges in all, nodes by type, sources, sinks, isolated nodes, largest fan-in and fan-out."""
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    both = nodes.join(outs, "node", "full_outer").join(ins, "node", "full_outer")
    n_in, n_out = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    totals = both.agg(
        F.count("*").alias("nodes"), F.coalesce(F.sum(n_out), F.lit(0)).alias("edges"), F.count_if((n_in == 0) & (n_out > 0)).alias("sources"), F.count_if((n_out == 0) & (n_in > 0)).alias("sinks"),
        F.count_if((n_in == 0) & (n_out == 0)).alias("isolated"), F.max(n_in).alias("max_fan_in"), F.max(n_out).alias("max_fan_out"),
    )
    measures = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("long").alias("value")) for c in totals.columns])).alias("m")
    types = both.groupBy(F.concat(F.lit("type:"), F.coalesce("type", F.lit("unknown"))).alias("measure")).agg(F.count("*").alias("value"))
    return totals.select(measures).select("m.*").unionByName(types)


def edge_kinds(hops: DataFrame) -> DataFrame:
    """(measure, value): how many hops (src, dst, kind) there are of each kind, each counted once."""
    kind = F.concat(F.lit("edge:"), F.coalesce("kind", F.lit("unknown"))).alias("measure")
    return hops.select("src", "dst", "kind").distinct().groupBy(kind).agg(F.count("*").alias("value"))


def reachability(edges: DataFrame, depth: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, hops): what each root reaches in at most `depth` hops (None: any number), by the fewest hops; the root itself only
    through a cycle."""
    edges = cut(edges.select("src", "dst"))
    starts = roots if roots is not None else edges.select(F.col("src").alias("root")).distinct()
    frontier = cut(edges.join(starts, F.col("src") == F.col("root")).select("root", F.col("dst").alias("node"), F.lit(1).alias("hops")).distinct())
    found = [frontier]
    while (depth is None or len(found) < depth) and not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        seen = union_of(found).select("root", "node")
        frontier = cut(step.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(len(found) + 1)))
        found.append(frontier)
    return union_of(found)


def lineage(hops: DataFrame, depth: int, direction: str = "down", roots: DataFrame | None = None) -> DataFrame:
    """(root, src, dst, kind, level): the hops (src, dst, kind, free) that a walk from each root takes, level by level.

    A free hop stays on its level, so what it leads to is taken up in the same one; a node is taken up once, on its least level. At the
    last level only free hops are taken, and those only upward.
    """
    at, to = ("src", "dst") if direction == "down" else ("dst", "src")
    hops = cut(hops.select("src", "dst", "kind", "free"))
    starts = roots if roots is not None else hops.select(F.col(at).alias("root")).distinct()
    frontier, seen, found = cut(starts.select("root", F.col("root").alias("node"))), [], []
    for level in range(depth + (direction == "up")):
        later = []
        taken = hops.where("free") if level == depth else hops
        while not frontier.isEmpty():
            seen.append(frontier)
            step = cut(frontier.join(taken, F.col("node") == F.col(at)).select("root", "src", "dst", "kind", "free", F.lit(level).alias("level")))
            found.append(step.drop("free"))
            reached = step.select("root", F.col(to).alias("node"), "free").join(union_of(seen), ["root", "node"], "left_anti")
            later.append(reached.where("NOT free").select("root", "node"))
            frontier = cut(reached.where("free").select("root", "node").distinct())
        if not later:
            break
        frontier = cut(union_of(later).distinct().join(union_of(seen), ["root", "node"], "left_anti"))
    return union_of(found).distinct() if found else hops.select(F.col("src").alias("root"), "src", "dst", "kind", F.lit(0).alias("level")).limit(0)


def sources_of(walk: DataFrame, hops: DataFrame) -> DataFrame:
    """(root, node, resolved) where an upward lineage ends: resolved at a node that nothing feeds, else where its depth ran out."""
    ends = walk.select("root", F.col("src").alias("node")).distinct()
    ends = ends.join(walk.select("root", F.col("dst").alias("node")).distinct(), ["root", "node"], "left_anti")
    fed = hops.select(F.col("dst").alias("node"), F.lit(True).alias("fed")).distinct()
    return ends.join(fed, "node", "left").select("root", "node", F.col("fed").isNull().alias("resolved"))


def impact(edges: DataFrame, kinds: DataFrame, depth: int) -> DataFrame:
    """(root, kind, affected): how many objects each root affects within `depth` hops, in all (kind 'all') and by kind; itself never."""
    hit = reachability(edges, depth).where("node <> root").join(kinds, "node", "left").select("root", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    return hit.groupBy("root", "kind").agg(F.count("*").alias("affected")).unionByName(hit.groupBy("root").agg(F.lit("all").alias("kind"), F.count("*").alias("affected")))


#: Hops that a round of spread_components() takes before it writes its state.
HOPS = 3
#: Edges up to which a weakly connected part is solved within one task; it takes some 400 bytes an edge there.
LOCAL = 500_000
#: Edges of hashes that a task connects at once, some 100 bytes each.
AT_ONCE = 2_000_000


def weak_parts(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(key, part) of each node that an edge leads to another: key is the node's hash, and nodes that edges connect, whatever their direction, have one part.
    Two nodes of one hash count as connected, which can only put parts together.

    A round gives each node the least key among its own and its neighbours', and goes on with the edges between these. So few edges are left after
    some rounds that a task takes them up at once.
    """
    kind = edges.schema["src"].dataType
    rest = cut(edges.select(F.xxhash64("src").alias("a"), F.xxhash64(F.col("dst").cast(kind)).alias("b")).where("a <> b"))
    steps = []
    while rest.count() > at_once:
        least = F.least(F.min("b"), F.col("a")).alias("part")
        step = cut(rest.union(rest.select("b", "a")).groupBy("a").agg(least).select(F.col("a").alias("key"), "part"))
        low, high = F.least("a_part", "b_part").alias("a"), F.greatest("a_part", "b_part").alias("b")
        end = lambda c: step.select(F.col("key").alias(c), F.col("part").alias(f"{c}_part"))  # noqa: B023, E731
        new = cut(rest.join(end("a"), "a").join(end("b"), "b").where("a_part <> b_part").select(low, high).distinct())
        gone(rest)
        steps.append(step)
        rest = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        key, part = joined(*(np.concatenate([np.asarray(x.column(c)) for x in held]) for c in "ab")) if held else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part)], names=["key", "part"])

    label = cut(rest.repartition(1).mapInArrow(run, "key long, part long"))
    gone(rest)
    for step in reversed(steps):
        up = label.select(F.col("key").alias("part"), F.col("part").alias("up"))
        label = cut(step.join(up, "part", "left").select("key", F.coalesce("up", "part").alias("part")))
        gone(step)
    return label


def condensed(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, component, size, layer) of every node of any graph: the least node of its strongly connected component, how many nodes that has,
    and its layer in the graph of components, which has no cycle: 0 without predecessors, else one more than the deepest predecessor.
    Edges within a component, and of a node to itself, don't count for layers.

    Weakly connected parts of up to `local` edges are solved whole, many to a task; larger ones by rounds over the whole table.
    """
    edges = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    weak = weak_parts(edges)
    hashed = edges.withColumn("key", F.xxhash64("src"))
    parted = cut(hashed.join(weak, "key", "left").select(F.coalesce("part", "key").alias("part"), "src", "dst"))
    gone(weak, edges)
    large = cut(parted.groupBy("part").count().where(F.col("count") > local).select("part"))
    node = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_parts(batches, "part"):
            nodes, component, size, layer = solved(table)
            kind = table.schema.field("src").type
            yield pa.RecordBatch.from_arrays([nodes.cast(kind), component.cast(kind), pa.array(size, pa.int64()), pa.array(layer, pa.int32())], names=["node", "component", "size", "layer"])

    small = parted.join(large, "part", "left_anti").select("part", "src", "dst")
    found = small.repartition("part").sortWithinPartitions("part").mapInArrow(run, f"node {node}, component {node}, size long, layer int")
    if large.isEmpty():
        out = cut(found)
        gone(parted, large)
        return out
    rest = cut(parted.join(large, "part", "left_semi").select("src", "dst"))
    label = spread_components(rest)
    named = nodes_of(rest).join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    named = cut(named)
    end = lambda at: named.select(F.col("node").alias(at), F.col("component").alias(f"{at}_component"))
    dag = rest.join(end("src"), "src").join(end("dst"), "dst").where("src_component <> dst_component").select(F.col("src_component").alias("src"), F.col("dst_component").alias("dst")).distinct()
    dag = cut(dag)
    layer = spread_layers(dag).select(F.col("node").alias("at"), "layer")
    spread = named.join(layer, F.col("component") == F.col("at"), "left").select("node", "component", "size", F.coalesce("layer", F.lit(0)).alias("layer"))
    out = cut(found.unionByName(spread))
    gone(parted, large, rest, named, dag)
    return out


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those of nodes that nothing feeds or that feed nothing, so far as a few rounds find them."""
    for _ in range(HOPS):
        fed, feeding = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = edges.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select("src", "dst")
    return cut(edges)


def settled(state: DataFrame, hop, value: str) -> DataFrame:
    """state (node, value) after hop(state) has been taken until no value changes."""
    while True:
        new = state.withColumn("was", F.col(value))
        for _ in range(HOPS):
            new = hop(new)
        new, before = cut(new), state
        gone(before)
        state = keep(new.drop("was"), new)
        if new.where(F.col(value) != F.col("was")).isEmpty():
            return state


def spread_components(edges: DataFrame) -> DataFrame:
    """(component, node, size) of each strongly connected component of two nodes or more, by rounds over the whole table.

    Each node takes the least node that reaches it as its colour; a node of its own colour and all that lead back to it within the colour
    are one component. Components go, and what is left within the colours begins again. The state is a row per node and per edge left,
    whatever the nodes reach.
    """
    rest, found = trimmed(edges.where("src <> dst").select("src", "dst").distinct()), []
    while not rest.isEmpty():

        def down(state: DataFrame, rest: DataFrame = rest) -> DataFrame:
            up = state.select(F.col("node").alias("src"), "colour").join(rest, "src").groupBy(F.col("dst").alias("at")).agg(F.min("colour").alias("up"))
            return state.join(up, F.col("node") == F.col("at"), "left").select("node", F.least("colour", F.coalesce("up", "colour")).alias("colour"), "was")

        colour = settled(nodes_of(rest).withColumn("colour", F.col("node")), down, "colour")
        of = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = cut(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst"))

        def back(state: DataFrame, inner: DataFrame = inner) -> DataFrame:
            leads = inner.join(state.where("leads = 1").select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("at"), F.lit(1).alias("hit")).distinct()
            return state.join(leads, F.col("node") == F.col("at"), "left").select("node", "colour", F.greatest("leads", F.coalesce("hit", F.lit(0))).alias("leads"), "was")

        marked = settled(colour.withColumn("leads", (F.col("node") == F.col("colour")).cast("int")), back, "leads")
        found.append(marked.where("leads = 1").select(F.col("colour").alias("component"), "node"))
        left = marked.where("leads = 0").select("node")
        rest = trimmed(inner.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    if not found:
        return nodes_of(edges).select(F.col("node").alias("component"), "node", F.lit(1).cast("long").alias("size")).limit(0)
    label = cut(union_of(found).distinct())
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    return label.join(size, "component").where("size >= 2").select("component", "node", "size")


def spread_layers(dag: DataFrame) -> DataFrame:
    """(node, layer) of a graph without cycles, by rounds: round k holds the nodes at the end of some path of k hops, fewer each time; a
    node's layer is the last round that holds it."""
    now = cut(nodes_of(dag).withColumn("layer", F.lit(0)))
    found = [now]
    while not now.isEmpty():
        step = now.select(F.col("node").alias("src")).join(dag, "src").select(F.col("dst").alias("node")).distinct()
        now = cut(step.withColumn("layer", F.lit(len(found))))
        found.append(now)
    return union_of(found).groupBy("node").agg(F.max("layer").alias("layer"))


def cycles(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(component, node, size) of each strongly connected component of two nodes or more, or of one with an edge to itself."""
    every = condensed(edges, local).select("component", "node", "size")
    single = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    return every.where("size >= 2").unionByName(every.where("size = 1").join(single, "node", "left_semi").select("component", "node", "size"))


def layers(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, layer): 0 without predecessors, else one more than the deepest predecessor; nodes of a cycle share their layer, and what they feed
    comes after all of them."""
    return condensed(edges, local).select("node", "layer")


def longest_paths(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(root, hops): of each node that no other feeds, the length of its longest path down; all nodes of a cycle count as one place of it, and
    edges of a node to itself don't count."""
    pairs = cut(edges.where("src <> dst").select("src", "dst"))
    roots = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").select(F.col("src").alias("node")).distinct()
    return roots.join(layers(turned(pairs), local), "node").select(F.col("node").alias("root"), F.col("layer").alias("hops"))


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with each row's place (from 1) within its group by the order, a long group spread over many tasks: rows are sorted over ranges, and
    each range's rows of a group are counted on from those of the ranges before."""
    placed = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    spans = placed.groupBy(F.col(group).alias("_group"), F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    joined = placed.join(spans, (F.col(group) == F.col("_group")) & (F.shiftright("_at", 33) == F.col("_range")))
    return joined.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_at", "_group", "_range", "_first", "_before")


def ordered_layers(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """(node, layer, place): the nodes of each layer ordered by the mean place of their neighbours, where places are first by name."""
    by_name = cut(numbered(layer.select("node", "layer"), "layer", ["node"], "first"))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    mean = both.join(by_name.select(F.col("node").alias("other"), "first"), "other").groupBy("node").agg(F.avg("first").alias("mean"))
    sorted_by = by_name.join(mean, "node", "left").select("node", "layer", F.coalesce("mean", F.col("first").cast("double")).alias("mean"))
    return numbered(sorted_by, "layer", ["mean", "node"], "place").select("node", "layer", "place")


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int = 24, most: int = 200) -> DataFrame:
    """(src, dst, path, hops, truncated): the paths without repeated nodes from each start to each end (node), of at most `hops` hops; of a
    pair the first `most` by hops and nodes, which truncated tells."""
    edges = cut(edges.select("src", "dst"))
    going = cut(starts.select(F.col("node").alias("start"), F.array("node").alias("path"), F.col("node").alias("tip")))
    found = []
    for _ in range(hops):
        step = going.join(edges, F.col("tip") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        going = cut(step.select("start", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("tip")))
        if going.isEmpty():
            break
        found.append(going.join(ends.select(F.col("node").alias("tip")).distinct(), "tip", "left_semi"))
    if not found:
        found = [going.limit(0)]
    name = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    paths = union_of(found).select(F.col("start").alias("src"), F.col("tip").alias("dst"), name.alias("path"), (F.size("path") - 1).alias("hops"))
    pair = Window.partitionBy("src", "dst")
    ranked = paths.withColumn("n", F.row_number().over(pair.orderBy("hops", "path"))).withColumn("truncated", F.count("*").over(pair) > most)
    return ranked.where(F.col("n") <= most).drop("n")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select(F.col("src").alias("node"))


def hierarchy_paths(nodes: DataFrame) -> DataFrame:
    """(area, path, level) of nodes (area, parent), however deep: from the root, whose parent is blank; nodes below a cycle have no path."""
    level = cut(nodes.where("coalesce(parent, '') = ''").select("area", F.array("area").alias("way")))
    found = [level]
    while not level.isEmpty():
        up = level.select(F.col("area").alias("up"), F.col("way").alias("above"))
        level = cut(nodes.join(up, F.col("parent") == F.col("up")).where(~F.array_contains("above", F.col("area"))).select("area", F.array_append("above", F.col("area")).alias("way")))
        found.append(level)
    return union_of(found).select("area", F.array_join(F.transform("way", lambda x: x.cast("string")), "/").alias("path"), (F.size("way") - 1).alias("level"))


def call_trees(calls: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """(root, path, level, truncated): the tree of calls (src, dst) below each root (node), down to `depth`. truncated tells what isn't followed
    although it calls others: a call of one that stands above it on its path, and what stands at the last level."""
    level = cut(roots.select(F.col("node").alias("root"), F.array("node").alias("path"), F.col("node").alias("tip"), F.lit(False).alias("again")))
    found = [level]
    for _ in range(depth):
        step = level.where("NOT again").join(calls, F.col("tip") == F.col("src"))
        level = cut(step.select("root", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("tip"), F.array_contains("path", F.col("dst")).alias("again")))
        if level.isEmpty():
            break
        found.append(level)
    calling = calls.select(F.col("src").alias("tip"), F.lit(True).alias("calling")).distinct()
    name = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    ended = F.col("again") | ((F.size("path") > depth) & F.col("calling").isNotNull())
    return union_of(found).join(calling, "tip", "left").select("root", name.alias("path"), (F.size("path") - 1).alias("level"), ended.alias("truncated"))


def merged_streams(edges: DataFrame, least: int = 2) -> DataFrame:
    """Targets fed by several sources."""
    return edges.groupBy(F.col("dst").alias("target")).agg(F.countDistinct("src").alias("sources"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("source_list")).where(F.col("sources") >= least)


def declared_hops(transformations: DataFrame, loads: DataFrame) -> DataFrame:
    """(src, dst, kind, modes): an edge is of kind dtp only if no transformation declares it; modes in the order full, init, delta."""
    order = F.array(F.lit("F"), F.lit("I"), F.lit("D"))
    modes = loads.groupBy("src", F.col("tgt").alias("dst")).agg(F.collect_set("updmode").alias("m"))
    both = edges_of(transformations).withColumn("declared", F.lit(True)).join(modes, ["src", "dst"], "full_outer")
    kept = F.filter(order, lambda x: F.coalesce(F.array_contains("m", x), F.lit(False)))
    return both.select("src", "dst", F.when(F.col("declared"), "transformation").otherwise("dtp").alias("kind"), F.array_join(kept, ",").alias("modes"))


def finding(scenario: str, obj, severity) -> list:
    return [F.lit(scenario).alias("scenario"), obj.alias("object"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity")]


def typed_violations(typed: DataFrame, scenario: str, targets: list[str], severity: str = "medium") -> DataFrame:
    """Findings of typed edges (src, dst, src_type, dst_type) from a composite to an object of the given kinds."""
    return typed.where((F.col("src_type") == "HCPR") & F.col("dst_type").isin(targets)).select(*finding(scenario, F.concat("src", F.lit(">"), "dst"), severity)).distinct()


def deep_stacks(typed: DataFrame, least: int = 2, high: int = 3) -> DataFrame:
    """Findings of chains of stores: a store that no other feeds within a typed graph, and `least` hops or more below it (see longest_paths)."""
    stores = typed.where("src_type IN ('ADSO', 'ODSO') AND dst_type IN ('ADSO', 'ODSO')").select("src", "dst").distinct()
    deep = longest_paths(stores).where(F.col("hops") >= least)
    return deep.select(*finding("deep_stack", F.concat(F.col("root").cast("string"), F.lit(":"), F.col("hops").cast("string")), F.when(F.col("hops") >= high, "high").otherwise("medium")))


def layer_violations(typed: DataFrame) -> DataFrame:
    """(scenario, object, severity) of typed edges (src, dst, src_type, dst_type): composites that feed stores or characteristics, self-loops, cycles,
    and stacks of three stores or more."""
    typed = cut(typed.select("src", "dst", "src_type", "dst_type"))
    edges = edges_of(typed)
    loops = self_loops(edges).select(*finding("self_loop", F.col("node"), "high"))
    round_trips = cycles(edges).where("size >= 2").select(*finding("cycle", F.col("component"), "high"))
    parts = [typed_violations(typed, "composite_to_store", ["ADSO", "ODSO"]), typed_violations(typed, "composite_to_characteristic", ["IOBJ"]), deep_stacks(typed, least=3), loops, round_trips]
    return union_of(parts).distinct()
