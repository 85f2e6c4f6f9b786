"""Queries of the graph operators, over all rows of the views they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import diff, graph, models, runs, search
from cairn.plans.base import query, table
from cairn.plans.views import view

_EDGES = ",\nedges AS (SELECT DISTINCT src, dst FROM transformation WHERE src <> '' AND dst <> '')"
_REACH = """,
reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON r.b = e.src),
mutual AS (SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a), label AS (SELECT a AS node, min(b) AS component FROM mutual GROUP BY a)"""
_KINDS = ",\nkinds AS (SELECT node, min(kind) AS kind FROM (SELECT src AS node, src_type AS kind FROM transformation UNION SELECT dst, dst_type FROM transformation) GROUP BY node)"
_WALK = """,
walk AS (SELECT src AS root, dst AS node, 1 AS hops FROM edges UNION SELECT w.root, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE w.hops < 3),
hit AS (SELECT root, node, min(hops) AS hops FROM walk GROUP BY root, node)"""


def _condensed(p: str, edges: str) -> str:
    """The components of a table of edges without self-edges as p_of (node, component), and the graph of components as p_dag."""
    return f""",
{p}_reach AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT r.a, e.dst FROM {p}_reach r JOIN {edges} e ON r.b = e.src),
{p}_mutual AS (SELECT r.a, min(r.b) AS b FROM {p}_reach r JOIN {p}_reach q ON r.a = q.b AND r.b = q.a GROUP BY r.a),
{p}_of AS (SELECT node, coalesce(b, node) AS component FROM (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}) LEFT JOIN {p}_mutual ON a = node),
{p}_dag AS (SELECT DISTINCT x.component AS src, y.component AS dst FROM {edges} e JOIN {p}_of x ON x.node = e.src JOIN {p}_of y ON y.node = e.dst WHERE x.component <> y.component)"""


def _deepest(p: str, at: str, to: str) -> str:
    """p_walk (component, depth): the most hops of the graph of components that end at one, from `at` to `to`."""
    return f""",
{p}_steps AS (SELECT DISTINCT component, 0 AS depth FROM {p}_of UNION SELECT d.{to}, w.depth + 1 FROM {p}_steps w JOIN {p}_dag d ON d.{at} = w.component),
{p}_walk AS (SELECT component, max(depth) AS depth FROM {p}_steps GROUP BY component)"""


_OTHERS = ",\nothers AS (SELECT src, dst FROM edges WHERE src <> dst)"
_STORES = ",\nstores AS (SELECT DISTINCT src, dst FROM transformation WHERE src_type IN ('ADSO', 'ODSO') AND dst_type IN ('ADSO', 'ODSO') AND src <> dst)" + _condensed("s", "stores") + _deepest("s", "dst", "src") + """,
stacks AS (SELECT node, depth AS hops FROM s_of JOIN s_walk USING (component) WHERE node IN (SELECT src FROM stores) AND node NOT IN (SELECT dst FROM stores))"""


def _graph(spark, d):
    return graph.edges_of(view(spark, d, "transformation"))


def _kinds(spark, d):
    typed = view(spark, d, "transformation")
    return typed.select(F.col("src").alias("node"), F.col("src_type").alias("kind")).union(typed.select("dst", "dst_type")).groupBy("node").agg(F.min("kind").alias("kind"))


@query(_EDGES + "\nSELECT * FROM edges", ("transformation",))
def g1_edges(spark, d):
    return _graph(spark, d)


@query(_EDGES + "\nSELECT src AS node, dst AS neighbour, 'down' AS direction FROM edges UNION SELECT dst, src, 'up' FROM edges", ("transformation",))
def g2_neighbours(spark, d):
    return graph.neighbours(_graph(spark, d))


@query(_EDGES + _KINDS + """,
known AS (SELECT node, kind FROM kinds UNION SELECT 'P' || CAST(p_partkey AS VARCHAR), 'IOBJ' FROM part WHERE p_size = 1),
outs AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1), ins AS (SELECT dst AS node, count(*) AS i FROM edges GROUP BY 1),
both_ AS (SELECT node, kind, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM known LEFT JOIN outs USING (node) LEFT JOIN ins USING (node))
SELECT unnest(['nodes', 'edges', 'sources', 'sinks', 'isolated', 'max_fan_in', 'max_fan_out']) AS measure,
  unnest([count(*), CAST(sum(o) AS BIGINT), count(*) FILTER (WHERE i = 0 AND o > 0), count(*) FILTER (WHERE o = 0 AND i > 0), count(*) FILTER (WHERE o = 0 AND i = 0), max(i), max(o)]) AS value FROM both_
UNION ALL SELECT 'type:' || kind, count(*) FROM both_ GROUP BY kind""", ("transformation",))
def a24_graph_statistics(spark, d):
    alone = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"), F.lit("IOBJ").alias("kind"))
    return graph.statistics(_graph(spark, d), _kinds(spark, d).union(alone).withColumnRenamed("kind", "type"))


@query(_EDGES + _WALK + "\nSELECT root, node, hops FROM hit", ("transformation",), recursive=True)
def g3_reachability(spark, d):
    return graph.reachability(_graph(spark, d), 3)


_HOPS = ",\nhops AS (SELECT src, dst, 'transformation' AS kind, FALSE AS free FROM transformation WHERE src_type <> 'HCPR' UNION SELECT src, dst, 'composite_part', TRUE FROM transformation WHERE src_type = 'HCPR' UNION SELECT src, tgt, 'dtp', FALSE FROM dtp WHERE updmode = 'F')"


def _hops(spark, d):
    typed, loads = view(spark, d, "transformation"), view(spark, d, "dtp").where("updmode = 'F'")
    composite = F.col("src_type") == "HCPR"
    return typed.select("src", "dst", F.when(composite, "composite_part").otherwise("transformation").alias("kind"), composite.alias("free")).union(loads.select("src", "tgt", F.lit("dtp"), F.lit(False))).distinct()


@query(_HOPS + """,
walk AS (SELECT DISTINCT src AS root, src AS node, 0 AS level FROM hops
  UNION SELECT w.root, h.dst, w.level + CASE WHEN h.free THEN 0 ELSE 1 END FROM walk w JOIN hops h ON h.src = w.node WHERE w.level + CASE WHEN h.free THEN 0 ELSE 1 END < 2),
least AS (SELECT root, node, min(level) AS level FROM walk GROUP BY root, node)
SELECT l.root, h.src, h.dst, h.kind, l.level FROM least l JOIN hops h ON h.src = l.node""", ("transformation", "dtp"), recursive=True)
def g4_lineage_down(spark, d):
    return graph.lineage(_hops(spark, d), 2, "down")


_UP = _HOPS + """,
walk AS (SELECT DISTINCT dst AS root, dst AS node, 0 AS level FROM hops
  UNION SELECT w.root, h.src, w.level + CASE WHEN h.free THEN 0 ELSE 1 END FROM walk w JOIN hops h ON h.dst = w.node WHERE w.level + CASE WHEN h.free THEN 0 ELSE 1 END <= 2),
least AS (SELECT root, node, min(level) AS level FROM walk GROUP BY root, node),
taken AS (SELECT l.root, h.src, h.dst, h.kind, l.level FROM least l JOIN hops h ON h.dst = l.node WHERE l.level < 2 OR h.free)"""


@query(_UP + "\nSELECT root, src, dst, kind, level FROM taken", ("transformation", "dtp"), recursive=True)
def g4_lineage_up(spark, d):
    return graph.lineage(_hops(spark, d), 2, "up")


@query(_UP + """
SELECT DISTINCT t.root, t.src AS node, t.src NOT IN (SELECT dst FROM hops) AS resolved FROM taken t LEFT JOIN taken u ON u.root = t.root AND u.dst = t.src WHERE u.dst IS NULL""", ("transformation", "dtp"), recursive=True)
def g10_trace_to_source(spark, d):
    hops = _hops(spark, d)
    return graph.sources_of(graph.lineage(hops, 2, "up"), hops)


@query(_EDGES + _WALK + _KINDS + """
, other AS (SELECT h.root, k.kind FROM hit h JOIN kinds k USING (node) WHERE h.node <> h.root)
SELECT root, kind, count(*) AS affected FROM other GROUP BY 1, 2 UNION ALL SELECT root, 'all', count(*) FROM other GROUP BY 1""", ("transformation",), recursive=True)
def a29_impact_counts(spark, d):
    return graph.impact(_graph(spark, d), _kinds(spark, d), 3)


@query(_EDGES + _REACH + "\nSELECT component, node, count(*) OVER (PARTITION BY component) AS size FROM label", ("transformation",), recursive=True)
def g6_cycles(spark, d):
    return graph.cycles(_graph(spark, d))


_DAG = ",\ndag AS (SELECT DISTINCT src, dst FROM transformation_dag)"


def _dag(spark, d):
    return view(spark, d, "transformation_dag").select("src", "dst").distinct()


@query(_DAG + """
, down AS (SELECT src AS node, 0 AS depth FROM dag UNION SELECT dst, 0 FROM dag UNION SELECT e.src, w.depth + 1 FROM down w JOIN dag e ON w.node = e.dst)
SELECT node AS root, max(depth) AS hops FROM down WHERE node NOT IN (SELECT dst FROM dag) AND node IN (SELECT src FROM dag) GROUP BY node""", ("transformation_dag",), recursive=True)
def g7_longest_paths(spark, d):
    return graph.longest_paths(_dag(spark, d))


@query(_EDGES + _OTHERS + _condensed("o", "others") + _deepest("o", "dst", "src") + """
SELECT node AS root, depth AS hops FROM o_of JOIN o_walk USING (component) WHERE node IN (SELECT src FROM others) AND node NOT IN (SELECT dst FROM others)""", ("transformation",), recursive=True)
def g7_longest_paths_past_cycles(spark, d):
    return graph.longest_paths(_graph(spark, d))


@query(_EDGES + _OTHERS + _condensed("o", "others") + _deepest("o", "src", "dst") + "\nSELECT node, depth AS layer FROM o_of JOIN o_walk USING (component) UNION SELECT src, 0 FROM edges WHERE src NOT IN (SELECT node FROM o_of)", ("transformation",), recursive=True)
def g8_layers_past_cycles(spark, d):
    return graph.layers(_graph(spark, d))


_LAYERS = _DAG + """,
walk AS (SELECT src AS node, 0 AS depth FROM dag UNION SELECT dst, 0 FROM dag UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN dag e ON w.node = e.src),
layers AS (SELECT node, max(depth) AS layer FROM walk GROUP BY node)"""


@query(_LAYERS + "\nSELECT node, layer FROM layers", ("transformation_dag",), recursive=True)
def g8_layers(spark, d):
    return graph.layers(_dag(spark, d))


@query(_LAYERS + """,
named AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY node) AS first FROM layers),
mean AS (SELECT b.node, avg(n.first) AS mean FROM (SELECT src AS node, dst AS other FROM dag UNION ALL SELECT dst, src FROM dag) b JOIN named n ON n.node = b.other GROUP BY 1)
SELECT node, layer, row_number() OVER (PARTITION BY layer ORDER BY coalesce(mean, first), node) AS place FROM named LEFT JOIN mean USING (node)""", ("transformation_dag",), recursive=True)
def w9_layer_order(spark, d):
    dag = _dag(spark, d)
    return graph.ordered_layers(dag, graph.layers(dag))


@query(_DAG + """,
walk AS (SELECT DISTINCT src AS a, [src] AS p, src AS tip FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION ALL SELECT w.a, list_append(w.p, e.dst), e.dst FROM walk w JOIN dag e ON w.tip = e.src WHERE NOT list_contains(w.p, e.dst) AND len(w.p) <= 24),
paths AS (SELECT a AS src, tip AS dst, array_to_string(p, '>') AS path, len(p) - 1 AS hops FROM walk WHERE tip NOT IN (SELECT src FROM dag))
SELECT src, dst, path, hops, count(*) OVER (PARTITION BY src, dst) > 3 AS truncated FROM paths QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) <= 3""", ("transformation_dag",), recursive=True)
def g5_simple_paths(spark, d):
    dag = _dag(spark, d)
    ins, outs = dag.select(F.col("dst").alias("node")).distinct(), dag.select(F.col("src").alias("node")).distinct()
    return graph.simple_paths(dag, outs.join(ins, "node", "left_anti"), ins.join(outs, "node", "left_anti"), hops=24, most=3)


@query(_EDGES + "\nSELECT src AS node FROM edges WHERE src = dst", ("transformation",))
def g21_self_loops(spark, d):
    return graph.self_loops(_graph(spark, d))


@query("""
, walk AS (SELECT area, area AS path, 0 AS level FROM info_area WHERE coalesce(parent, '') = '' UNION ALL SELECT i.area, w.path || '/' || i.area, w.level + 1 FROM walk w JOIN info_area i ON i.parent = w.area)
SELECT area, path, level FROM walk""", ("info_area",), recursive=True)
def g22_area_paths(spark, d):
    return graph.hierarchy_paths(view(spark, d, "info_area"))


_CALLS = ",\ncalls AS (SELECT DISTINCT chain_id AS src, variant AS dst FROM chain_steps WHERE step_type = 'CHAIN' AND variant IS NOT NULL)"


def _calls(spark, d):
    steps = view(spark, d, "chain_steps").where("step_type = 'CHAIN' AND variant IS NOT NULL")
    return steps.select(F.col("chain_id").alias("src"), F.col("variant").alias("dst")).distinct()


@query(_CALLS + """
, walk AS (SELECT src AS root, dst AS node, 1 AS hops FROM calls UNION SELECT w.root, e.dst, w.hops + 1 FROM walk w JOIN calls e ON w.node = e.src WHERE w.hops < 8)
SELECT root, node, min(hops) AS hops FROM walk GROUP BY root, node""", ("chain_steps",), recursive=True)
def g18_subchain_walk(spark, d):
    return graph.reachability(_calls(spark, d), 8)


@query(_CALLS + """,
tree AS (SELECT DISTINCT src AS root, [src] AS p, src AS tip, FALSE AS again FROM calls WHERE src NOT IN (SELECT dst FROM calls)
  UNION ALL SELECT t.root, list_append(t.p, c.dst), c.dst, list_contains(t.p, c.dst) FROM tree t JOIN calls c ON c.src = t.tip WHERE NOT t.again AND len(t.p) <= 5)
SELECT root, array_to_string(p, '>') AS path, len(p) - 1 AS level, again OR (len(p) > 5 AND tip IN (SELECT src FROM calls)) AS truncated FROM tree""", ("chain_steps",), recursive=True)
def g19_chain_trees(spark, d):
    calls = _calls(spark, d)
    tops = calls.select(F.col("src").alias("node")).distinct().join(calls.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.call_trees(calls, tops)


@query("""
, loads AS (SELECT DISTINCT chain_id, d.tgt AS provider FROM chain_steps s JOIN dtp d ON s.variant = d.dtp WHERE s.step_type = 'DTP_LOAD')""" + _CALLS + """,
up AS (SELECT provider, chain_id FROM loads UNION SELECT u.provider, p.src FROM up u JOIN calls p ON u.chain_id = p.dst),
rates AS (SELECT chain_id, count(DISTINCT log_id) AS runs, count(DISTINCT log_id) / (date_diff('day', min(run_day), max(run_day)) + 1) AS per_day FROM log_chain GROUP BY chain_id)
SELECT provider, count(DISTINCT u.chain_id) AS chains, arg_max(u.chain_id, struct_pack(d := coalesce(per_day, 0.0), r := coalesce(runs, 0), c := u.chain_id)) AS governing_chain FROM up u
LEFT JOIN rates r ON r.chain_id = CAST(u.chain_id AS VARCHAR) GROUP BY provider""", ("chain_steps", "dtp", "log_chain"), recursive=True)
def j8_load_closure(spark, d):
    steps, dtp = view(spark, d, "chain_steps"), view(spark, d, "dtp")
    loads = steps.where("step_type = 'DTP_LOAD'").join(dtp, steps.variant == dtp.dtp).select("chain_id", F.col("tgt").alias("provider")).distinct()
    return runs.load_closure(loads, _calls(spark, d), view(spark, d, "log_chain"))


@query("""
, modes AS (SELECT src, tgt AS dst, list_distinct(list(updmode)) AS m FROM dtp GROUP BY 1, 2), edges AS (SELECT DISTINCT src, dst, TRUE AS declared FROM transformation)
SELECT src, dst, CASE WHEN declared THEN 'transformation' ELSE 'dtp' END AS kind, array_to_string(list_filter(['F', 'I', 'D'], lambda x: coalesce(list_contains(m, x), false)), ',') AS modes
FROM edges FULL JOIN modes USING (src, dst)""", ("transformation", "dtp"))
def g11_declared_hops(spark, d):
    return graph.declared_hops(view(spark, d, "transformation"), view(spark, d, "dtp"))


@query("""
, e AS (SELECT tranid, CASE WHEN tranid % 5 = 0 THEN CAST(tranid * 10 + 1 AS VARCHAR) ELSE src END AS endpoint, CASE WHEN tranid % 5 = 0 THEN 'DTPA' ELSE src_type END AS endpoint_type FROM transformation_header),
of AS (SELECT CAST(dtp AS VARCHAR) AS dtp, min(src) AS src FROM dtp GROUP BY 1)
SELECT tranid, coalesce(src, endpoint) AS object, endpoint_type = 'DTPA' AND src IS NULL AS dangling FROM e LEFT JOIN of ON endpoint_type = 'DTPA' AND of.dtp = endpoint""", ("transformation_header", "dtp"))
def g16_dtp_endpoints(spark, d):
    by_load = F.col("tranid") % 5 == 0
    ends = view(spark, d, "transformation_header").select("tranid", F.when(by_load, (F.col("tranid") * 10 + 1).cast("string")).otherwise(F.col("src")).alias("endpoint"), F.when(by_load, "DTPA").otherwise(F.col("src_type")).alias("endpoint_type"))
    return models.dereferenced(ends, view(spark, d, "dtp").select(F.col("dtp").cast("string").alias("dtp"), "src"))


@query("""
WITH e AS (SELECT DISTINCT p_name AS endpoint FROM part), s AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS subject FROM part)
SELECT subject, count(endpoint) AS endpoints, min(endpoint) AS first_endpoint FROM s LEFT JOIN e ON string_split(endpoint, ' ')[1] = subject GROUP BY subject""")
def g17_subjects(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("endpoint")).distinct()
    return search.subjects(names.select(F.split("endpoint", " ").getItem(1).alias("subject")).distinct(), names)


@query("""
, l AS (SELECT dst, bool_or(version = 'A') AS active FROM transformation_header GROUP BY dst)
SELECT h.dst AS target, count(*) AS frozen_loaders FROM transformation_header h JOIN l ON l.dst = h.dst WHERE NOT l.active GROUP BY h.dst""", ("transformation_header",))
def z27_frozen_loaders(spark, d):
    return models.frozen_loaders(view(spark, d, "transformation_header").select(F.col("dst").alias("target"), "version"))


@query(_EDGES + "\nSELECT dst AS target, count(DISTINCT src) AS sources, string_agg(DISTINCT src, ',' ORDER BY src) AS source_list FROM edges GROUP BY dst HAVING count(DISTINCT src) >= 2", ("transformation",))
def a13_merged_streams(spark, d):
    return graph.merged_streams(_graph(spark, d))


VIOLATIONS = _STORES + """,
violations AS (SELECT 'composite_to_store' AS scenario, src || '>' || dst AS object, 'medium' AS severity FROM transformation WHERE src_type = 'HCPR' AND dst_type IN ('ADSO', 'ODSO')
UNION SELECT 'composite_to_characteristic', src || '>' || dst, 'medium' FROM transformation WHERE src_type = 'HCPR' AND dst_type = 'IOBJ' UNION SELECT 'deep_stack', node || ':' || CAST(hops AS VARCHAR), 'high' FROM stacks WHERE hops >= 3
UNION SELECT 'self_loop', src, 'high' FROM edges WHERE src = dst UNION SELECT 'cycle', component, 'high' FROM label GROUP BY component HAVING count(*) >= 2)"""


@query(_EDGES + _REACH + VIOLATIONS + "\nSELECT scenario, object, severity FROM violations", ("transformation",), recursive=True)
def c9_layer_violations(spark, d):
    return graph.layer_violations(view(spark, d, "transformation"))


@query("\nSELECT DISTINCT 'composite_to_store' AS scenario, src || '>' || dst AS object, 'medium' AS severity FROM transformation WHERE src_type = 'HCPR' AND dst_type IN ('ADSO', 'ODSO')", ("transformation",))
def c3_composite_to_store(spark, d):
    return graph.typed_violations(view(spark, d, "transformation"), "composite_to_store", ["ADSO", "ODSO"])


@query("\nSELECT DISTINCT 'composite_to_characteristic' AS scenario, src || '>' || dst AS object, 'medium' AS severity FROM transformation WHERE src_type = 'HCPR' AND dst_type = 'IOBJ'", ("transformation",))
def c4_composite_to_characteristic(spark, d):
    return graph.typed_violations(view(spark, d, "transformation"), "composite_to_characteristic", ["IOBJ"])


@query("""
, stores AS (SELECT DISTINCT src, dst FROM transformation_dag WHERE src_type IN ('ADSO', 'ODSO') AND dst_type IN ('ADSO', 'ODSO')),
down AS (SELECT src AS node, 0 AS depth FROM stores UNION SELECT dst, 0 FROM stores UNION SELECT e.src, w.depth + 1 FROM down w JOIN stores e ON w.node = e.dst),
deep AS (SELECT node, max(depth) AS hops FROM down WHERE node NOT IN (SELECT dst FROM stores) GROUP BY node)
SELECT 'deep_stack' AS scenario, CAST(node AS VARCHAR) || ':' || CAST(hops AS VARCHAR) AS object, CASE WHEN hops >= 3 THEN 'high' ELSE 'medium' END AS severity FROM deep WHERE hops >= 2""", ("transformation_dag",), recursive=True)
def c2_deep_stacks(spark, d):
    return graph.deep_stacks(view(spark, d, "transformation_dag"))


@query(_EDGES + _STORES + "\nSELECT 'deep_stack' AS scenario, node || ':' || CAST(hops AS VARCHAR) AS object, CASE WHEN hops >= 3 THEN 'high' ELSE 'medium' END AS severity FROM stacks WHERE hops >= 2", ("transformation",), recursive=True)
def c2_deep_stacks_past_cycles(spark, d):
    return graph.deep_stacks(view(spark, d, "transformation"))


@query(_EDGES + _REACH + VIOLATIONS + """,
n AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info FROM violations),
s AS (SELECT *, greatest(0.0, 100.0 - 12 * critical - 6 * high - 2 * medium - 0.5 * low) AS score FROM n)
SELECT critical, high, medium, low, info, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade FROM s""", ("transformation",), recursive=True)
def a26_landscape_score(spark, d):
    return diff.severity_score(graph.layer_violations(view(spark, d, "transformation")))


@query("""
, parts AS (SELECT DISTINCT dst AS name FROM transformation_header WHERE src_type = 'HCPR'), hoc AS (SELECT tgt AS name, count(*) AS n FROM dtp WHERE updmode = 'D' GROUP BY 1)
SELECT name, coalesce(n, 0) AS ad_hoc FROM (SELECT 'N' || CAST(o_orderkey AS VARCHAR) AS name FROM orders) c LEFT JOIN hoc USING (name)
WHERE name NOT IN (SELECT src FROM transformation_header WHERE version = 'A') AND name NOT IN (SELECT object FROM lookups) AND name NOT IN (SELECT name FROM parts)""", ("transformation_header", "dtp", "lookups"))
def j9_unused_providers(spark, d):
    header = view(spark, d, "transformation_header")
    catalogue = table(spark, d, "orders").select(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("name"))
    hoc = view(spark, d, "dtp").where("updmode = 'D'").select(F.col("tgt").alias("name"))
    uses = [header.where("version = 'A'").select(F.col("src").alias("name")), view(spark, d, "lookups").select(F.col("object").alias("name")), header.where("src_type = 'HCPR'").select(F.col("dst").alias("name"))]
    return search.unused_with_ad_hoc(catalogue, hoc, *uses)


@query("""
, k AS (SELECT src AS base, CASE src_type WHEN 'ADSO' THEN 'table' WHEN 'HCPR' THEN 'warehouse' ELSE 'calc' END AS bk, dst AS dep, CASE dst_type WHEN 'ADSO' THEN 'table' WHEN 'HCPR' THEN 'warehouse' ELSE 'calc' END AS dk FROM transformation)
SELECT DISTINCT 'reads_warehouse' AS direction, dep AS "view", base AS object FROM k WHERE bk = 'table' AND dk = 'calc' UNION SELECT 'feeds_warehouse', base, dep FROM k WHERE bk = 'calc' AND dk = 'warehouse'""", ("transformation",))
def j17_view_crossings(spark, d):
    kind = lambda c: F.when(F.col(c) == "ADSO", "table").when(F.col(c) == "HCPR", "warehouse").otherwise("calc")
    return search.crossings(view(spark, d, "transformation").select(F.col("src").alias("base"), kind("src_type").alias("base_kind"), F.col("dst").alias("dependent"), kind("dst_type").alias("dependent_kind")))


@query("""
, l AS (SELECT DISTINCT src, dst FROM transformation), r AS (SELECT DISTINCT src, tgt AS dst FROM dtp)
SELECT src, dst, 'removed' AS change FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""", ("transformation", "dtp"))
def u3_edge_changes(spark, d):
    left, right = _graph(spark, d), view(spark, d, "dtp").select("src", F.col("tgt").alias("dst")).distinct()
    return left.exceptAll(right).withColumn("change", F.lit("removed")).unionByName(right.exceptAll(left).withColumn("change", F.lit("added")))


@query("""
, hops AS (SELECT DISTINCT src AS parent, dst AS field, (src * 7 + dst) % 3 AS priority FROM transformation_dag),
chosen AS (SELECT field, parent, 'K' || CAST(priority AS VARCHAR) AS kind, n - 1 AS siblings FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY priority, parent) AS k, count(*) OVER (PARTITION BY field) AS n FROM hops) WHERE k = 1),
walk AS (SELECT field AS start, field, parent, kind, siblings, 1 AS level FROM chosen UNION ALL SELECT w.start, c.field, c.parent, c.kind, c.siblings, w.level + 1 FROM walk w JOIN chosen c ON c.field = w.parent WHERE w.level < 12)
SELECT start, field, parent, kind, siblings, level FROM walk""", ("transformation_dag",), recursive=True)
def g20_field_lineage(spark, d):
    priority = (F.col("src") * 7 + F.col("dst")) % 3
    return models.field_lineage(_dag(spark, d).select(F.col("src").alias("parent"), F.col("dst").alias("field"), priority.alias("priority"), F.concat(F.lit("K"), priority.cast("string")).alias("kind")))
