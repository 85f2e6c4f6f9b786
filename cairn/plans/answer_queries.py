"""Queries of typed hops, composed answers and the statuses, risks and properties that they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import analysis, answers, diff, governance, graph, hops, models, runs
from cairn.operators import query_definitions as definitions
from cairn.plans.base import query, table
from cairn.plans.definition_queries import _DEFINED, _TREE, _definition
from cairn.plans.views import view

_HOPS = """,
declared AS (SELECT DISTINCT src, dst FROM transformation WHERE src <> '' AND dst <> ''),
listed AS (SELECT DISTINCT provider, component FROM query_components WHERE CAST(substr(component, 2) AS BIGINT) % 3 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY component) AS n, count(*) OVER (PARTITION BY provider) AS c FROM listed),
looked AS (SELECT object, 'N' || CAST(tranid AS VARCHAR) AS target, CASE WHEN tranid % 2 = 0 THEN 0 ELSE 1 END AS way FROM lookups),
every AS (SELECT src, dst, 'transformation' AS kind, FALSE AS free, 'exact' AS confidence, '' AS note FROM declared UNION ALL SELECT DISTINCT src, tgt, 'dtp', FALSE, 'exact', '' FROM dtp WHERE (src, tgt) NOT IN (SELECT (src, dst) FROM declared)
  UNION ALL SELECT part, composite, 'composite_part', TRUE, CASE WHEN via IS NULL OR confirmed THEN 'exact' ELSE 'advisory' END, coalesce(via, '') FROM composite_part_rows WHERE part <> composite
  UNION ALL SELECT provider, component, 'query_provider', TRUE, 'exact', CASE WHEN c > 3 THEN '+' || CAST(c - 3 AS VARCHAR) ELSE '' END FROM ranked WHERE n <= 3
  UNION ALL SELECT object, target, 'lookup', FALSE, CASE WHEN min(way) = 0 THEN 'exact' ELSE 'advisory' END, '' FROM looked WHERE object <> target GROUP BY object, target
  UNION ALL SELECT trim(structure), datasource, 'source_extract', TRUE, 'exact', string_agg(DISTINCT delta, ',' ORDER BY delta) FROM extracts WHERE trim(structure) <> '' GROUP BY 1, 2),
hops AS (SELECT src, dst, kind, free, confidence, note FROM every QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY confidence <> 'exact', note) = 1)"""
_HOP_VIEWS = ("transformation", "dtp", "query_components", "composite_part_rows", "lookups", "extracts")


def _hops(spark, d):
    assigned = view(spark, d, "query_components")
    roots = assigned.where("CAST(substr(component, 2) AS BIGINT) % 3 <> 0").select("component")
    looked = view(spark, d, "lookups").select("object", F.concat(F.lit("N"), F.col("tranid").cast("string")).alias("target"), (F.col("tranid") % 2 == 0).alias("declared"))
    return hops.all_hops(
        hops.load_hops(view(spark, d, "transformation"), view(spark, d, "dtp")), hops.part_hops(view(spark, d, "composite_part_rows")), hops.query_hops(assigned, roots, most=3), hops.lookup_hops(looked.where("declared"), looked.where("NOT declared")), hops.extract_hops(view(spark, d, "extracts")),
    )


@query(_HOPS + "\nSELECT * FROM hops", _HOP_VIEWS)
def g12_typed_hops(spark, d):
    return _hops(spark, d)


_WALK = _HOPS + """,
walk AS (SELECT DISTINCT dst AS root, dst AS node, 0 AS level FROM hops WHERE kind = 'query_provider' UNION SELECT w.root, h.src, w.level + CASE WHEN h.free THEN 0 ELSE 1 END FROM walk w JOIN hops h ON h.dst = w.node WHERE w.level + CASE WHEN h.free THEN 0 ELSE 1 END <= 2),
least AS (SELECT root, node, min(level) AS level FROM walk GROUP BY root, node)
SELECT DISTINCT l.root, h.src, h.dst, h.kind, l.level FROM least l JOIN hops h ON h.dst = l.node WHERE l.level < 2 OR h.free"""


@query(_WALK, _HOP_VIEWS, recursive=True)
def g14_query_lineage(spark, d):
    found = graph.cut(_hops(spark, d))
    roots = found.where("kind = 'query_provider'").select(F.col("dst").alias("root")).distinct()
    return graph.lineage(found, 2, "up", roots)


@query(_HOPS + """,
codes AS (SELECT src AS node, min(CASE src_type WHEN 'ODSO' THEN 'dso' WHEN 'ADSO' THEN 'adso' WHEN 'IOBJ' THEN 'infoobject' WHEN 'HCPR' THEN 'compositeprovider' END) AS t FROM transformation GROUP BY 1),
codes2 AS (SELECT dst AS node, min(CASE dst_type WHEN 'ODSO' THEN 'dso' WHEN 'ADSO' THEN 'adso' WHEN 'IOBJ' THEN 'infoobject' WHEN 'HCPR' THEN 'compositeprovider' END) AS t FROM transformation GROUP BY 1),
known AS (SELECT 'N' || CAST(p_partkey AS VARCHAR) AS node FROM part WHERE p_partkey % 3 = 0), structures AS (SELECT DISTINCT src AS node, 'extract_structure' AS t FROM hops WHERE kind = 'source_extract'), found AS (SELECT node, min(t) AS t FROM (SELECT * FROM structures UNION ALL SELECT dst, 'query' FROM hops WHERE kind = 'query_provider' UNION ALL SELECT dst, 'datasource' FROM hops WHERE kind = 'source_extract') GROUP BY node)
SELECT n.node, coalesce(c.t, c2.t, CASE WHEN p.composite IS NOT NULL THEN 'compositeprovider' END, CASE WHEN k.node IS NOT NULL THEN 'dso' END, f.t, 'unknown') AS type,
  CASE WHEN c.t IS NOT NULL THEN 'source_code' WHEN c2.t IS NOT NULL THEN 'target_code' WHEN p.composite IS NOT NULL THEN 'composite_header' WHEN k.node IS NOT NULL THEN 'catalogue' WHEN f.t IS NOT NULL THEN 'hop' ELSE 'none' END AS basis
FROM (SELECT src AS node FROM hops UNION SELECT dst FROM hops) n LEFT JOIN codes c ON c.node = n.node LEFT JOIN codes2 c2 ON c2.node = n.node LEFT JOIN (SELECT DISTINCT composite FROM composite_part_rows) p ON p.composite = n.node LEFT JOIN known k ON k.node = n.node LEFT JOIN found f ON f.node = n.node""", _HOP_VIEWS)
def z28_node_types(spark, d):
    catalogue = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("name"), F.lit("dso").alias("kind"))
    return hops.node_types(_hops(spark, d), view(spark, d, "transformation"), view(spark, d, "composite_part_rows").select(F.col("composite").alias("name")), catalogue.limit(0).select("name"), catalogue)


_OBJECTS = """,
objects AS (SELECT 'N' || CAST(o_orderkey AS VARCHAR) AS answer, o_orderkey % 23 <> 4 AS active FROM orders), edges AS (SELECT DISTINCT src, dst FROM transformation WHERE src <> dst),
up AS (SELECT dst AS answer, src AS node FROM edges), down AS (SELECT src AS answer, dst AS node FROM edges),
loads AS (SELECT DISTINCT d.l[1] AS answer, s.chain_id AS chain, CASE WHEN s.chain_id % 3 = 0 THEN 'weekly' ELSE 'daily' END AS cadence FROM chain_steps s JOIN (SELECT dtp, min((tgt, updmode)) AS l FROM dtp GROUP BY dtp) d ON d.dtp = s.variant WHERE s.step_type = 'DTP_LOAD'),
frozen AS (SELECT dst AS answer FROM transformation_header GROUP BY dst HAVING NOT bool_or(version = 'A')),
sized AS (SELECT 'N' || CAST(provider AS VARCHAR) AS answer, coalesce(sum(CASE WHEN role = 'active' THEN records END), 0) AS active_records, coalesce(sum(CASE WHEN role = 'changelog' THEN records END), 0) AS changelog_records FROM volumes GROUP BY provider),
consumers AS (SELECT src AS answer, dst AS consumer, FALSE AS advisory FROM edges UNION ALL SELECT object, 'N' || CAST(tranid AS VARCHAR), TRUE FROM lookups),
parts AS (SELECT 'upstream' AS section, answer FROM up UNION ALL SELECT 'downstream', answer FROM down UNION ALL SELECT 'loads', answer FROM loads UNION ALL SELECT 'health', answer FROM sized UNION ALL SELECT 'consumers', answer FROM consumers),
counted AS (SELECT answer, section, count(*) AS n FROM parts GROUP BY 1, 2),
sections AS (SELECT o.answer, s.section, CASE WHEN s.section = 'calculation_views' THEN 'unsupported' WHEN n > 0 THEN 'complete' ELSE 'empty' END AS status, CASE WHEN s.section <> 'calculation_views' THEN coalesce(n, 0) END AS count
  FROM objects o CROSS JOIN (VALUES ('upstream'), ('downstream'), ('loads'), ('health'), ('consumers'), ('calculation_views')) s(section) LEFT JOIN counted c ON c.answer = o.answer AND c.section = s.section),
risks AS (SELECT answer, 'not_active' AS risk, 'high' AS severity, '' AS metric FROM objects WHERE NOT active UNION ALL SELECT answer, 'no_loader', 'medium', CASE WHEN answer IN (SELECT answer FROM frozen) THEN 'inactive_loader' ELSE '' END FROM objects WHERE answer NOT IN (SELECT answer FROM loads)
  UNION ALL SELECT answer, 'mixed_cadences', 'medium', string_agg(DISTINCT cadence, ',' ORDER BY cadence) FROM loads WHERE answer IN (SELECT answer FROM objects) GROUP BY answer HAVING count(DISTINCT cadence) > 1
  UNION ALL SELECT answer, 'changelog_outgrows_active', 'medium', '' FROM sized WHERE changelog_records > 3 * greatest(active_records, 1) AND answer IN (SELECT answer FROM objects) UNION ALL SELECT answer, 'no_consumer', 'low', '' FROM objects WHERE answer NOT IN (SELECT answer FROM consumers))"""
_OBJECT_VIEWS = ("transformation", "transformation_header", "chain_steps", "dtp", "volumes", "lookups")


def _objects(spark, d):
    objects = table(spark, d, "orders").select(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("answer"), (F.col("o_orderkey") % 23 != 4).alias("active"))
    edges = graph.edges_of(view(spark, d, "transformation")).where("src <> dst")
    up, down = edges.select(F.col("dst").alias("answer")), edges.select(F.col("src").alias("answer"))
    targets = runs.step_targets(view(spark, d, "chain_steps"), view(spark, d, "dtp"))
    loads = targets.select(F.col("target").alias("answer"), F.col("chain_id").alias("chain"), F.when(F.col("chain_id") % 3 == 0, "weekly").otherwise("daily").alias("cadence"))
    frozen = models.frozen_loaders(view(spark, d, "transformation_header").select(F.col("dst").alias("target"), "version")).select(F.col("target").alias("answer"))
    sized = governance.volumes(view(spark, d, "volumes")).select(F.concat(F.lit("N"), F.col("provider").cast("string")).alias("answer"), *[F.coalesce(f"{r}_records", F.lit(0)).alias(f"{r}_records") for r in ("active", "changelog")])
    consumers = down.withColumn("advisory", F.lit(False)).union(view(spark, d, "lookups").select("object", F.lit(True)))
    found = answers.sections(objects.select("answer"), {"upstream": up, "downstream": down, "loads": loads, "health": sized, "consumers": consumers, "calculation_views": None})
    return objects, found, answers.object_risks(objects, loads, frozen, sized, consumers), consumers


@query(_OBJECTS + "\nSELECT answer, section, status, count FROM sections", _OBJECT_VIEWS)
def c12_object_sections(spark, d):
    return _objects(spark, d)[1]


@query(_OBJECTS + "\nSELECT answer, risk, severity, metric FROM risks", _OBJECT_VIEWS)
def z35_object_risks(spark, d):
    return _objects(spark, d)[2]


_SUMMED = """,
rates AS (SELECT answer, count(*) FILTER (WHERE status <> 'not_applicable') AS sections, count(*) FILTER (WHERE status IN ('complete', 'empty')) AS complete, count(*) FILTER (WHERE status IN ('failed', 'unsupported', 'skipped_budget')) AS gaps,
  ['failed', 'unsupported', 'skipped_budget', 'empty', 'complete', 'not_applicable'][min(list_position(['failed', 'unsupported', 'skipped_budget', 'empty', 'complete', 'not_applicable'], status))] AS worst_section FROM sections GROUP BY answer),
loose AS (SELECT answer, count(*) FILTER (WHERE advisory) AS advisory FROM consumers GROUP BY answer),
graded AS (SELECT answer, count(*) AS risks, ['critical', 'high', 'medium', 'low', 'info'][min(list_position(['critical', 'high', 'medium', 'low', 'info'], severity))] AS worst_risk FROM risks GROUP BY answer)
SELECT answer, CASE WHEN gaps = 0 THEN CASE WHEN coalesce(advisory, 0) > 0 THEN 'medium' ELSE 'high' END WHEN 2 * gaps >= greatest(sections, 1) THEN 'low' ELSE 'medium' END AS level, worst_section, sections, complete, coalesce(risks, 0) AS risks, worst_risk, coalesce(advisory, 0) AS advisory
FROM rates LEFT JOIN loose USING (answer) LEFT JOIN graded USING (answer)"""


@query(_OBJECTS + _SUMMED, _OBJECT_VIEWS)
def c12_object_answers(spark, d):
    objects, found, risks, consumers = _objects(spark, d)
    facts = consumers.select("answer", F.when(F.col("advisory"), "inferred").otherwise("observed").alias("basis"), F.lit("lookup").alias("method"))
    return answers.answers(objects, found, risks, consumers, facts)


_QUERY_ANSWERS = _TREE + """,
conds AS (SELECT t.query AS answer, type AS kind, coalesce((SELECT bool_or(active = 'X') FROM element_selects s WHERE s.element = t.element AND s.infoobject IN ('1CONDITION', '1EXCEPTION')), FALSE) AS active FROM tree t JOIN typed y ON y.element = t.element AND type IN ('condition', 'exception')),
providers AS (SELECT query AS answer, 'N' || CAST(query AS VARCHAR) AS provider FROM roots WHERE query % 3072 <> 0), relevant AS (SELECT DISTINCT query AS answer, infoobject AS characteristic, infoobject <> 'C3' AS covered FROM rolled WHERE infoobject IN ('C1', 'C3')),
idle AS (SELECT query AS answer, 400 + query AS idle_days FROM roots WHERE query % 2048 = 1024), exits AS (SELECT DISTINCT query AS answer, low AS variable FROM rolled WHERE low_is_variable AND low IN ('1', '2')),
risks AS (SELECT query AS answer, 'no_provider' AS risk, 'medium' AS severity, '' AS metric FROM roots WHERE query NOT IN (SELECT answer FROM providers) UNION ALL SELECT answer, 'decommission_candidate', 'low', CAST(idle_days AS VARCHAR) FROM idle
  UNION ALL SELECT answer, 'user_specific_result', 'medium', string_agg(characteristic, ',' ORDER BY characteristic) FROM relevant GROUP BY 1 UNION ALL SELECT answer, 'uncovered_characteristics', 'high', string_agg(characteristic, ',' ORDER BY characteristic) FROM relevant WHERE NOT covered GROUP BY 1
  UNION ALL SELECT answer, 'customer_exit_variables', 'info', string_agg(variable, ',' ORDER BY variable) FROM exits GROUP BY 1 UNION ALL SELECT answer, 'active_conditions', 'medium', CAST(count(*) AS VARCHAR) FROM conds WHERE active AND kind = 'condition' GROUP BY 1
  UNION ALL SELECT answer, 'active_exceptions', 'info', CAST(count(*) AS VARCHAR) FROM conds WHERE active AND kind = 'exception' GROUP BY 1 UNION ALL SELECT answer, 'inactive_conditions', 'info', CAST(count(*) AS VARCHAR) FROM conds WHERE NOT active GROUP BY 1)"""


@query(_QUERY_ANSWERS + "\nSELECT answer, risk, severity, metric FROM risks", _DEFINED, recursive=True)
def c13_query_risks(spark, d):
    tree, xref, types, ranges = _definition(spark, d)
    tree = graph.cut(tree)
    rolled = graph.cut(definitions.rolled_restrictions(tree, xref, types, ranges).withColumnRenamed("query", "answer"))
    queries = tree.select(F.col("query").alias("answer")).distinct()
    conditions = definitions.conditions(tree, types, ranges, view(spark, d, "element_selects")).withColumnRenamed("query", "answer")
    relevant = rolled.where("infoobject IN ('C1', 'C3')").select("answer", F.col("infoobject").alias("characteristic"), (F.col("infoobject") != "C3").alias("covered")).distinct()
    exits = rolled.where("low_is_variable AND low IN ('1', '2')").select("answer", F.col("low").alias("variable")).distinct()
    providers = queries.where("answer % 3072 <> 0").withColumn("provider", F.concat(F.lit("N"), F.col("answer").cast("string")))
    return answers.query_risks(queries, providers, relevant, queries.where("answer % 2048 = 1024").withColumn("idle_days", F.col("answer") + 400), exits, conditions)


@query("""
, spelled AS (SELECT id, caveat, lower(caveat) AS c FROM caveats)
SELECT id, CASE WHEN contains(c, 'customer-exit') OR contains(c, 'customer exit') OR contains(c, 'dead end') OR contains(c, 'resolve at runtime') THEN 'metadata_dead_end' WHEN contains(c, 'advisory') OR contains(c, 'heuristic') OR contains(c, 'lower bound') OR contains(c, 'lower-bound') OR contains(c, 'parsed from') THEN 'heuristic_lower_bound'
  WHEN contains(c, 'truncated') OR contains(c, 'summarised') OR contains(c, 'row cap') OR contains(c, 'capped') OR contains(c, 'showing') THEN 'truncated' ELSE 'reader_caveat' END AS reason FROM spelled""", ("caveats",))
def x22_caveat_reasons(spark, d):
    return view(spark, d, "caveats").select("id", answers.caveat_reason(F.col("caveat")).alias("reason"))


@query("""
, s AS (SELECT *, trim(coalesce(currency, '')) AS c, coalesce(translation, '') AS t FROM element_settings)
SELECT element, CASE aggregation WHEN '01' THEN 'Summation' WHEN '07' THEN 'Average of all values <> 0' WHEN '77' THEN '77' END AS local_aggregation, totals IN ('U', 'C') AS total_suppressed, display IN ('X', 'Y') AS hidden,
  currency_flag IN ('3', '6') OR unit_flag IN ('3', '6') OR key_date_flag IN ('3', '6') OR hierarchy_flag IN ('3', '6') AS runtime,
  array_to_string(list_filter([CASE WHEN currency_flag <> '0' OR c <> '' OR t <> '' THEN 'currency_translation' END, CASE WHEN unit_flag NOT IN ('', '0') OR unit <> '' THEN 'unit_conversion' END, CASE WHEN aggregation IN ('07', '77') THEN 'local_aggregation' END, CASE WHEN sign = 'X' THEN 'sign_inverted' END,
    CASE WHEN cumulative = 'X' THEN 'cumulative' END, CASE WHEN constant = 'X' THEN 'constant_selection' END, CASE WHEN key_date_flag <> '0' THEN 'own_key_date' END, CASE WHEN hierarchy_flag IN ('3', '6') THEN 'hierarchy_by_variable' END], lambda x: x IS NOT NULL), ',') AS changes FROM s""", ("element_settings",))
def x16_element_properties(spark, d):
    return answers.element_properties(view(spark, d, "element_settings"))


@query("""
, known AS (SELECT dtp, min((tgt, updmode)) AS l FROM dtp GROUP BY dtp), own AS (SELECT chain_id, step_no, variant, l FROM chain_steps s LEFT JOIN known k ON k.dtp = s.variant WHERE step_type = 'DTP_LOAD'),
missing AS (SELECT chain_id, count(*) FILTER (WHERE l IS NULL) AS unresolved FROM own GROUP BY 1)
SELECT chain_id, l[1] AS target, CAST(arg_min(variant, step_no) AS VARCHAR) AS dtp, arg_min(l[2], step_no) AS updmode, count(*) AS steps, any_value(unresolved) AS unresolved FROM own JOIN missing USING (chain_id) WHERE l IS NOT NULL GROUP BY chain_id, l[1]""", ("chain_steps", "dtp"))
def j7_first_step_targets(spark, d):
    return runs.step_targets(view(spark, d, "chain_steps"), view(spark, d, "dtp"))


@query("""
, relevant AS (SELECT DISTINCT l_returnflag || CAST(l_linenumber + l_quantity % 3 AS INTEGER) AS characteristic FROM lineitem)
SELECT characteristic, coalesce(n, 0) AS authorisations, CASE WHEN n > 0 THEN 'covered' ELSE 'uncovered' END AS status FROM relevant LEFT JOIN (SELECT characteristic, count(DISTINCT auth) AS n FROM auth_values GROUP BY 1) USING (characteristic)""", ("auth_values",))
def j11_coverage(spark, d):
    flagged = table(spark, d, "lineitem").select(F.concat("l_returnflag", (F.col("l_linenumber") + F.col("l_quantity") % 3).cast("int").cast("string")).alias("characteristic"))
    return governance.coverage(flagged, view(spark, d, "auth_values"))


@query("""
WITH rules AS (SELECT o_orderkey AS rule_id, o_orderpriority AS kind FROM orders), code AS (SELECT o_orderkey AS rule_id, 'R' || CAST(o_custkey AS VARCHAR) AS codeid FROM orders WHERE o_orderkey % 3 = 1), fields AS (SELECT l_orderkey AS rule_id, l_linenumber % 2 AS role, 'F' || CAST(l_partkey AS VARCHAR) AS field FROM lineitem),
constants AS (SELECT l_orderkey AS rule_id, min(l_linestatus) AS constant FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT r.rule_id, kind, coalesce(string_agg(DISTINCT CASE WHEN role = 0 THEN field END, ',' ORDER BY CASE WHEN role = 0 THEN field END), '') AS sources, coalesce(string_agg(DISTINCT CASE WHEN role = 1 THEN field END, ',' ORDER BY CASE WHEN role = 1 THEN field END), '') AS targets, any_value(constant) AS constant, any_value(codeid) AS routine
FROM rules r LEFT JOIN fields USING (rule_id) LEFT JOIN constants USING (rule_id) LEFT JOIN code USING (rule_id) GROUP BY r.rule_id, kind""")
def j14_rules_with_routines(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    rules = orders.select(F.col("o_orderkey").alias("rule_id"), F.col("o_orderpriority").alias("kind"))
    fields = items.select(F.col("l_orderkey").alias("rule_id"), (F.col("l_linenumber") % 2).alias("role"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("field"))
    constants = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rule_id"), F.col("l_linestatus").alias("value"))
    routines = orders.select(F.col("o_orderkey").alias("rule_id"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("R"), F.col("o_custkey").cast("string"))).otherwise("").alias("codeid"))
    return models.assembled_rules(rules, fields, constants, routines)


@query("""
WITH ours AS (SELECT DISTINCT 'D' || CAST(p_size % 9 AS VARCHAR) AS domain, CAST(p_partkey % 11 AS VARCHAR) AS code, 'L' || CAST(p_partkey % 11 AS VARCHAR) AS label, p_size % 9 < 5 AS complete FROM part WHERE p_partkey % 11 <> 10), theirs AS (SELECT DISTINCT 'D' || CAST(p_size % 12 AS VARCHAR) AS domain, CAST(p_partkey % 13 AS VARCHAR) AS code,
  CASE WHEN p_partkey % 13 = 4 THEN 'other' ELSE 'L' || CAST(p_partkey % 13 AS VARCHAR) END AS label FROM part WHERE p_size % 12 > 1 AND p_partkey % 13 <> 7),
sides AS (SELECT domain, bool_and(complete) AS complete FROM ours GROUP BY 1), both_ AS (SELECT domain, complete FROM sides WHERE domain IN (SELECT domain FROM theirs))
SELECT domain, code, CASE WHEN o.label IS NULL THEN 'unmapped' WHEN t.label IS NULL THEN 'undeclared' ELSE 'label_differs' END AS finding, CASE WHEN o.label IS NULL THEN CASE WHEN b.complete THEN 'high' ELSE 'info' END WHEN t.label IS NULL THEN 'info' ELSE 'low' END AS severity
FROM ours o FULL JOIN theirs t USING (domain, code) JOIN both_ b USING (domain) WHERE o.label IS DISTINCT FROM t.label UNION ALL SELECT domain, NULL, 'domain_absent', 'high' FROM sides WHERE domain NOT IN (SELECT domain FROM theirs) UNION ALL SELECT DISTINCT domain, NULL, 'not_decoded', 'info' FROM theirs WHERE domain NOT IN (SELECT domain FROM ours)""")
def c22_drift_of_domains(spark, d):
    part = table(spark, d, "part")
    name = lambda c: F.concat(F.lit("D"), c.cast("string")).alias("domain")
    ours, theirs = F.col("p_partkey") % 11, F.col("p_partkey") % 13
    decoded = part.where(ours != 10).select(name(F.col("p_size") % 9), ours.cast("string").alias("code"), F.concat(F.lit("L"), ours.cast("string")).alias("label"), (F.col("p_size") % 9 < 5).alias("complete")).distinct()
    declared = part.where((F.col("p_size") % 12 > 1) & (theirs != 7)).select(name(F.col("p_size") % 12), theirs.cast("string").alias("code"), F.when(theirs == 4, "other").otherwise(F.concat(F.lit("L"), theirs.cast("string"))).alias("label")).distinct()
    return diff.domain_drift(decoded, declared)


_NEEDS = {"composite_to_store": "transformation", "self_loop": "transformation", "success_rate": "log_chain", "no_objects": "objects_of_no_kind", "dashboards": "external", "parsed": "code_table"}


@query("""
, scenarios AS (SELECT * FROM (VALUES ('composite_to_store'), ('self_loop'), ('success_rate'), ('no_objects'), ('dashboards'), ('parsed')) v(scenario)),
candidates AS (SELECT 'composite_to_store' AS scenario, count(*) AS candidates FROM transformation WHERE src_type = 'HCPR' UNION ALL SELECT 'self_loop', count(*) FROM transformation UNION ALL SELECT 'success_rate', count(DISTINCT chain_id) FROM log_chain UNION ALL SELECT 'no_objects', count(*) FROM transformation WHERE src_type = 'XXXX' UNION ALL SELECT 'dashboards', count(*) FROM transformation)
SELECT scenario, CASE scenario WHEN 'parsed' THEN 'unsupported' WHEN 'dashboards' THEN 'connector_required' ELSE CASE WHEN coalesce(candidates, 0) = 0 THEN 'nothing_to_assess' ELSE 'assessed' END END AS status, coalesce(candidates, 0) AS candidates FROM scenarios LEFT JOIN candidates USING (scenario)""", ("transformation", "log_chain"))
def c11_scenario_statuses(spark, d):
    typed, log = view(spark, d, "transformation"), view(spark, d, "log_chain")
    scenarios = typed.limit(1).select(F.explode(F.array(*[F.lit(s) for s in _NEEDS])).alias("scenario"))
    count = lambda df, name: df.agg(F.count("*").alias("candidates")).select(F.lit(name).alias("scenario"), "candidates")
    candidates = graph.union_of([count(typed.where("src_type = 'HCPR'"), "composite_to_store"), count(typed, "self_loop"), count(log.select("chain_id").distinct(), "success_rate"), count(typed.where("src_type = 'XXXX'"), "no_objects"), count(typed, "dashboards")])
    return answers.scenario_statuses(scenarios, scenarios.where("scenario = 'parsed'"), candidates, scenarios.where("scenario = 'dashboards'"))


@query("""
, edges AS (SELECT DISTINCT src AS object, dst AS affected FROM transformation WHERE src <> dst),
every AS (SELECT object, affected, 'feeds' AS relationship, 1 AS k, 'high' AS severity, FALSE AS advisory FROM edges UNION SELECT object, 'N' || CAST(tranid AS VARCHAR), 'looked_up', 1, 'high', tranid % 2 = 1 FROM lookups UNION SELECT provider, component, 'queried', 2, 'medium', FALSE FROM query_components
  UNION SELECT part, composite, 'calculation_view', 1, 'high', FALSE FROM composite_part_rows)
SELECT object, affected, relationship, severity, advisory FROM every WHERE object <> affected QUALIFY row_number() OVER (PARTITION BY object, affected ORDER BY advisory, k, relationship) = 1""", ("transformation", "lookups", "query_components", "composite_part_rows"))
def c15_impact_items(spark, d):
    fed = graph.edges_of(view(spark, d, "transformation")).select(F.col("src").alias("object"), F.col("dst").alias("affected"))
    looked = view(spark, d, "lookups").select("object", F.concat(F.lit("N"), F.col("tranid").cast("string")).alias("affected"), (F.col("tranid") % 2 == 1).alias("advisory"))
    asked = view(spark, d, "query_components").select(F.col("provider").alias("object"), F.col("component").alias("affected"))
    return analysis.impact_items(fed, looked, asked, view(spark, d, "composite_part_rows").select(F.col("part").alias("object"), F.col("composite").alias("affected")))
