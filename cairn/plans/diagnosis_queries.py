"""Queries of the walk of missing data, routines and their source, reports about the system, and answers cut to size."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import diagnosis, diff, graph, models, reports, routines, runs
from cairn.plans.answer_queries import _HOP_VIEWS, _HOPS, _hops
from cairn.plans.base import query, table
from cairn.plans.views import view
from cairn.sources.registry import Landscape

_HELD = """,
kinds AS (SELECT provider, min(kind) AS kind FROM (SELECT src AS provider, CASE src_type WHEN 'HCPR' THEN 'compositeprovider' ELSE lower(src_type) END AS kind FROM transformation UNION ALL SELECT dst, CASE dst_type WHEN 'HCPR' THEN 'compositeprovider' ELSE lower(dst_type) END FROM transformation) GROUP BY 1),
targets AS (SELECT DISTINCT component AS target, provider FROM query_components UNION SELECT 'N' || CAST(provider AS VARCHAR), 'N' || CAST(provider AS VARCHAR) FROM requests UNION SELECT component || 'x', ' ' FROM query_components WHERE component LIKE '%7'),
opened AS (SELECT target, t.provider, m.part, CASE WHEN k.kind IS NULL THEN 'unresolved' WHEN k.kind <> 'compositeprovider' THEN 'not_union' WHEN m.part IS NULL THEN 'unresolved' ELSE 'parts' END AS source FROM targets t LEFT JOIN kinds k ON k.provider = t.provider LEFT JOIN union_parts m ON m.composite = t.provider WHERE trim(t.provider) <> ''),
holders AS (SELECT DISTINCT target, CASE WHEN source = 'parts' THEN part ELSE provider END AS provider, CASE WHEN source = 'parts' THEN provider END AS part_of, source, TRUE AS diagnosed FROM opened)"""
_HEALTH = """,
booked AS (SELECT 'N' || CAST(provider AS VARCHAR) AS provider, count(*) AS requests, count(*) FILTER (WHERE status = 'error') AS failed, arg_max(status, (started, rnr)) AS last_status, date_diff('day', max(started) FILTER (WHERE status = 'success'), (SELECT max(started) FROM requests)) AS age_days FROM requests GROUP BY 1),
held AS (SELECT 'N' || CAST(provider AS VARCHAR) AS provider, CAST(sum(CASE WHEN role <> 'active' THEN 0 WHEN provider % 5 = 0 THEN 0 ELSE records END) AS BIGINT) AS active_records FROM volumes GROUP BY 1),
health AS (SELECT provider, coalesce(requests, 0) AS requests, coalesce(failed, 0) AS failed, last_status, age_days, active_records FROM booked FULL JOIN held USING (provider))"""
_RISKS = _HELD + _HEALTH + """,
every AS (SELECT DISTINCT provider FROM holders), loaded AS (SELECT DISTINCT d.l[1] AS provider FROM chain_steps s JOIN (SELECT dtp, min((tgt, updmode)) AS l FROM dtp GROUP BY dtp) d ON d.dtp = s.variant WHERE s.step_type = 'DTP_LOAD'),
frozen AS (SELECT dst AS provider, count(*) AS n FROM transformation_header GROUP BY dst HAVING NOT bool_or(version = 'A')), coded AS (SELECT dst AS provider, count(DISTINCT tranid) AS n FROM transformation_header WHERE version = 'A' AND (startroutine <> '' OR endroutine <> '' OR expert <> '') GROUP BY dst),
seen AS (SELECT * FROM health WHERE provider IN (SELECT provider FROM every)),
single AS (SELECT provider, 'no_rows' AS risk, 'critical' AS severity, NULL AS metric FROM seen WHERE active_records = 0 UNION ALL SELECT provider, 'last_load_failed', 'critical', last_status FROM seen WHERE last_status IN ('error', 'incomplete') UNION ALL SELECT provider, 'late', CASE WHEN age_days > 7 THEN 'high' ELSE 'medium' END, CAST(age_days AS VARCHAR) FROM seen WHERE age_days > 1
  UNION ALL SELECT provider, 'failed_requests', 'medium', CAST(failed AS VARCHAR) FROM seen WHERE failed > 0 UNION ALL SELECT provider, 'no_loader', CASE WHEN n IS NULL THEN 'high' ELSE 'medium' END, CAST(n AS VARCHAR) FROM every LEFT JOIN frozen USING (provider) WHERE provider NOT IN (SELECT provider FROM loaded)
  UNION ALL SELECT provider, 'routines', 'medium', CAST(n AS VARCHAR) FROM every JOIN coded USING (provider)),
of_union AS (SELECT DISTINCT part_of, provider FROM holders WHERE part_of IS NOT NULL),
mixed AS (SELECT part_of, count(*) AS parts, count(age_days) AS known, max(age_days) - min(age_days) AS spread_days, max(age_days) AS oldest_days, count(*) FILTER (WHERE age_days >= 30) AS stale_parts, count(*) FILTER (WHERE age_days < 1) AS current_parts, CAST(coalesce(sum(active_records) FILTER (WHERE age_days >= 30), 0) AS BIGINT) AS stale_records,
  CASE WHEN max(age_days) > 365 THEN 'high' ELSE 'medium' END AS severity FROM of_union LEFT JOIN health USING (provider) GROUP BY part_of HAVING count(age_days) >= 2 AND max(age_days) - min(age_days) >= 30),
restricted AS (SELECT DISTINCT component AS target, 'C' || right(provider, 1) AS characteristic FROM query_components WHERE provider LIKE '%3'),
found AS (SELECT h.target, provider, risk, severity, metric FROM (SELECT DISTINCT target, provider FROM holders) h JOIN single USING (provider) UNION ALL SELECT target, part_of, 'mixed_currency', severity, CAST(spread_days AS VARCHAR) FROM (SELECT DISTINCT target, part_of FROM holders) JOIN mixed USING (part_of)
  UNION ALL SELECT target, NULL, 'user_specific_result', 'high', CAST(count(*) AS VARCHAR) FROM restricted GROUP BY target)"""
_LIMITS = """,
gaps AS (SELECT target, part_of AS provider, 'reader_caveat' AS reason FROM holders WHERE part_of IS NOT NULL UNION SELECT target, provider, 'metadata_dead_end' FROM holders WHERE source = 'unresolved' UNION SELECT target, NULL, 'metadata_dead_end' FROM targets WHERE target NOT IN (SELECT target FROM holders))"""
_HELD_VIEWS = ("transformation", "query_components", "requests", "union_parts")
_RISK_VIEWS = (*_HELD_VIEWS, "volumes", "chain_steps", "dtp", "transformation_header")


def _holders(spark, d):
    ends = view(spark, d, "transformation")
    kind = lambda node, t: ends.select(F.col(node).alias("provider"), F.when(F.col(t) == "HCPR", "compositeprovider").otherwise(F.lower(t)).alias("kind"))
    asked = view(spark, d, "query_components")
    named = view(spark, d, "requests").select(F.concat(F.lit("N"), F.col("provider").cast("string")).alias("provider"))
    blank = asked.where("component LIKE '%7'").select(F.concat("component", F.lit("x")), F.lit(" "))
    targets = asked.select(F.col("component").alias("target"), "provider").union(named.select("provider", "provider")).union(blank).distinct()
    return targets, diagnosis.bearers(targets, kind("src", "src_type").union(kind("dst", "dst_type")), view(spark, d, "union_parts"))


def _health(spark, d):
    name = F.concat(F.lit("N"), F.col("provider").cast("string")).alias("provider")
    records = F.when((F.col("role") != "active") | (F.col("provider") % 5 == 0), 0).otherwise(F.col("records"))
    volumes = view(spark, d, "volumes").select(name, records.alias("active_records"))
    health = diagnosis.load_health(view(spark, d, "requests").select(name, "rnr", "started", "status"), volumes)
    return health.withColumn("active_records", F.col("active_records").cast("long"))


def _walk(spark, d):
    targets, holders = _holders(spark, d)
    holders = graph.cut(holders)
    health = graph.cut(_health(spark, d))
    headers = view(spark, d, "transformation_header").withColumnRenamed("dst", "provider")
    idle = models.frozen_loaders(headers.select(F.col("provider").alias("target"), "version")).select(F.col("target").alias("provider"))
    frozen = headers.join(idle, "provider", "left_semi").select("provider")
    chains = runs.step_targets(view(spark, d, "chain_steps"), view(spark, d, "dtp")).select(F.col("target").alias("provider"))
    coded = headers.where("version = 'A' AND (startroutine <> '' OR endroutine <> '' OR expert <> '')").select("provider", "tranid")
    restricted = view(spark, d, "query_components").where("provider LIKE '%3'").select(F.col("component").alias("target"), F.concat(F.lit("C"), F.right("provider", F.lit(1))).alias("characteristic"))
    risks = diagnosis.provider_risks(holders, health, chains, frozen, coded)
    return targets, holders, health, diagnosis.findings(holders, risks, health, restricted)


@query(_HELD + "\nSELECT target, provider, part_of, source, diagnosed FROM holders", _HELD_VIEWS)
def z7_data_bearers(spark, d):
    return _holders(spark, d)[1]


@query(_RISKS + "\nSELECT target, provider, risk, severity, metric FROM found", _RISK_VIEWS)
def z34_missing_data_findings(spark, d):
    return _walk(spark, d)[3]


@query(_RISKS + "\nSELECT * FROM mixed", _RISK_VIEWS)
def c16_mixed_currency(spark, d):
    holders = _holders(spark, d)[1].where("part_of IS NOT NULL").select("part_of", "provider").distinct()
    return diagnosis.mixed_currency(holders.join(_health(spark, d), "provider", "left").select("part_of", "provider", "age_days", "active_records"))


@query(_HELD + _LIMITS + "\nSELECT target, provider, reason FROM gaps", _HELD_VIEWS)
def c16_limits(spark, d):
    return diagnosis.limits(*_holders(spark, d))


@query(_RISKS + _LIMITS + """,
per AS (SELECT target, count(DISTINCT provider) AS holders, count(DISTINCT part_of) AS unions FROM holders GROUP BY 1), dead AS (SELECT target, count(*) AS gaps FROM gaps WHERE reason <> 'reader_caveat' GROUP BY 1),
summed AS (SELECT target, count(*) AS risks, ['critical', 'high', 'medium', 'low', 'info'][min(list_position(['critical', 'high', 'medium', 'low', 'info'], severity))] AS worst, bool_or(risk NOT IN ('failed_requests', 'routines', 'user_specific_result')) AS by_load, bool_or(risk = 'user_specific_result') AS by_user FROM found GROUP BY 1)
SELECT target, coalesce(holders, 0) AS holders, coalesce(unions, 0) AS unions, coalesce(holders, 0) AS diagnosed, coalesce(risks, 0) AS risks, worst, coalesce(gaps, 0) AS gaps, CASE WHEN by_load THEN 'load' WHEN by_user THEN 'users' WHEN gaps > 0 THEN 'unknown' ELSE 'logic' END AS points_to
FROM (SELECT DISTINCT target FROM targets) LEFT JOIN per USING (target) LEFT JOIN summed USING (target) LEFT JOIN dead USING (target)""", _RISK_VIEWS)
def c16_missing_data(spark, d):
    targets, holders, _, found = _walk(spark, d)
    return diagnosis.verdicts(targets, holders, found, diagnosis.limits(targets, holders))


_REFS = """,
named AS (SELECT tranid, 0 AS slot, 'start' AS kind, startroutine AS codeid, CAST(NULL AS BIGINT) AS rule_id, 0 AS step_id FROM routine_headers UNION ALL SELECT tranid, 1, 'end', endroutine, NULL, 0 FROM routine_headers UNION ALL SELECT tranid, 2, 'expert', expert, NULL, 0 FROM routine_headers
  UNION ALL SELECT tranid, 3, 'global', glbcode, NULL, 0 FROM routine_headers UNION ALL SELECT tranid, 4, 'global', glbcode2, NULL, 0 FROM routine_headers
  UNION ALL SELECT tranid, 5, CASE trim(kind) WHEN 'FORMULA' THEN 'formula' WHEN 'UNIT' THEN 'unit' ELSE 'field' END, codeid, rule_id, step_id FROM routine_steps WHERE tranid IN (SELECT tranid FROM routine_headers)),
first AS (SELECT tranid, trim(codeid) AS codeid, kind, rule_id, slot, step_id FROM named WHERE trim(codeid) <> '' QUALIFY row_number() OVER (PARTITION BY tranid, trim(codeid) ORDER BY slot, rule_id NULLS FIRST, step_id, kind) = 1),
refs AS (SELECT tranid, codeid, kind, rule_id, row_number() OVER (PARTITION BY tranid ORDER BY slot, rule_id NULLS FIRST, step_id, codeid) AS place FROM first)"""


def _refs(spark, d):
    return routines.routine_refs(view(spark, d, "routine_headers"), view(spark, d, "routine_steps"))


@query(_REFS + "\nSELECT tranid, codeid, kind, rule_id, place FROM refs", ("routine_headers", "routine_steps"))
def z15_routine_refs(spark, d):
    return _refs(spark, d)


@query(_REFS + "\nSELECT tranid, codeid, kind, rule_id, place, line_no, line FROM refs LEFT JOIN code_lines USING (codeid)", ("routine_headers", "routine_steps", "code_lines"))
def z15_routine_source(spark, d):
    return routines.routine_source(_refs(spark, d), view(spark, d, "code_lines"))


@query(_REFS + """,
sized AS (SELECT codeid, count(*) AS n FROM code_lines GROUP BY 1), said AS (SELECT codeid, arg_min(trim(text), (langu <> 'E', langu, text)) AS description FROM code_texts WHERE trim(text) <> '' GROUP BY 1),
rows_ AS (SELECT trim(codeid) AS codeid, nullif(trim(codetp), '') AS kind_code, nullif(trim(owner), '') AS owner, objstat = 'ACT' AS act, activfl = 'X' AS flag, trim(dependency) AS dependency FROM code_registry),
one AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY codeid ORDER BY kind_code NULLS FIRST, owner NULLS FIRST, act NULLS FIRST, flag NULLS FIRST, dependency) = 1)
SELECT codeid, kind_code, CASE kind_code WHEN 'UR' THEN 'update_rule' WHEN 'TC' THEN 'time_conversion' WHEN 'TR' THEN 'transfer_rule' WHEN 'IC' THEN 'infoobject_conversion' WHEN 'GR' THEN 'global_routine' WHEN 'S1' THEN 'deletion_routine_sdl' WHEN 'TF' THEN 'transformation' ELSE 'unknown' END AS kind, description, owner, coalesce(act, FALSE) AND coalesce(flag, FALSE) AS active,
  CASE dependency WHEN '0' THEN 'uses no source-structure field' WHEN '1' THEN 'uses selected source-structure fields' WHEN '2' THEN 'uses the whole source structure' WHEN '' THEN 'indeterminate' END AS uses, coalesce(n, 0) AS line_count, coalesce(n, 0) > 0 AS source_available
FROM one LEFT JOIN said USING (codeid) LEFT JOIN sized USING (codeid) WHERE codeid IN (SELECT codeid FROM refs)""", ("routine_headers", "routine_steps", "code_lines", "code_registry", "code_texts"))
def z19_routine_registry(spark, d):
    return routines.routine_registry(_refs(spark, d), view(spark, d, "code_registry"), view(spark, d, "code_texts"), view(spark, d, "code_lines"))


@query("""
, ends AS (SELECT DISTINCT 'DS' || CAST(o_custkey AS VARCHAR) AS datasource, CASE o_orderkey % 4 WHEN 0 THEN 'SYS1' WHEN 1 THEN 'SYS2' WHEN 2 THEN 'SYS9' ELSE '' END AS system FROM orders),
rows_ AS (SELECT datasource, trim(system) AS system, (trim(structure), trim(type), coalesce(trim(delta), '')) AS r FROM source_systems), best AS (SELECT datasource, system, min(r) AS r FROM rows_ WHERE system <> '' GROUP BY 1, 2 UNION ALL SELECT datasource, '', min(r) FROM rows_ GROUP BY 1)
SELECT datasource, nullif(system, '') AS system, r[1] AS structure, r[2] AS type, r[3] AS delta FROM ends LEFT JOIN best USING (datasource, system)""", ("source_systems",))
def z40_extracts(spark, d):
    at = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'SYS1' WHEN 1 THEN ' SYS2' WHEN 2 THEN 'SYS9' END")
    return routines.extracts(table(spark, d, "orders").select(F.concat(F.lit("DS"), F.col("o_custkey").cast("string")).alias("datasource"), at.alias("system")), view(spark, d, "source_systems"))


_REPORT = """,
report AS (SELECT capability, coalesce(c.object, p.object) AS object, coalesce(state, 'PLANNED') AS state, coalesce(validation, 'not_validated') AS validation, present, row_estimate,
  CASE WHEN coalesce(implemented, FALSE) THEN CASE WHEN present = FALSE THEN 'absent_on_system' ELSE 'usable' END WHEN present = FALSE THEN 'not_applicable' ELSE 'not_implemented' END AS verdict FROM contract c FULL JOIN probes p USING (capability))"""


def _report(spark, d):
    return reports.capability_report(view(spark, d, "contract"), view(spark, d, "probes"))


@query(_REPORT + "\nSELECT * FROM report", ("contract", "probes"))
def c28_capability_report(spark, d):
    return _report(spark, d)


@query(_REPORT + """
SELECT 'verdict' AS total, verdict AS value, count(*) AS capabilities FROM report GROUP BY verdict UNION ALL SELECT 'state', state, count(*) FROM report GROUP BY state UNION ALL SELECT 'validation', validation, count(*) FROM report WHERE verdict = 'usable' GROUP BY validation
UNION ALL SELECT 'caveat', 'untracked', count(*) FROM report WHERE present IS NULL HAVING count(*) > 0 UNION ALL SELECT 'caveat', 'unproven', count(*) FROM report WHERE verdict = 'usable' AND validation IN ('not_validated', 'unit_tested') HAVING count(*) > 0""", ("contract", "probes"))
def c28_capability_totals(spark, d):
    return reports.capability_totals(_report(spark, d))


_GROUPS = """,
each AS (SELECT DISTINCT grp, g.capability, probe, present FROM grants g LEFT JOIN probes p ON p.capability = g.capability),
counts AS (SELECT grp, count(probe) AS tracked, count(*) FILTER (WHERE probe = 'denied') AS denied, count(*) FILTER (WHERE probe IN ('failed', 'not_probed')) AS undetermined, count(*) FILTER (WHERE probe = 'answered') AS answered, count(*) FILTER (WHERE probe = 'answered' AND present) AS there FROM each GROUP BY grp),
states AS (SELECT grp, CASE WHEN denied > 0 AND answered > 0 THEN 'partial' WHEN denied > 0 THEN 'denied' WHEN answered = 0 THEN 'undetermined' WHEN there > 0 THEN 'granted' ELSE 'absent' END AS state, tracked, denied, undetermined FROM counts)"""


@query(_GROUPS + "\nSELECT * FROM states", ("grants", "probes"))
def c28_grant_groups(spark, d):
    return reports.grant_groups(view(spark, d, "grants"), view(spark, d, "probes"))


@query(_GROUPS + """
SELECT CASE WHEN bool_or(state IN ('denied', 'partial')) THEN 'least_privilege' WHEN count(*) = 0 OR bool_or(state = 'undetermined') THEN 'unknown' ELSE 'technical_read' END AS mode, count(*) AS voting FROM states WHERE tracked > 0""", ("grants", "probes"))
def c28_access_mode(spark, d):
    return reports.access_mode(reports.grant_groups(view(spark, d, "grants"), view(spark, d, "probes")))


@query(_REPORT + """,
needs AS (SELECT DISTINCT l_orderkey AS tool, 'C' || CAST(l_partkey AS VARCHAR) AS capability FROM lineitem), met AS (SELECT tool, n.capability, coalesce(present, FALSE) AS there FROM needs n LEFT JOIN report r ON r.capability = n.capability)
SELECT tool, count(*) AS requires, count(*) FILTER (WHERE NOT there) AS missing, min(capability) FILTER (WHERE NOT there) AS first_missing, bool_and(there) AS runs FROM met GROUP BY tool""", ("contract", "probes"))
def c28_tool_support(spark, d):
    needs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tool"), F.concat(F.lit("C"), F.col("l_partkey").cast("string")).alias("capability"))
    return reports.tool_support(needs, _report(spark, d))


@query("""
WITH probed AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'dso_header' WHEN 1 THEN 'adso' WHEN 2 THEN 'composite_provider' ELSE 'other' END AS capability, p_partkey % 4 <> 2 AND p_size > 20 AS present, p_partkey % 3 = 0 AS unreadable FROM part),
variants AS (SELECT unnest(['classic_dso', 'adso', 'composite_provider', 'multiprovider']) AS variant, unnest(['dso_header', 'adso', 'composite_provider', 'multiprovider_part']) AS capability)
SELECT variant, coalesce(bool_or(present), FALSE) AS present, NOT coalesce(bool_or(present), FALSE) AND coalesce(bool_or(unreadable), FALSE) AS inconclusive FROM variants LEFT JOIN probed USING (capability) GROUP BY variant""")
def z38_object_models(spark, d):
    return reports.object_models(table(spark, d, "part").selectExpr("CASE p_partkey % 4 WHEN 0 THEN 'dso_header' WHEN 1 THEN 'adso' WHEN 2 THEN 'composite_provider' ELSE 'other' END AS capability", "p_partkey % 4 <> 2 AND p_size > 20 AS present", "p_partkey % 3 = 0 AS unreadable"))


@query("""
WITH fields AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'S' || CAST(l_suppkey AS VARCHAR) ELSE 'O' || CAST(l_orderkey AS VARCHAR) END AS provider, 'F' || CAST(l_partkey AS VARCHAR) AS field, min(l_linenumber) = 1 AS is_key FROM lineitem GROUP BY 1, 2), totals AS (SELECT provider, count(*) AS total FROM fields GROUP BY 1)
SELECT provider, field, is_key, total, total > 40 AS summarised FROM fields JOIN totals USING (provider) WHERE total <= 40 OR is_key""")
def o7_shaped_fields(spark, d):
    lines = table(spark, d, "lineitem")
    named = lines.selectExpr("CASE WHEN l_suppkey % 2 = 0 THEN concat('S', l_suppkey) ELSE concat('O', l_orderkey) END AS provider", "concat('F', l_partkey) AS field", "l_linenumber")
    return reports.shaped_fields(named.groupBy("provider", "field").agg((F.min("l_linenumber") == 1).alias("is_key")))


@query("""
WITH lines AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 'S' || CAST(l_suppkey AS VARCHAR) ELSE 'O' || CAST(l_orderkey AS VARCHAR) END AS root, 'P' || CAST(l_partkey % 40 AS VARCHAR) AS p, 'Q' || CAST(l_orderkey AS VARCHAR) AS q FROM lineitem),
nodes AS (SELECT DISTINCT root, root AS node, 0 AS level FROM lines UNION SELECT root, p, 1 FROM lines UNION SELECT root, q, 2 FROM lines), edges AS (SELECT root, root AS src, p AS dst FROM lines UNION SELECT root, p, q FROM lines),
sizes AS (SELECT * FROM (SELECT root, count(*) AS node_count FROM nodes GROUP BY 1) JOIN (SELECT root, count(*) AS edge_count FROM edges GROUP BY 1) USING (root)), near AS (SELECT root, node FROM nodes QUALIFY row_number() OVER (PARTITION BY root ORDER BY level, node) <= 60),
both_ AS (SELECT root, src, dst FROM edges e JOIN sizes USING (root) WHERE node_count <= 60 AND edge_count <= 90 UNION ALL (SELECT e.root, e.src, e.dst FROM edges e JOIN sizes s ON s.root = e.root AND (node_count > 60 OR edge_count > 90) JOIN near a ON a.root = e.root AND a.node = e.src JOIN near b ON b.root = e.root AND b.node = e.dst QUALIFY row_number() OVER (PARTITION BY e.root ORDER BY e.src, e.dst) <= 90))
SELECT root, src, dst, node_count, edge_count, least(node_count, 60) AS nodes_shown, node_count > 60 OR edge_count > 90 AS summarised FROM sizes LEFT JOIN both_ USING (root)""")
def o7_shaped_graphs(spark, d):
    lines = table(spark, d, "lineitem").selectExpr("CASE WHEN l_suppkey % 2 = 0 THEN concat('S', l_suppkey) ELSE concat('O', l_orderkey) END AS root", "concat('P', l_partkey % 40) AS p", "concat('Q', l_orderkey) AS q")
    lines = graph.cut(lines.distinct())
    node = lambda c, level: lines.select("root", F.col(c).alias("node"), F.lit(level).alias("level"))
    edges = lines.select("root", F.col("root").alias("src"), F.col("p").alias("dst")).union(lines.select("root", "p", "q"))
    return reports.shaped_graphs(node("root", 0).union(node("p", 1)).union(node("q", 2)), edges)


@query("""
, edges AS (SELECT DISTINCT src, dst FROM transformation WHERE src <> dst), starts AS (SELECT DISTINCT provider AS root FROM query_components),
walk AS (SELECT root, root AS node, 0 AS hops FROM starts UNION SELECT w.root, e.src, w.hops + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.hops < 8), feeds AS (SELECT DISTINCT root, node FROM walk WHERE node IN (SELECT 'N' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 3 = 1)),
named AS (SELECT root, node, count(*) OVER (PARTITION BY root) AS total, row_number() OVER (PARTITION BY root ORDER BY node) AS n FROM feeds)
SELECT DISTINCT component, root AS provider, node AS datasource, total FROM named JOIN query_components ON provider = root WHERE n <= 25""", ("transformation", "query_components"), recursive=True)
def z14_query_boundaries(spark, d):
    asked = view(spark, d, "query_components").select("component", "provider").distinct()
    starts = asked.select(F.col("provider").alias("root")).distinct()
    edges = graph.edges_of(view(spark, d, "transformation")).where("src <> dst")
    reached = graph.reachability(graph.turned(edges), 8, starts).select("root", "node").union(starts.select("root", "root"))
    datasources = table(spark, d, "orders").where("o_orderkey % 3 = 1").select(F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("node"))
    feeds = reached.join(datasources, "node", "left_semi")
    return asked.join(reports.named_boundary(feeds), F.col("provider") == F.col("root")).select("component", "provider", F.col("node").alias("datasource"), "total")


@query(_HOPS + "\nSELECT 'edge:' || kind AS measure, count(*) AS value FROM (SELECT DISTINCT src, dst, kind FROM hops) GROUP BY kind", _HOP_VIEWS)
def a24_edges_by_kind(spark, d):
    return graph.edge_kinds(_hops(spark, d))


_TYPED = "CASE {0} % 12 WHEN 0 THEN 'RSDS' WHEN 1 THEN 'odso' WHEN 2 THEN ' HCPR ' WHEN 3 THEN 'Cube' WHEN 4 THEN 'calculationview' WHEN 5 THEN 'ELEM' WHEN 6 THEN 'DTP' WHEN 7 THEN 'Process_Chain' WHEN 8 THEN 'what' WHEN 9 THEN NULL WHEN 10 THEN 'rspc' ELSE 'multiProvider' END"


@query(f"""
WITH typed AS (SELECT p_partkey AS id, p_name AS name, {_TYPED.format("p_partkey")} AS code FROM part), known AS (SELECT unnest(['rsds', 'odso', 'hcpr', 'cube', 'calculationview', 'elem', 'dtp', 'process_chain', 'rspc', 'multiprovider']) AS k, unnest(['datasource', 'dso', 'compositeprovider', 'infocube', 'calcview', 'query_element', 'dtp', 'chain', 'chain', 'multiprovider']) AS t)
SELECT id, coalesce(t, 'unknown') AS type, coalesce(t, 'unknown') || ':' || upper(trim(name)) AS object_id FROM typed LEFT JOIN known ON k = lower(trim(code))""")
def x8_object_ids(spark, d):
    typed = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", f"{_TYPED.format('p_partkey')} AS code")
    return typed.select("id", decode.object_type(F.col("code")).alias("type"), decode.object_id(F.col("code"), F.col("name")).alias("object_id"))


@query("\nSELECT tranid, version, src FROM transformation_header WHERE version IN ('A', 'M') AND src_type = 'ODSO'", ("transformation_header",))
def s2_all_versions(spark, d):
    held = Landscape({"transformation": view(spark, d, "transformation_header").withColumnRenamed("version", "OBJVERS")})
    return held.scan("transformation", "objvers IN ('A', 'M')", "src_type = 'ODSO'", columns=["tranid", "OBJVERS", "src"]).withColumnRenamed("OBJVERS", "version")


_MENTIONS = _REFS + """,
code AS (SELECT 'R' || CAST(user_id AS VARCHAR) AS codeid, CASE event_id % 3 WHEN 0 THEN 'select x from n' || CAST(event_id % 4096 AS VARCHAR) || ' into y.' WHEN 1 THEN '* N' || CAST(event_id % 512 AS VARCHAR) || '-k = N' || CAST(user_id AS VARCHAR) || '.' ELSE 'xN1 = N1x.' END AS line FROM events),
ends AS (SELECT o_orderkey AS tranid, 'N' || CAST(CAST(floor(o_orderkey / 16) AS BIGINT) * 16 + o_custkey % 16 AS VARCHAR) AS dst, 'N' || CAST(o_orderkey AS VARCHAR) AS src FROM orders),
words AS (SELECT DISTINCT codeid, unnest(regexp_extract_all(upper(line), '[A-Z0-9_/]+')) AS name FROM code), said AS (SELECT * FROM words WHERE name IN (SELECT src FROM ends)),
consumers AS (SELECT name, dst AS consumer, count(DISTINCT e.tranid) AS transformations FROM said JOIN refs USING (codeid) JOIN ends e ON e.tranid = refs.tranid WHERE dst <> name GROUP BY 1, 2)"""


def _consumers(spark, d):
    lines = table(spark, d, "events").selectExpr("concat('R', user_id) AS codeid", "CASE event_id % 3 WHEN 0 THEN concat('select x from n', event_id % 4096, ' into y.') WHEN 1 THEN concat('* N', event_id % 512, '-k = N', user_id, '.') ELSE 'xN1 = N1x.' END AS line")
    headers = table(spark, d, "orders").selectExpr("o_orderkey AS tranid", "concat('N', floor(o_orderkey / 16) * 16 + o_custkey % 16) AS dst", "concat('N', o_orderkey) AS name")
    return routines.code_consumers(routines.mentions(lines, headers.select("name")), _refs(spark, d), headers)


@query(_MENTIONS + "\nSELECT name, consumer, transformations FROM consumers", ("routine_headers", "routine_steps"))
def g9_code_consumers(spark, d):
    return _consumers(spark, d)


@query(_MENTIONS + """,
edges AS (SELECT DISTINCT src, dst FROM transformation), walk AS (SELECT src AS root, dst AS node, 1 AS hops FROM edges UNION SELECT w.root, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE w.hops < 3), hit AS (SELECT root, node, min(hops) AS hops FROM walk WHERE root <> node GROUP BY 1, 2)
SELECT coalesce(root, name) AS root, coalesce(node, consumer) AS affected, hops, name IS NOT NULL AS by_code FROM hit FULL JOIN consumers ON name = root AND consumer = node""", ("routine_headers", "routine_steps", "transformation"), recursive=True)
def g9_impact(spark, d):
    return routines.impact_with_code(graph.reachability(graph.edges_of(view(spark, d, "transformation")), 3), _consumers(spark, d))


@query("""
, ends AS (SELECT o_orderkey AS tranid, 'N' || CAST(o_orderkey AS VARCHAR) AS source, 'N' || CAST(o_custkey AS VARCHAR) AS target FROM orders),
flags AS (SELECT CAST(tranid AS VARCHAR) AS name, source, target, CASE WHEN trim(coalesce(startroutine, '')) <> '' THEN 'True' ELSE 'False' END AS has_start_routine, CASE WHEN trim(coalesce(endroutine, '')) <> '' THEN 'True' ELSE 'False' END AS has_end_routine, CASE WHEN trim(coalesce(expert, '')) <> '' THEN 'True' ELSE 'False' END AS has_expert_routine,
  CASE WHEN trim(coalesce(glbcode, '')) <> '' OR trim(coalesce(glbcode2, '')) <> '' THEN 'True' ELSE 'False' END AS has_global_routine FROM routine_headers JOIN ends USING (tranid))
SELECT 'transformation' AS family, name, source, target, has_start_routine, has_end_routine, has_expert_routine, has_global_routine, FALSE AS capped,
  substr(sha256(concat_ws(chr(31), 'has_end_routine=' || has_end_routine, 'has_expert_routine=' || has_expert_routine, 'has_global_routine=' || has_global_routine, 'has_start_routine=' || has_start_routine, 'source=' || source, 'target=' || target)), 1, 16) AS fingerprint FROM flags""", ("routine_headers",))
def z41_transformation_snapshot(spark, d):
    ends = table(spark, d, "orders").selectExpr("o_orderkey AS tranid", "concat('N', o_orderkey) AS src", "concat('N', o_custkey) AS dst")
    facts = routines.transformation_facts(view(spark, d, "routine_headers").join(ends, "tranid"))
    return diff.captured(facts, [c for c in facts.columns if c not in ("family", "name")], None)
