"""Queries of the composed analyses and of the smaller reads, over all rows of the views and tables they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import analysis, diff, governance, graph, models, runs, search
from cairn.plans.base import near, query, table
from cairn.plans.graph_queries import _EDGES, _REACH, VIOLATIONS
from cairn.plans.views import view
from cairn.sources.registry import Landscape

_WINDOWS = """,
windows AS (SELECT chain_id, log_id, min(start_us) AS start_us, max(end_us) AS end_us FROM process_log WHERE start_us IS NOT NULL AND end_us IS NOT NULL GROUP BY chain_id, log_id)"""
_CHAINS = _WINDOWS + """,
rates AS (SELECT chain_id, avg(CASE WHEN status = 'G' THEN 1.0 ELSE 0.0 END) AS r FROM log_chain GROUP BY chain_id),
spread AS (SELECT chain_id, count(*) AS n, median(d) AS m, quantile_cont(d, 0.95) AS p FROM (SELECT chain_id, (end_us - start_us) / 1000000.0 AS d FROM windows) GROUP BY chain_id),
busy_chains AS (SELECT DISTINCT chain_id FROM (SELECT *, max(end_us) OVER (PARTITION BY chain_id ORDER BY start_us, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy FROM windows) WHERE start_us < busy),
chain_findings AS (SELECT 'success_rate' AS scenario, chain_id AS object, CASE WHEN r < 0.8 THEN 'critical' ELSE 'high' END AS severity FROM rates WHERE r < 0.95
UNION ALL SELECT 'duration_spread', chain_id, 'medium' FROM spread WHERE n > 1 AND m > 0 AND p > 3 * m UNION ALL SELECT 'self_overlap', chain_id, 'high' FROM busy_chains
UNION ALL SELECT 'contention', a.chain_id, 'medium' FROM windows a WHERE EXISTS (SELECT 1 FROM windows b WHERE b.start_us >= a.start_us AND b.start_us < a.end_us AND b.chain_id <> a.chain_id) GROUP BY a.chain_id)"""


def _chains(spark, d):
    return analysis.chain_findings(view(spark, d, "log_chain"), view(spark, d, "process_log"))


@query(_CHAINS + "\nSELECT scenario, object, severity FROM chain_findings", ("log_chain", "process_log"))
def c14_chain_findings(spark, d):
    return _chains(spark, d)


@query(_CHAINS + "\nSELECT scenario, object, severity FROM chain_findings ORDER BY list_position(['critical', 'high', 'medium', 'low', 'info'], severity), scenario, object LIMIT 10", ("log_chain", "process_log"))
def o5_top_findings(spark, d):
    return analysis.most_severe(_chains(spark, d))


@query("""
, own AS (SELECT tranid, dst AS target FROM transformation_header WHERE (startroutine <> '' OR endroutine <> '' OR expert <> '') AND dst_type IN ('ADSO', 'ODSO') AND dst IN (SELECT tgt FROM dtp WHERE updmode = 'F')),
found AS (SELECT own.tranid, target, count(*) AS lookups, count(*) FILTER (WHERE a.rate > 0 AND b.rate > 0 AND a.rate < b.rate) AS stale FROM own JOIN lookups l ON l.tranid = own.tranid AND l.object <> own.target LEFT JOIN rates a ON a.object = l.object LEFT JOIN rates b ON b.object = target GROUP BY own.tranid, target)
SELECT tranid, target, lookups, stale, CASE WHEN stale > 0 OR lookups >= 3 THEN 'high' ELSE 'medium' END AS severity FROM found""", ("transformation_header", "dtp", "lookups", "rates"))
def c1_load_latency(spark, d):
    full = view(spark, d, "dtp").where("updmode = 'F'").select(F.col("tgt").alias("target"))
    return analysis.load_latency(view(spark, d, "transformation_header"), full, view(spark, d, "lookups"), view(spark, d, "rates"))


@query("""
, clashes AS (SELECT tgt AS target, count(*) AS n FROM (SELECT tgt, dtp % 3 AS field FROM dtp GROUP BY 1, 2 HAVING count(DISTINCT src) > 1) GROUP BY 1)
SELECT tgt AS target, count(DISTINCT src) AS sources, coalesce(max(n), 0) AS collisions, CASE WHEN coalesce(max(n), 0) > 0 THEN 'high' ELSE 'medium' END AS severity FROM dtp LEFT JOIN clashes ON target = tgt GROUP BY tgt HAVING count(DISTINCT src) >= 2""", ("dtp",))
def c5_merged_streams(spark, d):
    loads = view(spark, d, "dtp")
    streams = loads.select(F.col("tgt").alias("target"), (F.col("dtp") % 3).alias("field"), F.col("src").alias("stream"))
    return analysis.merged_stream_findings(loads.select("src", F.col("tgt").alias("dst")), streams)


@query("""
, c AS (SELECT src AS "view", string_agg(DISTINCT dst, ',' ORDER BY dst) AS s FROM transformation WHERE dst_type = 'HCPR' GROUP BY 1)
SELECT c_custkey AS dashboard, 'N' || CAST(c_custkey AS VARCHAR) AS "view", coalesce(s, '') AS shared_with, CASE WHEN s IS NULL THEN 'medium' ELSE 'high' END AS severity FROM customer LEFT JOIN c ON "view" = 'N' || CAST(c_custkey AS VARCHAR)""", ("transformation",))
def c8_dashboard_bypasses(spark, d):
    boards = table(spark, d, "customer").select(F.col("c_custkey").alias("dashboard"), F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("view"))
    return analysis.dashboard_bypasses(boards, view(spark, d, "transformation").where("dst_type = 'HCPR'").select(F.col("src").alias("view"), F.col("dst").alias("provider")))


_STATUS = {"composite_to_store": "assessed", "composite_to_characteristic": "assessed", "self_loop": "assessed", "cycle": "assessed", "success_rate": "assessed", "self_overlap": "assessed", "contention": "not_assessed", "dashboards": "unsupported"}


@query(_EDGES + _REACH + VIOLATIONS + _CHAINS + f""",
scenarios AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _STATUS.items())}) v(scenario, status)), every AS (SELECT * FROM violations UNION ALL SELECT * FROM chain_findings),
per AS (SELECT scenario, count(*) AS n, arg_min(severity, list_position(['critical', 'high', 'medium', 'low', 'info'], severity)) AS worst FROM every GROUP BY 1),
s AS (SELECT greatest(0.0, 100.0 - coalesce(sum(CASE severity WHEN 'critical' THEN 12 WHEN 'high' THEN 6 WHEN 'medium' THEN 2 WHEN 'low' THEN 0.5 ELSE 0 END), 0)) AS score FROM every JOIN scenarios USING (scenario) WHERE status = 'assessed')
SELECT scenario, status, CASE WHEN status = 'assessed' THEN coalesce(n, 0) END AS findings, worst, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS grade
FROM scenarios LEFT JOIN per USING (scenario), s""", ("transformation", "log_chain", "process_log"), recursive=True)
def c11_assessment(spark, d):
    scenarios = spark.createDataFrame(list(_STATUS.items()), "scenario string, status string")
    return analysis.assessment(scenarios, graph.layer_violations(view(spark, d, "transformation")).unionByName(_chains(spark, d)))


@query(_EDGES + """,
walk AS (SELECT src AS root, dst AS node, 1 AS hops FROM edges UNION SELECT w.root, e.dst, w.hops + 1 FROM walk w JOIN edges e ON w.node = e.src WHERE w.hops < 2)
SELECT root AS object, 'feeds' AS relationship, count(DISTINCT node) AS affected, 'high' AS severity FROM walk WHERE node <> root GROUP BY root
UNION ALL SELECT object, 'looked_up', count(DISTINCT tranid), 'high' FROM lookups GROUP BY object UNION ALL SELECT 'N' || CAST(l_partkey AS VARCHAR), 'queried', count(*), 'medium' FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1""", ("transformation", "lookups"), recursive=True)
def c15_change_impact(spark, d):
    typed = view(spark, d, "transformation")
    kinds = typed.select(F.col("src").alias("node"), F.col("src_type").alias("kind")).distinct()
    asked = table(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("object"))
    return analysis.change_impact(graph.impact(graph.edges_of(typed), kinds, 2), view(spark, d, "lookups"), asked)


@query("""
, t AS (SELECT max(started) AS today FROM requests), ages AS (SELECT provider, date_diff('day', max(started), max(today)) AS age_days FROM requests, t GROUP BY provider)
SELECT CAST(floor(provider / 8) AS BIGINT) AS object, count(*) AS parts, max(age_days) - min(age_days) AS spread_days, CASE WHEN max(age_days) > 365 THEN 'high' ELSE 'medium' END AS severity FROM ages GROUP BY 1 HAVING max(age_days) - min(age_days) >= 30""", ("requests",))
def c16_currency_spread(spark, d):
    ages = governance.provider_health(view(spark, d, "requests")).select(F.floor(F.col("provider") / 8).alias("object"), "age_days")
    return analysis.currency_spread(ages)


@query("""
SELECT object, relationship, advisory, note FROM (SELECT l_partkey AS object, l_returnflag AS relationship, l_linenumber % 2 = 1 AS advisory, l_shipmode_ AS note FROM (SELECT *, l_linestatus || CAST(l_linenumber AS VARCHAR) AS l_shipmode_ FROM lineitem))
QUALIFY row_number() OVER (PARTITION BY object, relationship ORDER BY advisory, note) = 1""")
def u6_declared_first(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("relationship"), (F.col("l_linenumber") % 2 == 1).alias("advisory"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("note"))
    return analysis.declared_first(items)


@query("""
SELECT step_type, variant, count(*) AS occurrences, round(max(end_us - start_us) / 1000000.0 + 1e-9, 3) AS longest_s, round(min(end_us - start_us) / 1000000.0 + 1e-9, 3) AS shortest_s, min(log_id) AS sample_log, arg_min(state, (log_id, start_us, state)) AS first_state
FROM process_log WHERE state IN ('R', 'J', 'X') GROUP BY step_type, variant""", ("process_log",))
def a9_failed_steps(spark, d):
    return runs.failed_steps(view(spark, d, "process_log")).withColumn("longest_s", near("longest_s")).withColumn("shortest_s", near("shortest_s"))


@query("\nSELECT step_type, variant, count(*) AS occurrences FROM process_log WHERE state IN ('R', 'J', 'X') GROUP BY step_type, variant ORDER BY occurrences DESC, max(end_us - start_us) DESC NULLS LAST, step_type, variant LIMIT 5", ("process_log",))
def a9_top_failed_steps(spark, d):
    return runs.top_failed_steps(view(spark, d, "process_log")).select("step_type", "variant", "occurrences")


@query("""
SELECT chain_id, log_id, step_type, variant, start_us, round((end_us - start_us) / 1000000.0 + 1e-9, 3) AS seconds, place FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY end_us - start_us DESC, start_us, step_type, variant) AS place FROM process_log WHERE start_us IS NOT NULL AND end_us IS NOT NULL) WHERE place <= 5""", ("process_log",))
def o3_longest_steps(spark, d):
    return runs.longest_steps(view(spark, d, "process_log")).withColumn("seconds", near("seconds"))


@query("\nSELECT chain_id, count(*) AS runs, min(run_day) AS first_day, max(run_day) AS last_day FROM log_chain WHERE date_diff('day', run_day, (SELECT max(run_day) FROM log_chain)) < 14 GROUP BY chain_id", ("log_chain",))
def a3_recent_runs(spark, d):
    return runs.recent_runs(view(spark, d, "log_chain"), 14)


@query(_WINDOWS + """
SELECT chain_id, count(DISTINCT log_id) AS runs, count(*) AS steps FROM (SELECT chain_id, log_id FROM windows QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY start_us DESC, log_id) <= 1000) JOIN process_log USING (chain_id, log_id) GROUP BY chain_id""", ("process_log",))
def j4_run_steps(spark, d):
    steps = view(spark, d, "process_log")
    return runs.newest_run_steps(runs.run_windows(steps), steps)


_CADENCE = """,
gaps AS (SELECT chain_id, median(gap) AS g FROM (SELECT chain_id, date_diff('day', lag(run_day) OVER (PARTITION BY chain_id ORDER BY run_day), run_day) AS gap FROM (SELECT DISTINCT chain_id, run_day FROM log_chain)) GROUP BY 1),
base AS (SELECT chain_id, count(DISTINCT log_id) AS runs, count(DISTINCT run_day) AS days FROM log_chain GROUP BY 1),
cad AS (SELECT chain_id, runs, CASE WHEN days <= 1 THEN 'unknown' WHEN g <= 1.5 THEN CASE WHEN runs / days >= 18 THEN 'hourly' WHEN runs / days >= 1.5 THEN 'multiple_daily' ELSE 'daily' END WHEN g <= 4 THEN 'irregular' WHEN g <= 10 THEN 'weekly' WHEN g <= 24 THEN 'irregular' WHEN g <= 180 THEN 'monthly' ELSE 'irregular' END AS cadence FROM base LEFT JOIN gaps USING (chain_id))"""


@query(_CADENCE + "\nSELECT CAST(c_custkey AS VARCHAR) AS chain_id, c_mktsegment AS text, coalesce(cadence, 'unknown') AS cadence, coalesce(runs, 0) AS runs FROM customer LEFT JOIN cad ON cad.chain_id = CAST(c_custkey AS VARCHAR)", ("log_chain",))
def j3_chain_list(spark, d):
    chains = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("chain_id"), F.col("c_mktsegment").alias("text"))
    return runs.chain_list(chains, view(spark, d, "log_chain"))


@query(_WINDOWS + """,
done AS (SELECT DISTINCT l.chain_id FROM log_chain l JOIN windows w ON w.chain_id = l.chain_id)
SELECT count(*) AS reports, count(*) FILTER (WHERE d.chain_id IS NULL) AS unmatched FROM reports r LEFT JOIN done d ON d.chain_id = r.chain_id""", ("log_chain", "process_log", "reports"))
def j15_unjudged_reports(spark, d):
    return runs.unjudged_reports(view(spark, d, "reports"), runs.schedule_matrix(view(spark, d, "log_chain"), view(spark, d, "process_log")))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS chain, chain_minutes, report_minutes, CAST((report_minutes - chain_minutes + 1440) % 1440 AS BIGINT) AS wait FROM (SELECT c_custkey, (c_custkey * 53) % 1440 AS chain_minutes, (c_custkey * 37) % 1440 AS report_minutes FROM customer)""")
def x6_wrapped_minutes(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("chain"), (F.col("c_custkey") * 53 % 1440).alias("chain_minutes"), (F.col("c_custkey") * 37 % 1440).alias("report_minutes"))
    return own.withColumn("wait", decode.wrapped_minutes(F.col("chain_minutes"), F.col("report_minutes")).cast("long"))


@query("""
WITH v AS (SELECT DISTINCT l_returnflag AS domain, l_linenumber AS position, l_returnflag || CAST(l_linenumber AS VARCHAR) AS value FROM lineitem), t AS (SELECT DISTINCT l_returnflag AS domain, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'E' ELSE 'D' END AS langu, 'text ' || l_returnflag AS text FROM lineitem WHERE l_linenumber < 6)
SELECT v.domain, v.position, value, text FROM v LEFT JOIN t ON t.domain = v.domain AND t.position = v.position AND langu = 'E'""")
def j1_domain_texts(spark, d):
    items = table(spark, d, "lineitem")
    values = items.select(F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("value")).distinct()
    texts = items.where("l_linenumber < 6").select(F.col("l_returnflag").alias("domain"), F.col("l_linenumber").alias("position"), F.when(F.col("l_linenumber") % 2 == 0, "E").otherwise("D").alias("langu"), F.concat(F.lit("text "), "l_returnflag").alias("text")).distinct()
    return governance.domain_texts(values, texts, "E")


_STATUSES = """CASE WHEN ledger = 'classic' THEN CASE code WHEN '@08@' THEN 'success' WHEN '@09@' THEN 'incomplete' WHEN '@0A@' THEN 'error' ELSE 'unknown' END
WHEN code IN ('GG', 'YG', 'Y') THEN 'success' WHEN code IN ('GR', 'U', 'N') THEN 'incomplete' WHEN code IN ('RG', 'RR', 'YR') THEN 'error' WHEN code IN ('', 'D', 'M', 'X') THEN 'housekeeping' ELSE 'unknown' END"""


@query(f"\nSELECT provider, {_STATUSES} AS status, count(*) AS requests FROM request_codes GROUP BY 1, 2", ("request_codes",))
def x18_request_statuses(spark, d):
    return governance.request_statuses(view(spark, d, "request_codes"))


@query("\nSELECT name, CASE WHEN aggrexc <> '' THEN CASE aggrexc " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in decode.EXCEPTIONS.items()) + """ ELSE '(undocumented)' END END AS exception,
CASE ncumfl WHEN '1' THEN 'stock_with_change' WHEN '2' THEN 'stock_with_movements' ELSE 'cumulative' END AS stock, aggrexc IN ('', 'SUM') AND ncumfl = '' AND aggrgen NOT IN ('MIN', 'MAX') AS summable FROM keyfigures""", ("keyfigures",))
def x14_key_figures(spark, d):
    return governance.key_figures(view(spark, d, "keyfigures"))


@query("""
WITH s AS (SELECT l_partkey AS element, CASE l_linenumber % 3 WHEN 0 THEN 'SUM' WHEN 1 THEN 'LAS' ELSE 'LAS' END AS exception FROM lineitem WHERE l_returnflag = 'R')
SELECT element, count(*) AS steps, CASE WHEN count(DISTINCT exception) > 1 THEN 'mixed' ELSE min(exception) END AS exception FROM s GROUP BY element""")
def z13_mixed_exceptions(spark, d):
    steps = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("element"), F.when(F.col("l_linenumber") % 3 == 0, "SUM").otherwise("LAS").alias("exception"))
    return governance.mixed_exceptions(steps)


_RULES = "rules AS (SELECT l_orderkey AS structure, CASE WHEN l_returnflag = 'R' THEN 'X' ELSE '' END AS routine, CASE WHEN l_linestatus = 'F' THEN 'F1' END AS formula, CASE WHEN l_linenumber % 3 = 0 THEN 'K' ELSE '' END AS constant FROM lineitem)"


def _rules(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("structure"), F.when(F.col("l_returnflag") == "R", "X").otherwise("").alias("routine"), F.when(F.col("l_linestatus") == "F", "F1").alias("formula"), F.when(F.col("l_linenumber") % 3 == 0, "K").otherwise("").alias("constant"))


_PROFILE = f"WITH {_RULES},\nprofile AS (SELECT structure, count(*) AS rules, count(*) FILTER (WHERE routine <> '') AS with_routine, count(*) FILTER (WHERE formula <> '') AS with_formula, count(*) FILTER (WHERE constant <> '') AS with_constant FROM rules GROUP BY 1)"


@query(_PROFILE + "\nSELECT * FROM profile")
def a11_rule_profile(spark, d):
    return governance.rule_profile(_rules(spark, d))


@query(f"WITH {_RULES}\nSELECT structure, CASE WHEN constant <> '' THEN 'constant' WHEN routine <> '' THEN 'routine' WHEN formula <> '' THEN 'formula' ELSE 'direct' END AS mechanism, count(*) AS rules FROM rules GROUP BY 1, 2")
def z20_rule_mechanisms(spark, d):
    return governance.rule_mechanisms(_rules(spark, d))


@query(_PROFILE + """,
src AS (SELECT DISTINCT o_custkey AS datasource, o_orderkey AS structure, o_custkey % 50 AS infosource FROM orders), updates AS (SELECT infosource, string_agg(t, ',' ORDER BY t) AS targets FROM (SELECT DISTINCT s_suppkey % 50 AS infosource, s_name AS t FROM supplier) GROUP BY 1)
SELECT datasource, structure, infosource, rules, with_routine, with_formula, with_constant, structure IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS has_start_routine, datasource IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS has_transformation, coalesce(targets, '') AS targets
FROM src JOIN profile USING (structure) LEFT JOIN updates USING (infosource)""")
def j19_older_flows(spark, d):
    orders, suppliers = table(spark, d, "orders"), table(spark, d, "supplier")
    sources = orders.select(F.col("o_custkey").alias("datasource"), F.col("o_orderkey").alias("structure"), (F.col("o_custkey") % 50).alias("infosource"))
    modern = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("datasource"))
    updates = suppliers.select((F.col("s_suppkey") % 50).alias("infosource"), F.col("s_name").alias("target"))
    return governance.older_flows(sources, _rules(spark, d), orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("structure")), modern, updates)


@query("\nSELECT auth, kind, count(*) AS ranges, coalesce(max(n), 0) AS users FROM (SELECT auth, CASE WHEN low = '*' THEN 'all' WHEN low = ':' THEN 'aggregated' WHEN low = '#' THEN 'unassigned' WHEN starts_with(low, '$') THEN 'variable' ELSE 'value' END AS kind FROM auth_values) LEFT JOIN (SELECT auth, count(DISTINCT uname) AS n FROM auth_user GROUP BY 1) USING (auth) GROUP BY 1, 2", ("auth_values", "auth_user"))
def z21_auth_details(spark, d):
    return governance.auth_details(view(spark, d, "auth_values"), view(spark, d, "auth_user"))


_CAPTURE = """,
rows_ AS (SELECT o_orderpriority AS family, o_custkey AS name, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'C' || CAST(o_orderkey % 5 AS VARCHAR) END AS code FROM orders),
merged AS (SELECT family, name, coalesce(string_agg(DISTINCT status, ',' ORDER BY status) FILTER (WHERE trim(status) <> ''), '') AS status, coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (WHERE trim(code) <> ''), '') AS code FROM rows_ GROUP BY 1, 2)"""


@query("WITH " + _CAPTURE.lstrip(",\n") + """
SELECT family, name, status, code, substr(sha256('code=' || code || chr(31) || 'status=' || status), 1, 16) AS fingerprint, count(*) OVER (PARTITION BY family) > 500 AS capped FROM merged QUALIFY row_number() OVER (PARTITION BY family ORDER BY name) <= 500""")
def c21_snapshot_capture(spark, d):
    code = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("o_orderkey") % 5).cast("string")))
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("status"), code.alias("code"))
    return diff.captured(rows, ["status", "code"], 500)


@query("""
WITH l AS (SELECT DISTINCT p_brand AS family FROM part WHERE p_size > 25), r AS (SELECT DISTINCT p_brand AS family FROM part WHERE p_partkey % 3 = 0)
SELECT family, l.family IS NOT NULL AND r.family IS NOT NULL AS comparable FROM l FULL JOIN r USING (family)""")
def u5_comparable_families(spark, d):
    part = table(spark, d, "part").withColumn("family", F.col("p_brand"))
    return diff.comparable_families(part.where("p_size > 25"), part.where("p_partkey % 3 = 0"))


@query("SELECT family FROM (SELECT p_brand AS family FROM part WHERE p_size > 25 INTERSECT SELECT p_brand FROM part WHERE p_partkey % 3 = 0)")
def u4_shared_families(spark, d):
    part = table(spark, d, "part").withColumn("family", F.col("p_brand"))
    return diff.comparable_families(part.where("p_size > 25"), part.where("p_partkey % 3 = 0")).where("comparable").select("family")


@query("\nSELECT tranid, src, dst FROM transformation_header WHERE startroutine <> '' OR endroutine <> '' OR expert <> ''", ("transformation_header",))
def f9_any_routine(spark, d):
    return view(spark, d, "transformation_header").where("startroutine <> '' OR endroutine <> '' OR expert <> ''").select("tranid", "src", "dst")


@query("\nSELECT tranid, src, dst FROM transformation_header WHERE version = 'A'", ("transformation_header",))
def s2_active_version(spark, d):
    held = Landscape({"transformation": view(spark, d, "transformation_header").withColumnRenamed("version", "OBJVERS")})
    return held.active("transformation").select("tranid", "src", "dst")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'promo') OR starts_with(p_name, 'b')")
def f4_prefixes(spark, d):
    return table(spark, d, "part").where(F.col("p_name").startswith("promo") | F.col("p_name").startswith("b")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f5_listed_chains(spark, d):
    listed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(listed, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("\nSELECT chain_id, log_id FROM log_chain WHERE chain_id NOT LIKE '%7' AND status <> 'R' AND run_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", ("log_chain",))
def f6_ranges(spark, d):
    return view(spark, d, "log_chain").where(~F.col("chain_id").like("%7") & (F.col("status") != "R") & F.col("run_day").between("2024-01-05", "2024-01-20")).select("chain_id", "log_id")


@query("\nSELECT object, count(*) AS views FROM lookups WHERE object IN (SELECT dst FROM transformation_header WHERE dst_type = 'IOBJ') GROUP BY object", ("lookups", "transformation_header"))
def f8_consuming_views(spark, d):
    tables = view(spark, d, "transformation_header").where("dst_type = 'IOBJ'").select(F.col("dst").alias("object"))
    return view(spark, d, "lookups").join(tables, "object", "left_semi").groupBy("object").agg(F.count("*").alias("views"))


@query("SELECT CASE WHEN starts_with(name, '!!') THEN 'ad_hoc' ELSE 'designed' END AS origin, count(*) AS names FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN '!!' ELSE '' END || p_name AS name FROM part) GROUP BY 1")
def f11_origins(spark, d):
    return search.origins(table(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 4 == 0, "!!").otherwise(""), "p_name").alias("name")))


@query("WITH t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term FROM part), n AS (SELECT DISTINCT p_name AS name FROM part) SELECT term, arg_min(name, (len(name), name)) AS name FROM t LEFT JOIN n ON starts_with(name, term) GROUP BY term")
def o6_shortest_matches(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return search.shortest_matches(names.select(F.split("name", " ").getItem(0).alias("term")).distinct(), names)


@query("""
WITH f AS (SELECT l_suppkey AS source, CASE l_linenumber % 4 WHEN 0 THEN 'Z' WHEN 1 THEN 'Y' WHEN 2 THEN '/BIC/' ELSE '0' END || CAST(l_partkey % 50 AS VARCHAR) AS field FROM lineitem)
SELECT source, count(DISTINCT field) AS customer_fields, CASE WHEN count(DISTINCT field) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM f WHERE regexp_matches(field, '^(Z|Y|/BIC/)') GROUP BY source ORDER BY customer_fields DESC, source LIMIT 50""")
def a21_enhancement_ranking(spark, d):
    prefix = F.element_at(F.array(F.lit("Z"), F.lit("Y"), F.lit("/BIC/"), F.lit("0")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return search.enhancement_ranking(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(prefix, (F.col("l_partkey") % 50).cast("string")).alias("field")), 50)


@query("SELECT l_orderkey AS routine, count(DISTINCT l_suppkey % 7) AS packages, count(DISTINCT l_partkey) AS tables, count(DISTINCT l_suppkey % 7) >= 3 AS spans FROM lineitem GROUP BY 1")
def t8_owned_tables(spark, d):
    return search.owned_tables(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("routine"), F.col("l_partkey").alias("table_name"), (F.col("l_suppkey") % 7).alias("package")))


@query(r"""
WITH t AS (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' on srv-1.example.com:8000 failed' WHEN 1 THEN ' at 10.0.0.7 now' WHEN 2 THEN ' all fine' ELSE ' a.b' END AS text FROM supplier)
SELECT s_suppkey, regexp_replace(text, '\b(?:\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)(?::\d+)?\b', '(host)', 'g') AS text FROM t""")
def t9_scrubbed_hosts(spark, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in (" on srv-1.example.com:8000 failed", " at 10.0.0.7 now", " all fine", " a.b")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", decode.without_hosts(F.concat("s_name", tail)).alias("text"))


@query("""
, q AS (SELECT *, CASE WHEN coalesce(trim(text), '') = '' THEN 'missing' WHEN starts_with(lower(text), 'copy of') THEN 'copy_artifact' WHEN upper(text) = upper(name) OR len(regexp_split_to_array(trim(text), '\\s+')) < 4 THEN 'generic' ELSE 'ok' END AS quality FROM (SELECT name, object_type, CASE WHEN name LIKE '%3' THEN '' WHEN name LIKE '%4' THEN text || ' made in the north' ELSE text END AS text FROM objects))
SELECT name, CASE quality WHEN 'ok' THEN text WHEN 'missing' THEN lower(object_type) || ' ' || name ELSE text || ' (' || lower(object_type) || ')' END AS description, CASE quality WHEN 'ok' THEN 'stored' WHEN 'missing' THEN 'generated' ELSE 'stored_augmented' END AS origin FROM q""", ("objects",))
def x13_descriptions(spark, d):
    text = F.when(F.col("name").endswith("3"), "").when(F.col("name").endswith("4"), F.concat("text", F.lit(" made in the north"))).otherwise(F.col("text"))
    return search.descriptions(view(spark, d, "objects").select("name", "object_type", text.alias("text")))


@query("""
, t AS (SELECT name, kind, CASE WHEN starts_with(name, '0') THEN '/BI0/' ELSE '/BIC/' END AS ns, CASE WHEN starts_with(name, '0') THEN substr(name, 2) ELSE name END AS local FROM providers),
e AS (SELECT name, kind, unnest(CASE kind WHEN 'adso' THEN [ns || 'A' || local || '1', ns || 'A' || local || '2', ns || 'A' || local || '3'] WHEN 'dso' THEN [ns || 'A' || local || '00', ns || 'A' || local || '40'] ELSE [ns || 'P' || local] END) AS table_name FROM t)
SELECT name, kind, table_name FROM e""", ("providers",))
def x9_generated_tables(spark, d):
    return view(spark, d, "providers").select("name", "kind", F.explode(decode.generated_tables(F.col("name"), F.col("kind"))).alias("table_name"))


@query("\n, c AS (SELECT kind, name FROM providers UNION SELECT 'composite', dst FROM transformation_header WHERE dst_type = 'HCPR') SELECT kind, name FROM c WHERE name <> ''", ("providers", "transformation_header"))
def z8_provider_catalogue(spark, d):
    known, header = view(spark, d, "providers"), view(spark, d, "transformation_header")
    of = lambda kind: (kind, known.where(F.col("kind") == kind).select("name"))
    return governance.provider_catalogue(of("dso"), of("adso"), of("infoobject"), ("composite", header.where("dst_type = 'HCPR'").select(F.col("dst").alias("name"))))


@query("\nSELECT object, count(DISTINCT tranid) AS transformations, min(tranid) AS first_tranid FROM lookups GROUP BY object", ("lookups",))
def z16_reverse_lookups(spark, d):
    return view(spark, d, "lookups").groupBy("object").agg(F.countDistinct("tranid").alias("transformations"), F.min("tranid").alias("first_tranid"))


def _models(spark, d):
    """A model a part: a join of two sources, and a projection of it with a filter."""
    part = table(spark, d, "part").select(F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("string").alias("s"), (F.col("p_partkey") % 7).cast("string").alias("k"))
    head = '<Calculation:scenario xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:Calculation="http://calculation"><dataSources><DataSource id="T'
    join = '"/></dataSources><calculationViews><calculationView id="J" xsi:type="Calculation:JoinView"><input x="a>b" node="#T'
    xml = F.concat(
        F.lit(head), "s", F.lit('"/><DataSource type="t" id="U'), "k", F.lit(join), "s", F.lit('"><mapping target="A" source="F'), "k", F.lit('"/><mapping source="G" target="B"/></input><input node="#U'), "k",
        F.lit('"/><joinAttribute name="A"/></calculationView><calculationView xsi:type="Calculation:ProjectionView" id="P" filterExpression="B &gt; '), "k", F.lit('"><input node="#J"/></calculationView></calculationViews></Calculation:scenario>'),
    )
    return part.select("name", xml.alias("xml"))


@query("""
SELECT 'V' || p_partkey AS name, 'J' AS node, 'JoinView' AS kind, 'T' || p_size || ',U' || p_partkey % 7 AS inputs, 'A' AS joins, '' AS filter FROM part UNION ALL SELECT 'V' || p_partkey, 'P', 'ProjectionView', 'J', '', 'B > ' || p_partkey % 7 FROM part""")
def c26_view_logic(spark, d):
    return models.view_nodes(_models(spark, d))


@query("SELECT 'V' || p_partkey AS name, 'J' AS node, 'T' || p_size AS input, 'A' AS target, 'F' || p_partkey % 7 AS source FROM part UNION ALL SELECT 'V' || p_partkey, 'J', 'T' || p_size, 'B', 'G' FROM part")
def z10_view_mappings(spark, d):
    return models.view_mappings(_models(spark, d))


@query("SELECT 'V' || p_partkey AS name, 'T' || p_size AS source FROM part UNION ALL SELECT 'V' || p_partkey, 'U' || p_partkey % 7 FROM part")
def s8_view_sources(spark, d):
    return models.view_sources(_models(spark, d))
