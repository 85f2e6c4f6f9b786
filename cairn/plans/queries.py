"""One query per operator over the derived views, each with the SQL by which DuckDB gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import diff, governance, models, runs, search
from cairn.plans.base import QUERIES, SQL, Query, near, query
from cairn.plans.base import table as _read
from cairn.plans.views import view
from cairn.sources.registry import page

#: What becomes of a step's type.
STEP_KINDS = {"DTP_LOAD": "load", "LOADING": "load", "CHAIN": "chain", "ADSOACT": "activation", "ABAP": "program", "PSADELETE": "housekeeping"}


_CADENCE = """,
days AS (SELECT DISTINCT chain_id, run_day FROM log_chain),
gaps AS (SELECT chain_id, median(gap) AS median_gap FROM (SELECT chain_id, date_diff('day', lag(run_day) OVER (PARTITION BY chain_id ORDER BY run_day), run_day) AS gap FROM days) GROUP BY chain_id),
base AS (SELECT chain_id, count(DISTINCT log_id) AS runs, count(DISTINCT run_day) AS run_days, min(run_day) AS first_day, max(run_day) AS last_day FROM log_chain GROUP BY chain_id),
cad AS (SELECT *, CASE WHEN run_days <= 1 THEN 'unknown' WHEN median_gap <= 1.5 THEN CASE WHEN runs / run_days >= 18 THEN 'hourly' WHEN runs / run_days >= 1.5 THEN 'multiple_daily' ELSE 'daily' END
  WHEN median_gap <= 4 THEN 'irregular' WHEN median_gap <= 10 THEN 'weekly' WHEN median_gap <= 24 THEN 'irregular' WHEN median_gap <= 180 THEN 'monthly' ELSE 'irregular' END AS cadence,
  date_diff('day', last_day, (SELECT max(run_day) FROM log_chain)) AS idle_days FROM base LEFT JOIN gaps USING (chain_id)),
cadences AS (SELECT chain_id, runs, run_days, median_gap, cadence, CASE WHEN runs >= 3 THEN 'high' ELSE 'low' END AS confidence, idle_days,
  idle_days <= CASE cadence WHEN 'hourly' THEN 30 WHEN 'multiple_daily' THEN 90 WHEN 'daily' THEN 180 WHEN 'weekly' THEN 180 ELSE 395 END AS live FROM cad)"""
_WINDOWS = """,
windows AS (SELECT chain_id, log_id, min(start_us) AS start_us, max(end_us) AS end_us FROM process_log WHERE start_us IS NOT NULL AND end_us IS NOT NULL GROUP BY chain_id, log_id)"""
_DURATIONS = _WINDOWS + """,
durations AS (SELECT chain_id, count(*) AS runs, min(d) AS min_s, median(d) AS median_s, avg(d) AS mean_s, quantile_cont(d, 0.95) AS p95_s, max(d) AS max_s
  FROM (SELECT chain_id, (end_us - start_us) / 1000000.0 AS d FROM windows) GROUP BY chain_id)"""
_STARTS = """,
starts AS (SELECT chain_id, CAST(floor(median(floor((start_us % 86400000000) / 60000000))) AS INTEGER) AS start_minute FROM log_chain GROUP BY chain_id)"""
_MATRIX = _CADENCE + _DURATIONS + _STARTS + """,
matrix AS (SELECT c.chain_id, cadence, live, start_minute, p95_s, start_minute + p95_s / 60 AS done_minute FROM cadences c JOIN starts USING (chain_id) LEFT JOIN durations USING (chain_id))"""


@query(_CADENCE + "\nSELECT * FROM cadences", ("log_chain",))
def a7_chain_cadence(spark, d):
    return runs.cadences(view(spark, d, "log_chain"))


@query("\nSELECT chain_id, count(DISTINCT log_id) AS runs, count(DISTINCT run_day) AS run_days, min(run_day) AS first_day, max(run_day) AS last_day FROM log_chain GROUP BY chain_id", ("log_chain",))
def a2_run_days(spark, d):
    return runs.run_days(view(spark, d, "log_chain"))


@query("""
SELECT chain_id, runs, round(runs / (date_diff('day', first_day, last_day) + 1) + 1e-9, 6) AS runs_per_day, CASE WHEN runs < 3 THEN 'unknown' WHEN r >= 18 THEN 'hourly' WHEN r >= 1.5 THEN 'multiple_daily' WHEN r >= 0.5 THEN 'daily'
  WHEN r >= 0.08 THEN 'weekly' WHEN r >= 0.015 THEN 'monthly' ELSE 'irregular' END AS frequency
FROM (SELECT *, runs / (date_diff('day', first_day, last_day) + 1) AS r FROM (SELECT chain_id, count(DISTINCT log_id) AS runs, min(run_day) AS first_day, max(run_day) AS last_day FROM log_chain GROUP BY chain_id))""", ("log_chain",))
def x2_run_frequency(spark, d):
    return runs.frequencies(view(spark, d, "log_chain")).withColumn("runs_per_day", near("runs_per_day", 6))


_ROUNDED = ", ".join(f"round({c} + 1e-9, 3) AS {c}" for c in ("min_s", "median_s", "mean_s", "p95_s", "max_s"))


@query(_DURATIONS + f"\nSELECT chain_id, runs, {_ROUNDED} FROM durations", ("process_log",))
def a5_run_durations(spark, d):
    out = runs.durations(view(spark, d, "process_log"))
    return out.select("chain_id", "runs", *[near(c).alias(c) for c in ("min_s", "median_s", "mean_s", "p95_s", "max_s")])


@query("\nSELECT chain_id, count(*) AS runs, round(avg(CASE WHEN status = 'G' THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS success_rate FROM log_chain GROUP BY chain_id", ("log_chain",))
def a10_success_rate(spark, d):
    return runs.success_rates(view(spark, d, "log_chain")).withColumn("success_rate", near("success_rate", 4))


@query(_STARTS + "\nSELECT chain_id, start_minute, printf('%02d:%02d', start_minute // 60, start_minute % 60) AS start_clock FROM starts", ("log_chain",))
def a8_median_start(spark, d):
    return runs.median_starts(view(spark, d, "log_chain"))


@query(_WINDOWS + """
SELECT chain_id, log_id, start_us, busy_until FROM (SELECT *, max(end_us) OVER (PARTITION BY chain_id ORDER BY start_us, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS busy_until FROM windows) WHERE start_us < busy_until""", ("process_log",))
def w2_self_overlap(spark, d):
    return runs.self_overlaps(runs.run_windows(view(spark, d, "process_log")))


@query(_WINDOWS + """
SELECT a.chain_id, count(*) AS starts_inside, count(DISTINCT a.log_id) AS runs_disturbed, count(DISTINCT b.chain_id) AS other_chains
FROM windows a JOIN windows b ON b.start_us >= a.start_us AND b.start_us < a.end_us AND a.chain_id <> b.chain_id GROUP BY a.chain_id""", ("process_log",))
def j6_contention(spark, d):
    return runs.contention(runs.run_windows(view(spark, d, "process_log")))


@query(_MATRIX + "\nSELECT chain_id, cadence, live, start_minute, round(p95_s + 1e-9, 3) AS p95_s, round(done_minute + 1e-9, 3) AS done_minute FROM matrix", ("log_chain", "process_log"))
def c19_schedule_matrix(spark, d):
    out = runs.schedule_matrix(view(spark, d, "log_chain"), view(spark, d, "process_log"))
    return out.select("chain_id", "cadence", "live", "start_minute", near("p95_s").alias("p95_s"), near("done_minute").alias("done_minute"))


@query(_MATRIX + """
SELECT report, r.chain_id, round(start_min - done_minute + 1e-9, 3) AS margin, CASE WHEN done_minute IS NULL THEN 'info' WHEN start_min < done_minute THEN 'critical' WHEN start_min - done_minute < 30 THEN 'high' ELSE 'low' END AS severity
FROM reports r JOIN matrix m ON r.chain_id = m.chain_id WHERE done_minute IS NOT NULL""", ("log_chain", "process_log", "reports"))
def c7_schedule_risk(spark, d):
    matrix = runs.schedule_matrix(view(spark, d, "log_chain"), view(spark, d, "process_log"))
    return runs.report_margins(view(spark, d, "reports"), matrix).withColumn("margin", near("margin"))


@query("""
SELECT chain_id, CASE step_type WHEN 'DTP_LOAD' THEN 'load' WHEN 'CHAIN' THEN 'chain' WHEN 'ADSOACT' THEN 'activation' WHEN 'ABAP' THEN 'program' WHEN 'PSADELETE' THEN 'housekeeping' ELSE 'other' END AS category, count(*) AS steps
FROM chain_steps GROUP BY 1, 2""", ("chain_steps",))
def a28_step_categories(spark, d):
    return runs.step_categories(view(spark, d, "chain_steps"), STEP_KINDS)


@query("""
SELECT DISTINCT s.chain_id, s.step_no, d.src, d.tgt, d.updmode FROM chain_steps s JOIN dtp d ON s.variant = d.dtp WHERE s.step_type = 'DTP_LOAD'""", ("chain_steps", "dtp"))
def j7_step_targets(spark, d):
    steps, dtp = view(spark, d, "chain_steps").where("step_type = 'DTP_LOAD'"), view(spark, d, "dtp")
    return steps.join(dtp, steps.variant == dtp.dtp).select("chain_id", "step_no", "src", "tgt", "updmode").distinct()


@query("""
SELECT name, text, langu FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN langu = 'D' THEN 0 WHEN langu = 'E' THEN 1 ELSE 2 END, langu, text) AS n FROM objects) WHERE n = 1""", ("objects",))
def j2_best_texts(spark, d):
    return search.best_texts(view(spark, d, "objects"), "D")


_SEARCH = """
SELECT object_type, name, max(matched) AS matched FROM (SELECT object_type, name, 'name' AS matched FROM objects WHERE instr(upper(name), 'P_12') > 0
UNION ALL SELECT object_type, name, 'description' FROM objects WHERE instr(upper(text), 'P_12') > 0) GROUP BY object_type, name"""


@query(_SEARCH, ("objects",))
def u1_object_search(spark, d):
    return search.search(view(spark, d, "objects"), " p_12")


@query("\nSELECT name, object_type FROM objects WHERE upper(name) LIKE 'P#_1%5' ESCAPE '#'", ("objects",))
def f3_name_pattern(spark, d):
    return view(spark, d, "objects").where(decode.name_matches(F.col("name"), "P\\_1%5")).select("name", "object_type")


@query("\n, hits AS (SELECT name, object_type FROM objects WHERE instr(upper(object_type), 'PROMO') > 0)\nSELECT name, object_type, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY name LIMIT 20 OFFSET 20", ("objects",))
def o1_object_page(spark, d):
    return page(view(spark, d, "objects").where(decode.name_matches(F.col("object_type"), "promo")).select("name", "object_type"), ["name"], 20, 20)


@query("""
SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'missing' WHEN starts_with(lower(text), 'copy of') THEN 'copy_artifact' WHEN upper(text) = upper(name) OR len(regexp_split_to_array(trim(text), '\\s+')) < 4 THEN 'generic' ELSE 'ok' END AS quality, count(*) AS objects
FROM objects GROUP BY 1""", ("objects",))
def x12_description_quality(spark, d):
    return search.description_report(view(spark, d, "objects"))


FACTS = ["f_status", "f_priority"]
_PRINT = "substr(sha256('f_priority=' || f_priority || chr(31) || 'f_status=' || f_status), 1, 16)"
_CHANGE = f""",
l AS (SELECT id, {_PRINT} AS p FROM snapshot_left), r AS (SELECT id, {_PRINT} AS p FROM snapshot_right),
changes AS (SELECT id, CASE WHEN l.p IS NULL THEN 'added' WHEN r.p IS NULL THEN 'removed' WHEN l.p <> r.p THEN 'changed' ELSE 'unchanged' END AS change FROM l FULL JOIN r USING (id))"""


def _snapshots(spark, d):
    return tuple(diff.fingerprints(view(spark, d, f"snapshot_{side}"), "id", FACTS) for side in ("left", "right"))


@query(f"\nSELECT id, {_PRINT} AS fingerprint FROM snapshot_left", ("snapshot_left",))
def x10_fingerprints(spark, d):
    return _snapshots(spark, d)[0].select("id", "fingerprint")


@query(_CHANGE + "\nSELECT id, change FROM changes", ("snapshot_left", "snapshot_right"))
def j12_snapshot_diff(spark, d):
    return diff.differences(*_snapshots(spark, d))


@query("""
SELECT fact, count(*) AS objects FROM (SELECT 'f_status' AS fact FROM snapshot_left l JOIN snapshot_right r USING (id) WHERE l.f_status IS DISTINCT FROM r.f_status
UNION ALL SELECT 'f_priority' FROM snapshot_left l JOIN snapshot_right r USING (id) WHERE l.f_priority IS DISTINCT FROM r.f_priority) GROUP BY fact""", ("snapshot_left", "snapshot_right"))
def a22_changed_facts(spark, d):
    return diff.changed_facts(*_snapshots(spark, d))


@query("""
SELECT area, string_agg(DISTINCT langu, ',' ORDER BY langu) AS langu, string_agg(DISTINCT object_type, ',' ORDER BY object_type) AS object_type FROM objects GROUP BY area""", ("objects",))
def a23_merged_variants(spark, d):
    return diff.merged_variants(view(spark, d, "objects"), "area", ["langu", "object_type"])


@query("""
, gone AS (SELECT min(dtp) AS old_id, src || '>' || tgt AS ends FROM dtp WHERE dtp % 3 = 0 GROUP BY ends HAVING count(*) = 1), new AS (SELECT min(dtp) AS new_id, src || '>' || tgt AS ends FROM dtp WHERE dtp % 3 = 1 GROUP BY ends HAVING count(*) = 1)
SELECT old_id, new_id FROM gone JOIN new USING (ends)""", ("dtp",))
def j13_rekeyed(spark, d):
    dtp = view(spark, d, "dtp").select(F.col("dtp").alias("id"), F.concat("src", F.lit(">"), "tgt").alias("ends"))
    return diff.rekeyed(dtp.where("id % 3 = 0"), dtp.where("id % 3 = 1"), "ends")


@query("""
SELECT code, CASE WHEN m.label IS NULL THEN 'unmapped' WHEN d.label IS NULL THEN 'undeclared' ELSE 'label_differs' END AS finding, CASE WHEN m.label IS NULL THEN 'high' WHEN d.label IS NULL THEN 'info' ELSE 'low' END AS severity
FROM domain_declared d FULL JOIN domain_mapped m USING (code) WHERE d.label IS DISTINCT FROM m.label""", ("domain_declared", "domain_mapped"))
def c22_domain_drift(spark, d):
    return diff.drift(view(spark, d, "domain_declared"), view(spark, d, "domain_mapped"))


@query("""
SELECT auth, count(DISTINCT characteristic) AS characteristics, count(*) AS ranges, bool_and(low = '*') AS all_values, coalesce(string_agg(DISTINCT CASE WHEN starts_with(low, '$') THEN low END, ','), '') AS variables FROM auth_values GROUP BY auth""", ("auth_values",))
def a17_auth_shapes(spark, d):
    return governance.auth_shapes(view(spark, d, "auth_values"))


@query("""
SELECT auth, coalesce(n, 0) AS users FROM (SELECT DISTINCT auth FROM auth_values) a LEFT JOIN (SELECT auth, count(DISTINCT uname) AS n FROM auth_user GROUP BY auth) u USING (auth)""", ("auth_values", "auth_user"))
def a18_users_per_auth(spark, d):
    return governance.users_per_auth(view(spark, d, "auth_values"), view(spark, d, "auth_user"))


@query("""
SELECT f || CAST(k AS VARCHAR) AS characteristic FROM (SELECT unnest(['A', 'N', 'R', 'Z']) AS f), range(1, 10) r(k) WHERE f || CAST(k AS VARCHAR) NOT IN (SELECT characteristic FROM auth_values)""", ("auth_values",))
def j11_uncovered(spark, d):
    flags = spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "f string").crossJoin(F.broadcast(spark.range(1, 10)))
    return governance.uncovered(flags.select(F.concat("f", F.col("id").cast("string")).alias("characteristic")), view(spark, d, "auth_values"))


@query("""
, members AS (SELECT 'N' || CAST(c_nationkey % 27 AS VARCHAR) AS area, c_mktsegment AS family FROM customer)
SELECT coalesce(a.area, '') AS area, family, count(*) AS objects FROM members m LEFT JOIN (SELECT DISTINCT area FROM info_area) a ON m.area = a.area GROUP BY 1, 2""", ("info_area",))
def a19_area_rollup(spark, d):
    members = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("N"), (F.col("c_nationkey") % 27).cast("string")).alias("area"), F.col("c_mktsegment").alias("family"))
    return governance.area_rollup(view(spark, d, "info_area"), members)


@query("""
, t AS (SELECT max(started) AS today FROM requests)
SELECT provider, count(*) AS requests, arg_max(status, struct_pack(s := started, r := rnr)) AS last_status, date_diff('day', max(started), max(today)) AS age_days, date_diff('day', max(CASE WHEN status = 'success' THEN started END), max(today)) AS days_since_success
FROM requests, t GROUP BY provider""", ("requests",))
def c20_provider_health(spark, d):
    return governance.provider_health(view(spark, d, "requests"))


@query("\nSELECT provider, " + ", ".join(f"round(CAST(sum(CASE WHEN role = '{r}' THEN {c} END) AS DOUBLE) + 1e-9, 2) AS {r}_{c}" for r in ("active", "changelog", "inbound") for c in ("records", "memory")) + " FROM volumes GROUP BY provider", ("volumes",))
def a12_volumes(spark, d):
    out = governance.volumes(view(spark, d, "volumes"))
    return out.select("provider", *[near(F.col(c).cast("double"), 2).alias(c) for c in out.columns[1:]])


@query("""
, steps AS (SELECT chain_id, step_no AS step, 'E' || CAST(step_no % 9 AS VARCHAR) AS starts_on, CASE WHEN step_no % 4 = 0 THEN '' ELSE 'E' || CAST(step_no % 7 AS VARCHAR) END AS on_green, 'E' || CAST(step_no % 11 AS VARCHAR) AS on_red FROM chain_steps)
SELECT DISTINCT a.chain_id, a.step AS src, b.step AS dst, e."on" AS "on" FROM steps a CROSS JOIN (VALUES ('green'), ('red')) e("on")
JOIN steps b ON a.chain_id = b.chain_id AND a.step <> b.step AND b.starts_on = CASE e."on" WHEN 'green' THEN a.on_green ELSE a.on_red END""", ("chain_steps",))
def j5_event_successors(spark, d):
    event = lambda n: F.concat(F.lit("E"), (F.col("step_no") % n).cast("string"))
    steps = view(spark, d, "chain_steps").select("chain_id", F.col("step_no").alias("step"), event(9).alias("starts_on"), F.when(F.col("step_no") % 4 == 0, "").otherwise(event(7)).alias("on_green"), event(11).alias("on_red"))
    return models.event_successors(steps)


@query("""
WITH fields AS (SELECT l_orderkey AS rule_id, l_linenumber % 2 AS role, 'F' || CAST(l_partkey AS VARCHAR) AS field FROM lineitem), constants AS (SELECT l_orderkey AS rule_id, min(l_linestatus) AS constant FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS rule_id, o_orderpriority AS kind, coalesce(s.v, '') AS sources, coalesce(t.v, '') AS targets, constant FROM orders
LEFT JOIN (SELECT rule_id, string_agg(DISTINCT field, ',' ORDER BY field) AS v FROM fields WHERE role = 0 GROUP BY 1) s ON s.rule_id = o_orderkey
LEFT JOIN (SELECT rule_id, string_agg(DISTINCT field, ',' ORDER BY field) AS v FROM fields WHERE role = 1 GROUP BY 1) t ON t.rule_id = o_orderkey LEFT JOIN constants c ON c.rule_id = o_orderkey""")
def j14_rule_assembly(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    rules = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("rule_id"), F.col("o_orderpriority").alias("kind"))
    fields = items.select(F.col("l_orderkey").alias("rule_id"), (F.col("l_linenumber") % 2).alias("role"), F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("field"))
    constants = items.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rule_id"), F.col("l_linestatus").alias("value"))
    return models.assembled_rules(rules, fields, constants)


@query("""
WITH contract AS (SELECT 'C' || CAST(p_partkey % 40 AS VARCHAR) AS capability, p_brand AS table_name, p_partkey % 40 <> 7 AS implemented FROM part), present AS (SELECT DISTINCT p_brand AS table_name FROM part WHERE p_size > 3 AND p_brand <> 'Brand#11')
SELECT capability, CASE WHEN NOT bool_and(implemented) THEN 'not_implemented' WHEN bool_and(p.table_name IS NOT NULL) THEN 'usable' ELSE 'absent_on_system' END AS verdict FROM contract c LEFT JOIN present p USING (table_name) GROUP BY capability""")
def j20_capability_verdicts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    contract = part.select(F.concat(F.lit("C"), (F.col("p_partkey") % 40).cast("string")).alias("capability"), F.col("p_brand").alias("table_name"), (F.col("p_partkey") % 40 != 7).alias("implemented"))
    return models.capability_verdicts(contract, part.where("p_size > 3 AND p_brand <> 'Brand#11'").select(F.col("p_brand").alias("table_name")))


@query("""
WITH s AS (SELECT 'SYS' || CAST(ps_supp AS VARCHAR) AS system, count(DISTINCT part) AS n FROM (SELECT l_suppkey % 23 AS ps_supp, l_partkey AS part FROM lineitem) GROUP BY 1), r AS (SELECT 'SYS' || CAST(n_nationkey AS VARCHAR) AS system FROM nation WHERE n_nationkey % 3 > 0)
SELECT system, coalesce(n, 0) AS datasources, r.system IS NOT NULL AS registered FROM s FULL JOIN r USING (system)""")
def j10_unregistered_systems(spark, d):
    sources = _read(spark, d, "lineitem").select(F.concat(F.lit("SYS"), (F.col("l_suppkey") % 23).cast("string")).alias("system"), F.col("l_partkey").alias("datasource"))
    return search.unregistered(sources, _read(spark, d, "nation").where("n_nationkey % 3 > 0").select(F.concat(F.lit("SYS"), F.col("n_nationkey").cast("string")).alias("system")))


@query("""
WITH f AS (SELECT l_suppkey AS source, CASE l_linenumber % 4 WHEN 0 THEN 'Z' WHEN 1 THEN 'Y' WHEN 2 THEN '/BIC/' ELSE '0' END || CAST(l_partkey % 5 AS VARCHAR) AS field FROM lineitem)
SELECT source, count(DISTINCT field) AS customer_fields, CASE WHEN count(DISTINCT field) >= 5 THEN 'medium' ELSE 'low' END AS severity FROM f WHERE regexp_matches(field, '^(Z|Y|/BIC/)') GROUP BY source""")
def c6_extractor_enhancements(spark, d):
    prefix = F.element_at(F.array(F.lit("Z"), F.lit("Y"), F.lit("/BIC/"), F.lit("0")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    fields = _read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat(prefix, (F.col("l_partkey") % 5).cast("string")).alias("field"))
    return search.customer_fields(fields)


@query("""
, s AS (SELECT tgt AS target, 'F' || CAST(dtp % 7 AS VARCHAR) AS field, src AS stream FROM dtp)
SELECT target, field, string_agg(DISTINCT stream, ',' ORDER BY stream) AS streams FROM s GROUP BY 1, 2 HAVING count(DISTINCT stream) > 1""", ("dtp",))
def a14_field_collisions(spark, d):
    return search.field_collisions(view(spark, d, "dtp").select(F.col("tgt").alias("target"), F.concat(F.lit("F"), (F.col("dtp") % 7).cast("string")).alias("field"), F.col("src").alias("stream")))


@query("""
WITH q AS (SELECT c_custkey AS query, max(o_orderdate) AS last_used FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT query, date_diff('day', last_used, (SELECT max(last_used) FROM q)) AS idle_days, last_used IS NULL OR date_diff('day', last_used, (SELECT max(last_used) FROM q)) > 365 AS retire FROM q""")
def x17_query_usage(spark, d):
    customers, orders = _read(spark, d, "customer"), _read(spark, d, "orders")
    return search.query_usage(customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("query")).agg(F.max("o_orderdate").alias("last_used")))


@query(r"""
WITH e AS (SELECT DISTINCT p_name AS endpoint FROM part)
SELECT endpoint, regexp_extract(endpoint, '^(\S+)\s*(.*)$', 1) AS datasource, nullif(rtrim(regexp_extract(endpoint, '^(\S+)\s*(.*)$', 2)), '') AS system FROM e""")
def x11_endpoint_parts(spark, d):
    return search.endpoint_parts(_read(spark, d, "part").select(F.col("p_name").alias("endpoint")).distinct())


from cairn.plans import analysis_queries, answer_queries, code_queries, definition_queries, diagnosis_queries, graph_queries, model_queries, provider_queries  # noqa: E402, F401  (they register their queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
