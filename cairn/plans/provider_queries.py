"""Queries of providers: headers, fields, coverage by loads, kinds by ledgers, and the list of queries on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import providers, runs
from cairn.plans.base import query, table
from cairn.plans.views import view

_HEADERS = """,
headers AS (SELECT name, 'dso' AS kind, NULL AS subtype, TRUE AS active, nullif(trim(area), '') AS area, nullif(trim(owner), '') AS owner FROM dso_headers UNION SELECT name, 'adso', NULL, TRUE, nullif(trim(area), ''), nullif(trim(owner), '') FROM adso_headers
  UNION SELECT name, CASE upper(type) WHEN 'M' THEN 'multiprovider' WHEN 'V' THEN 'virtualprovider' ELSE 'infocube' END, type, status = 'ACT', area, owner FROM cube_headers UNION SELECT DISTINCT 'NC' || name, 'compositeprovider', NULL, TRUE, NULL, NULL FROM provider_catalogue UNION SELECT name, 'infoobject', NULL, TRUE, NULL, NULL FROM infoobject_names)"""
_HEADER_VIEWS = ("dso_headers", "adso_headers", "cube_headers", "provider_catalogue", "infoobject_names")


def _headers(spark, d):
    bare = lambda df: df.select("name", F.lit(None).cast("string").alias("area"), F.lit("").alias("owner"))
    composites = view(spark, d, "provider_catalogue").select(F.concat(F.lit("NC"), "name").alias("name"))
    return providers.headers(view(spark, d, "dso_headers"), view(spark, d, "adso_headers"), view(spark, d, "cube_headers"), bare(composites), bare(view(spark, d, "infoobject_names")))


@query(_HEADERS + "\nSELECT * FROM headers", _HEADER_VIEWS)
def z1_provider_headers(spark, d):
    return _headers(spark, d)


_COLUMNS = """,
candidates AS (SELECT "column", unnest(c) AS candidate, unnest(range(len(c))) AS rank FROM (SELECT DISTINCT "column", CASE WHEN starts_with("column", '/BIC/') OR starts_with("column", '/BI0/') THEN ["column"[6:], '0' || "column"[6:]] WHEN starts_with("column", '/') THEN ["column"] ELSE ['0' || "column", "column"] END AS c FROM generated_columns)),
resolved AS (SELECT "column", candidate AS infoobject, CASE WHEN name IS NULL THEN 'inferred' ELSE 'confirmed' END AS resolution FROM candidates LEFT JOIN infoobject_names ON name = candidate QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY name IS NULL, rank) = 1)"""


@query(_COLUMNS + """\nSELECT "column", infoobject, resolution FROM resolved""", ("generated_columns", "infoobject_names"))
def z2_column_infoobjects(spark, d):
    return providers.column_infoobjects(view(spark, d, "generated_columns"), view(spark, d, "infoobject_names"))


_FIELDS = _COLUMNS + """,
every AS (SELECT provider, field, min(position) AS position, bool_or(key = 'X') AS is_key, field AS infoobject, 'declared' AS resolution FROM stored_fields GROUP BY provider, field
  UNION ALL SELECT c.provider, c."column", min(c.position), bool_or(k.field IS NOT NULL), any_value(r.infoobject), any_value(r.resolution) FROM generated_columns c JOIN resolved r ON r."column" = c."column" LEFT JOIN column_keys k ON k.provider = c.provider AND k.field IN (c."column", r.infoobject) GROUP BY c.provider, c."column"),
fields AS (SELECT provider, field, position, is_key, CASE WHEN n.name IS NOT NULL THEN 'navigation_attribute' ELSE 'field' END AS role, characteristic AS attribute_of, attribute AS attribute_name, infoobject, resolution FROM every LEFT JOIN field_navs n ON n.name = field)"""
_FIELD_VIEWS = ("stored_fields", "generated_columns", "column_keys", "field_navs", "infoobject_names")


def _fields(spark, d):
    return providers.provider_fields(*(view(spark, d, name) for name in _FIELD_VIEWS))


@query(_FIELDS + "\nSELECT * FROM fields", _FIELD_VIEWS)
def z4_provider_fields(spark, d):
    return _fields(spark, d)


@query(_HEADERS + _FIELDS + """,
per AS (SELECT provider AS name, count(*) AS fields, count(*) FILTER (WHERE is_key) AS keys, count(*) FILTER (WHERE role = 'navigation_attribute') AS navigation_attributes, count(*) FILTER (WHERE resolution = 'inferred') AS inferred, string_agg(CASE WHEN is_key THEN field END, ',' ORDER BY position, field) AS key_names FROM fields GROUP BY 1),
held AS (SELECT composite AS name, count(DISTINCT part) AS parts FROM provider_parts GROUP BY 1)
SELECT h.name, kind, active, area, coalesce(fields, 0) AS fields, coalesce(keys, 0) AS keys, coalesce(navigation_attributes, 0) AS navigation_attributes, coalesce(inferred, 0) AS inferred, coalesce(parts, 0) AS parts, coalesce(key_names, '') AS key_names FROM headers h LEFT JOIN per USING (name) LEFT JOIN held USING (name)""",
       tuple(dict.fromkeys((*_HEADER_VIEWS, *_FIELD_VIEWS, "provider_parts"))))
def c23_described_providers(spark, d):
    return providers.described(_headers(spark, d), _fields(spark, d), view(spark, d, "provider_parts"))


@query("""
, o AS (SELECT provider, min(upper(code)) AS code FROM classic_ledger GROUP BY 1), n AS (SELECT provider, min(upper(code)) AS code FROM newer_ledger GROUP BY 1),
k AS (SELECT provider, CASE o.code WHEN 'ODSO' THEN 'dso' WHEN 'FLEX_T' THEN 'infoobject' WHEN 'CUBE' THEN 'infocube' WHEN 'IOBJ' THEN 'infoobject' END AS a, CASE n.code WHEN 'ADSO' THEN 'adso' END AS b FROM o FULL JOIN n USING (provider))
SELECT provider, coalesce(a, b) AS kind, CASE WHEN a IS NOT NULL THEN 'classic' WHEN b IS NOT NULL THEN 'newer' END AS ledger FROM k""", ("classic_ledger", "newer_ledger"))
def z25_inferred_kinds(spark, d):
    return providers.inferred_kinds(view(spark, d, "classic_ledger"), view(spark, d, "newer_ledger"))


@query("""
, known AS (SELECT dtp, min((tgt, updmode)) AS l FROM dtp GROUP BY dtp), steps AS (SELECT chain_id AS chain, l[1] AS name, arg_min(l[2], step_no) AS updmode, CASE WHEN chain_id % 3 = 0 THEN 'weekly' ELSE 'daily' END AS cadence FROM chain_steps s JOIN known k ON k.dtp = s.variant WHERE step_type = 'DTP_LOAD' GROUP BY chain_id, l[1]),
enumerated AS (SELECT 'N' || CAST(p_partkey AS VARCHAR) AS name FROM part), per AS (SELECT name, count(DISTINCT chain) AS chains, string_agg(DISTINCT updmode, ',' ORDER BY updmode) AS modes, string_agg(DISTINCT cadence, ',' ORDER BY cadence) AS cadences, list_sort(list(DISTINCT chain)) AS l FROM steps GROUP BY name)
SELECT name, CASE WHEN chains IS NULL THEN 'unloaded' WHEN e.name IS NULL THEN 'loaded_not_enumerated' ELSE 'loaded' END AS status, coalesce(chains, 0) AS chains, coalesce(modes, '') AS modes, coalesce(cadences, '') AS cadences,
  coalesce(array_to_string(l[1:3], ',') || CASE WHEN chains > 3 THEN ' (+' || CAST(chains - 3 AS VARCHAR) || ')' ELSE '' END, '') AS named FROM per FULL JOIN (SELECT name AS name FROM enumerated) e USING (name)""".replace("e.name IS NULL", "name NOT IN (SELECT name FROM enumerated)"), ("chain_steps", "dtp"))
def c27_load_coverage(spark, d):
    targets = runs.step_targets(view(spark, d, "chain_steps"), view(spark, d, "dtp"))
    loaded = targets.select(F.col("target").alias("name"), F.col("chain_id").alias("chain"), "updmode", F.when(F.col("chain_id") % 3 == 0, "weekly").otherwise("daily").alias("cadence"))
    return providers.load_coverage(loaded, table(spark, d, "part").select(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("name")))


@query("""
, roots AS (SELECT o_orderkey AS query FROM orders WHERE o_orderkey % 4 = 0), assigned AS (SELECT l_orderkey AS query, 'N' || CAST(l_partkey AS VARCHAR) AS provider FROM lineitem WHERE l_linenumber < 3),
per AS (SELECT query, min(provider) AS provider, count(DISTINCT provider) AS providers FROM assigned GROUP BY 1)
SELECT query, name, nullif(owner, '') AS owner, last_used, CASE WHEN starts_with(name, '!!') THEN 'ad_hoc' ELSE 'designed' END AS origin, provider, coalesce(providers, 0) AS providers FROM query_directory LEFT JOIN per USING (query) WHERE version = 'A' AND status = 'ACT' AND query IN (SELECT query FROM roots)""", ("query_directory",))
def z11_query_list(spark, d):
    roots = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("query"))
    assigned = table(spark, d, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("query"), F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("provider"))
    return providers.query_list(view(spark, d, "query_directory"), roots, assigned)
