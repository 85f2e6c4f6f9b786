"""Queries of stored composite models."""

from __future__ import annotations

from cairn.operators import composites
from cairn.plans.base import query
from cairn.plans.views import view

#: SQL's own reading of the models: declared nodes, their inputs and mappings by what stands between their tags.
_PARSED = r""",
good AS (SELECT name, xml FROM composite_models WHERE xml <> '' AND NOT contains(xml, '<!DOCTYPE') AND ends_with(xml, '</Composite:compositeView>')),
nodes AS (SELECT name, regexp_extract(n, ' name="([^"]*)"', 1) AS node, n AS body, k FROM (SELECT name, unnest(l) AS n, unnest(range(1, len(l) + 1)) AS k FROM (SELECT name, regexp_extract_all(xml, '<viewNode xsi:type="View:[A-Za-z]+" name="[^"]+">.*?</input></viewNode>') AS l FROM good))),
tops AS (SELECT name, coalesce(nullif(regexp_extract(xml, 'defaultNode="#///([^"]*)"', 1), ''), (SELECT min_by(node, k) FROM nodes n WHERE n.name = g.name)) AS top FROM good g),
inputs AS (SELECT name, node, regexp_extract(i, 'alias="([^"]*)"', 1) AS alias, nullif(regexp_extract(i, '<entity>(.*)[.]([A-Za-z]+)#.*</entity>', 1), '') AS entity, regexp_extract(i, '<entity>(.*)[.]([A-Za-z]+)#.*</entity>', 2) AS doc,
  nullif(regexp_extract(i, '#///([A-Z0-9]+)</viewNode>', 1), '') AS internal, i FROM (SELECT name, node, unnest(regexp_extract_all(body, '<input .*?</input>')) AS i FROM nodes)),
decoded AS (SELECT *, CASE WHEN starts_with(entity, '$') THEN '/' || string_split(entity, '$')[2] || '/' || string_split(entity, '$')[3] ELSE entity END AS part, CASE WHEN len(string_split(alias, '.')) >= 3 THEN string_split(alias, '.')[2] END AS code FROM inputs),
typed AS (SELECT *, CASE WHEN doc = 'calculationview' THEN 'calcview' ELSE CASE code WHEN 'ADSO' THEN 'adso' WHEN 'CUBE' THEN 'infocube' WHEN 'ODSO' THEN 'dso' WHEN 'DSO' THEN 'dso' WHEN 'IOBJ' THEN 'infoobject' WHEN 'HCPR' THEN 'compositeprovider' WHEN 'CALC' THEN 'calcview' ELSE 'unknown' END END AS part_kind,
  CASE WHEN doc = 'calculationview' THEN replace(array_to_string(string_split(part, '/')[:-2], '/'), '/', '.') || '/' || string_split(part, '/')[-1] END AS runtime_view FROM decoded),
maps AS (SELECT name, node, alias, part, part_kind, internal, runtime_view, regexp_extract(m, 'targetName="([^"]*)"', 1) AS target, CASE WHEN contains(m, 'Constant') THEN NULL ELSE regexp_extract(m, 'sourceName="([^"]*)"', 1) END AS source,
  CASE WHEN contains(m, 'Constant') THEN 'constant' ELSE 'element' END AS mapping_kind FROM (SELECT *, unnest(regexp_extract_all(i, '<mapping [^>]*/>')) AS m FROM typed))"""


@query(_PARSED + """
SELECT c.name, CASE WHEN xml = '' THEN 'empty' WHEN contains(xml, '<!DOCTYPE') THEN 'document_type' WHEN starts_with(xml, '<other') THEN 'other_root' WHEN NOT ends_with(xml, '</Composite:compositeView>') THEN 'not_well_formed' ELSE 'parsed' END AS status,
  CASE WHEN g.name IS NOT NULL THEN (SELECT CAST(count(*) AS INTEGER) FROM nodes n WHERE n.name = c.name) END AS nodes, CASE WHEN g.name IS NOT NULL THEN (SELECT CAST(count(*) AS INTEGER) FROM inputs i WHERE i.name = c.name) END AS inputs
FROM composite_models c LEFT JOIN (SELECT name FROM good) g ON g.name = c.name""", ("composite_models",))
def s9_composite_statuses(spark, d):
    return composites.statuses(view(spark, d, "composite_models"))


@query(_PARSED + "\nSELECT DISTINCT name, part, part_kind, code AS alias_kind, runtime_view FROM typed WHERE part IS NOT NULL", ("composite_models",))
def z5_composite_parts(spark, d):
    return composites.parts(view(spark, d, "composite_models"))


@query(_PARSED + """,
walk AS (SELECT DISTINCT name, first_value(target) OVER (PARTITION BY name, upper(target) ORDER BY target) AS field, node, upper(target) AS asked, CAST([] AS VARCHAR[]) AS way, [node || ':' || upper(target)] AS seen FROM maps JOIN tops USING (name) WHERE node = top
  UNION ALL SELECT w.name, w.field, m.internal, upper(m.source), list_append(w.way, m.alias), list_append(w.seen, m.internal || ':' || upper(m.source)) FROM walk w JOIN maps m ON m.name = w.name AND m.node = w.node AND upper(m.target) = w.asked
  WHERE m.internal IS NOT NULL AND m.source IS NOT NULL AND NOT list_contains(w.seen, m.internal || ':' || upper(m.source))),
ends AS (SELECT w.name, w.field, CASE WHEN m.name IS NULL THEN 'no_mapping' WHEN m.internal IS NOT NULL AND m.source IS NOT NULL THEN 'loop' WHEN m.mapping_kind = 'constant' THEN 'constant' WHEN m.part IS NULL THEN 'unreadable_part' ELSE 'object' END AS stop,
  m.part, CASE WHEN m.part IS NOT NULL THEN m.part_kind END AS part_kind, m.source, m.mapping_kind, m.runtime_view, w.node, w.asked, array_to_string(CASE WHEN m.name IS NULL THEN w.way ELSE list_append(w.way, m.alias) END, '>') AS via, CAST(len(w.way) + CASE WHEN m.name IS NULL THEN 0 ELSE 1 END AS INTEGER) AS hops
  FROM walk w LEFT JOIN maps m ON m.name = w.name AND m.node = w.node AND upper(m.target) = w.asked WHERE m.name IS NULL OR m.internal IS NULL OR m.source IS NULL OR list_contains(w.seen, m.internal || ':' || upper(m.source)))
SELECT name, field, stop, part, part_kind, source, mapping_kind, runtime_view, node, asked, via, hops FROM ends
QUALIFY row_number() OVER (PARTITION BY name, field, stop, part, upper(coalesce(source, '')), CASE WHEN stop NOT IN ('object', 'constant') THEN node || ':' || asked END ORDER BY hops, via) = 1""", ("composite_models",), recursive=True)
def z10_resolved_fields(spark, d):
    return composites.resolved_fields(view(spark, d, "composite_models"))
