"""Queries of exits, query definitions, field lineage, characteristics, areas, evidence, dependencies and the snapshot store."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from cairn.operators import characteristics, dependencies, diff, evidence, exits, fields, governance
from cairn.operators import query_definitions as definitions
from cairn.plans.base import query, table
from cairn.plans.cut import shared_folder
from cairn.plans.views import view
from cairn.sources.snapshots import SnapshotStore

_EXIT_TOKENS = r"regexp_extract_all(code, '''[^'']*''|[A-Z0-9_/<>]+|=>|->|[^\sA-Z0-9_/<>]')"
_EXITS = f""",
code AS (SELECT codeid, line_no, line, code, {_EXIT_TOKENS} AS t FROM (SELECT codeid, line_no, line, upper(CASE WHEN instr(line, '"') > 0 THEN substr(line, 1, instr(line, '"') - 1) ELSE line END) AS code FROM exit_lines WHERE NOT starts_with(ltrim(line), '*'))),
total AS (SELECT *, CASE WHEN t[1] = 'CASE' THEN 1 WHEN t[1] = 'ENDCASE' THEN -1 ELSE 0 END AS step, sum(CASE WHEN t[1] = 'CASE' THEN 1 WHEN t[1] = 'ENDCASE' THEN -1 ELSE 0 END) OVER (PARTITION BY codeid ORDER BY line_no) AS total FROM code),
depths AS (SELECT *, CAST(total - least(0, min(total) OVER (PARTITION BY codeid ORDER BY line_no)) AS INT) AS depth FROM total),
levels AS (SELECT *, greatest(1, CASE WHEN step = -1 THEN coalesce(lag(depth) OVER (PARTITION BY codeid ORDER BY line_no), 0) ELSE depth END) AS level FROM depths),
whens AS (SELECT codeid, line_no, level, list_filter(list_transform(list_filter(t, lambda x: starts_with(x, '''') AND len(x) > 1), lambda x: upper(trim(x[2:len(x) - 1]))), lambda x: x <> '') AS names FROM levels WHERE t[1] = 'WHEN' AND coalesce(t[2], '') <> 'OTHERS')"""


@query(_EXITS + """,
spans AS (SELECT w.codeid, w.line_no AS opened, w.level, w.names, (SELECT min(m.line_no) FROM levels m WHERE m.codeid = w.codeid AND m.line_no > w.line_no AND m.t[1] IN ('CASE', 'WHEN', 'ENDCASE') AND m.level = w.level) AS closed FROM whens w)
SELECT s.codeid, unnest(s.names) AS name, l.line_no, l.line FROM spans s JOIN levels l ON l.codeid = s.codeid AND l.line_no > s.opened AND (s.closed IS NULL OR l.line_no < s.closed)""", ("exit_lines",))
def t7_exit_branches(spark, d):
    return exits.branches(view(spark, d, "exit_lines"))


@query(_EXITS + """,
spans AS (SELECT w.codeid, w.line_no AS opened, w.names, (SELECT min(m.line_no) FROM levels m WHERE m.codeid = w.codeid AND m.line_no > w.line_no AND m.t[1] IN ('WHEN', 'ENDCASE')) AS closed FROM whens w)
SELECT s.codeid, unnest(s.names) AS name, l.line_no, l.line FROM spans s JOIN levels l ON l.codeid = s.codeid AND l.line_no > s.opened AND (s.closed IS NULL OR l.line_no < s.closed)""", ("exit_lines",))
def t7_flat_branches(spark, d):
    return exits.branches(view(spark, d, "exit_lines"), nested=False)


_HANDLED = _EXITS + """,
named AS (SELECT codeid, line_no, 0 AS side, unnest(names) AS name, unnest(range(len(names))) AS nth FROM whens
  UNION ALL SELECT codeid, line_no, 1, upper(trim(regexp_extract(code, 'I_DATASOURCE *= *''([^'']+)''', 1))), 0 FROM code WHERE regexp_matches(code, '\\bI_DATASOURCE *= *''[^'']+''')),
handled AS (SELECT codeid, name, row_number() OVER (PARTITION BY codeid ORDER BY min((line_no, side, nth))) AS place FROM named WHERE name <> '' GROUP BY codeid, name)"""


@query(_HANDLED + "\nSELECT codeid, name, CAST(place AS INTEGER) AS place FROM handled", ("exit_lines",))
def t7_handled_sources(spark, d):
    return exits.handled(view(spark, d, "exit_lines"))


_DISPATCH = _EXITS + r""",
pasted AS (SELECT codeid, list_transform(list_filter(t, lambda x: starts_with(x, '''') AND len(x) > 1), lambda x: upper(trim(x[2:len(x) - 1]))) || regexp_extract_all(code, '[|]([A-Z0-9_/]+)[{]', 1) AS p FROM code
  WHERE list_contains(t, 'I_DATASOURCE') AND (t[1] = 'CONCATENATE' OR contains(code, '&&') OR contains(code, '|'))),
begun AS (SELECT codeid, list_sort(list(DISTINCT x)) AS prefixes FROM (SELECT codeid, unnest(p) AS x FROM pasted) WHERE regexp_matches(x, '^(Z|Y|/[A-Z0-9_]+/)[A-Z0-9_]*$') GROUP BY codeid),
far AS (SELECT codeid, bool_or(regexp_matches(code, '\bPERFORM\b[^.]*\bIN +PROGRAM *[(] *[A-Z0-9_<>-]+ *[)]')) AS dynamic FROM code GROUP BY codeid),
dispatch AS (SELECT codeid, coalesce(dynamic, FALSE) AS dynamic, coalesce(prefixes, []) AS prefixes FROM (SELECT DISTINCT codeid FROM exit_lines) LEFT JOIN far USING (codeid) LEFT JOIN begun USING (codeid))"""


@query(_DISPATCH + "\nSELECT codeid, dynamic, array_to_string(prefixes, ',') AS prefixes FROM dispatch", ("exit_lines",))
def t7_exit_dispatch(spark, d):
    return exits.dispatches(view(spark, d, "exit_lines")).withColumn("prefixes", F.array_join("prefixes", ","))


@query(_HANDLED + _DISPATCH.replace(_EXITS, "") + """,
wanted AS (SELECT DISTINCT codeid, name AS datasource FROM handled UNION SELECT codeid, 'A_DATASOURCE_WHOSE_NAME_IS_LONGER_THAN_IT_MAY_BE' FROM handled UNION SELECT codeid, 'B AD' FROM handled),
pairs AS (SELECT codeid, datasource, prefix, CASE WHEN regexp_matches(datasource, '^/[A-Z0-9_]+/.') THEN regexp_extract(datasource, '^/[A-Z0-9_]+/(.+)$', 1) ELSE datasource END AS body FROM (SELECT codeid, unnest(prefixes) AS prefix FROM dispatch) JOIN wanted USING (codeid)),
programs AS (SELECT *, CASE WHEN NOT contains(body, '/') AND NOT contains(prefix || body, ' ') AND len(prefix || body) <= 40 THEN prefix || body END AS program FROM pairs)
SELECT codeid, datasource, prefix, program, CASE WHEN program IS NULL THEN 'no_name' WHEN program IN (SELECT program FROM exit_programs) THEN 'available' ELSE 'absent' END AS status FROM programs""", ("exit_lines", "exit_programs"))
def z32_satellites(spark, d):
    lines = view(spark, d, "exit_lines")
    named = exits.handled(lines).select("codeid", F.col("name").alias("datasource"))
    more = [named.select("codeid", F.lit(x).alias("datasource")) for x in ("A_DATASOURCE_WHOSE_NAME_IS_LONGER_THAN_IT_MAY_BE", "B AD")]
    return exits.satellites(exits.dispatches(lines), named.union(more[0]).union(more[1]), view(spark, d, "exit_programs"))


@query(_HANDLED + "\nSELECT name, count(DISTINCT codeid) AS exits FROM handled WHERE name NOT IN (SELECT 'DS_' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 2 = 0) GROUP BY name", ("exit_lines",))
def z33_exit_only(spark, d):
    declared = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("DS_"), F.col("p_partkey").cast("string")).alias("name"))
    return exits.exit_only(exits.handled(view(spark, d, "exit_lines")), declared)


_TREE = """,
roots AS (SELECT element AS query FROM element_directory WHERE deftp = 'REP'), edges AS (SELECT DISTINCT parent, child FROM element_xref),
walk AS (SELECT query, query AS element, 0 AS level FROM roots UNION SELECT w.query, e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.element WHERE w.level < 10),
every AS (SELECT query, element, min(level) AS level FROM walk GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY level, element) AS place, count(*) OVER (PARTITION BY query) AS elements, bool_or(level = 10 AND element IN (SELECT parent FROM edges)) OVER (PARTITION BY query) AS cut FROM every),
tree AS (SELECT query, element, level, CAST(place AS INTEGER) AS place, elements, elements > 500 AS capped, cut FROM ranked WHERE place <= 500),
picked AS (SELECT element, bool_or(infoobject = '1KYFNM') AS figures, min(CASE WHEN infoobject <> '1KYFNM' THEN infoobject END) AS other FROM element_selects GROUP BY element),
typed AS (SELECT element, upper(trim(deftp)) AS deftp, other, CASE upper(trim(deftp)) WHEN 'SEL' THEN CASE subdeftp WHEN 'CON' THEN 'condition' WHEN 'EXC' THEN 'exception' WHEN 'CHA' THEN 'characteristic' WHEN 'RKF' THEN 'restricted_key_figure'
  ELSE CASE WHEN figures IS NULL THEN 'selection' WHEN figures THEN 'restricted_key_figure' ELSE 'characteristic' END END WHEN 'REP' THEN 'query' WHEN 'SHT' THEN 'query_sheet' WHEN 'SOB' THEN 'filter' WHEN 'FML' THEN 'formula' WHEN 'STR' THEN 'structure' WHEN 'CKF' THEN 'calculated_key_figure' ELSE 'unknown' END AS type
  FROM element_directory LEFT JOIN picked USING (element)),
stored AS (SELECT DISTINCT element, infoobject, sign, opt AS operator, low, nullif(trim(high), '') AS high, lowflag = '3' AS low_is_variable, highflag = '3' AS high_is_variable FROM element_ranges WHERE infoobject <> ''),
rolled AS (SELECT query, element, bool_or(own) AS own, infoobject, sign, operator, low, high, low_is_variable, high_is_variable FROM (SELECT query, t.element, TRUE AS own, s.* EXCLUDE (element) FROM tree t JOIN stored s ON s.element = t.element
  UNION ALL SELECT query, t.element, FALSE, s.* EXCLUDE (element) FROM tree t JOIN typed y ON y.element = t.element AND y.type = 'filter' JOIN edges e ON e.parent = t.element JOIN stored s ON s.element = e.child) GROUP BY ALL)"""
_DEFINED = ("element_xref", "element_directory", "element_selects", "element_ranges")


def _definition(spark, d):
    directory, xref = view(spark, d, "element_directory"), view(spark, d, "element_xref")
    roots = directory.where("deftp = 'REP'").select(F.col("element").alias("query"))
    return definitions.element_tree(roots, xref), xref, definitions.element_types(directory, view(spark, d, "element_selects")), view(spark, d, "element_ranges")


@query(_TREE + """,
vars AS (SELECT query, element, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM (SELECT query, element, unnest([CASE WHEN low_is_variable THEN low END, CASE WHEN high_is_variable THEN high END]) AS v FROM rolled) WHERE v IS NOT NULL GROUP BY 1, 2),
per AS (SELECT query, element, count(*) AS n FROM rolled GROUP BY 1, 2)
SELECT t.query, t.element, level, place, coalesce(type, 'unknown') AS type, CASE WHEN type = 'characteristic' THEN other END AS infoobject, coalesce(n, 0) AS restrictions, coalesce(v, '') AS variables, capped, cut
FROM tree t LEFT JOIN typed y ON y.element = t.element LEFT JOIN per p ON p.query = t.query AND p.element = t.element LEFT JOIN vars x ON x.query = t.query AND x.element = t.element""", _DEFINED, recursive=True)
def c24_query_definition(spark, d):
    tree, xref, types, ranges = _definition(spark, d)
    return definitions.definition(tree, types, definitions.rolled_restrictions(tree, xref, types, ranges))


@query(_TREE + "\nSELECT * FROM rolled", _DEFINED, recursive=True)
def c24_rolled_restrictions(spark, d):
    return definitions.rolled_restrictions(*_definition(spark, d))


@query(_TREE + """
SELECT p.query, x.parent, x.child, x.position, CASE upper(laytp) WHEN 'ROW' THEN 'rows' WHEN 'COL' THEN 'columns' WHEN 'AGG' THEN 'aggregated' WHEN 'FLT' THEN 'free' WHEN 'NIL' THEN 'unplaced' WHEN 'SHT' THEN 'query_sheet' WHEN 'OPD' THEN 'operand' ELSE 'other' END AS role,
  CASE WHEN upper(laytp) = 'NIL' THEN 'unplaced' WHEN deftp = 'SHT' THEN CASE laytp WHEN 'ROW' THEN 'rows' WHEN 'COL' THEN 'columns' WHEN 'AGG' THEN 'free_characteristics' WHEN 'FLT' THEN 'structure_member' ELSE 'unknown' END
  WHEN deftp = 'SOB' THEN CASE laytp WHEN 'AGG' THEN 'filter' WHEN 'COL' THEN 'reference' WHEN 'ROW' THEN 'reference' ELSE 'unknown' END WHEN deftp = 'REP' AND upper(laytp) = 'SHT' THEN 'structural' ELSE 'unknown' END AS axis
FROM tree p JOIN element_xref x ON x.parent = p.element AND p.level < 10 JOIN tree c ON c.query = p.query AND c.element = x.child LEFT JOIN typed y ON y.element = x.parent""", _DEFINED, recursive=True)
def x15_placed_edges(spark, d):
    tree, xref, types, _ = _definition(spark, d)
    return definitions.placed_edges(tree, xref, types)


@query(_TREE + """,
own AS (SELECT * FROM element_ranges WHERE infoobject IN ('1CONDITION', '1EXCEPTION')),
per AS (SELECT element, min(CASE WHEN facet = '1STRUC' THEN low END) AS measure, min(CASE WHEN facet = '1VALUE' AND level = '00' THEN (upper(opt), low, lowflag) END) AS v, string_agg(DISTINCT CASE WHEN facet NOT IN ('1STRUC', '1VALUE') THEN facet END, ',' ORDER BY CASE WHEN facet NOT IN ('1STRUC', '1VALUE') THEN facet END) AS drill,
  string_agg(DISTINCT CASE WHEN level <> '00' THEN level END, ',' ORDER BY CASE WHEN level <> '00' THEN level END) AS levels FROM own GROUP BY element),
switched AS (SELECT element, bool_or(active = 'X') AS active FROM element_selects WHERE infoobject IN ('1CONDITION', '1EXCEPTION') GROUP BY element),
joined AS (SELECT t.query, t.element, type AS kind, active, CASE WHEN type = 'condition' THEN v[1] END AS operator, v, measure, drill, levels FROM tree t JOIN typed y ON y.element = t.element AND type IN ('condition', 'exception') LEFT JOIN per p ON p.element = t.element LEFT JOIN switched s ON s.element = t.element)
SELECT query, element, kind, coalesce(active, FALSE) AS active, operator, CASE operator WHEN 'EQ' THEN 'Equal: Single Value' WHEN 'BT' THEN 'Between: Range of Values' WHEN 'TC' THEN 'Top N (count)' END AS operator_label, CASE WHEN operator IN ('EQ', 'BT') THEN 'dictionary' WHEN operator IS NOT NULL THEN 'advisory' END AS confidence,
  CASE WHEN kind = 'condition' THEN v[2] END AS threshold, CASE WHEN kind = 'condition' THEN CASE v[3] WHEN '1' THEN 'literal' WHEN '2' THEN 'element_uid' WHEN '3' THEN 'variable_name' WHEN '4' THEN 'infoobject' WHEN '5' THEN 'constant' WHEN '6' THEN 'variable_name' ELSE 'unknown' END END AS threshold_holds, measure,
  CASE WHEN kind = 'exception' THEN coalesce(levels, '') END AS levels, coalesce(drill, '') AS drilldown FROM joined""", _DEFINED, recursive=True)
def z12_conditions(spark, d):
    tree, _, types, ranges = _definition(spark, d)
    return definitions.conditions(tree, types, ranges, view(spark, d, "element_selects"))


_HOPS = """,
rules AS (SELECT object, upper(field) AS field, source_object AS o, source_field AS f, rule_type AS r, by_routine AS a, from_datasource AS b, len(list_distinct(list(source_object) OVER (PARTITION BY object, upper(field)))) - 1 AS s FROM field_rules QUALIFY row_number() OVER (PARTITION BY object, upper(field) ORDER BY source_object, coalesce(source_field, ''), rule_type) = 1),
comps AS (SELECT *, len(list_distinct(list(o) OVER (PARTITION BY object, field))) - 1 AS s FROM (SELECT object, upper(field) AS field, CASE WHEN part_kind = 'calcview' THEN coalesce(runtime_view, part) ELSE part END AS o, source AS f, CASE WHEN mapping_kind = 'constant' THEN 'composite_constant' ELSE 'composite_mapping' END AS r, part_kind = 'datasource' AS b, part_kind = 'calcview' AS v FROM field_composites)
  QUALIFY row_number() OVER (PARTITION BY object, field ORDER BY o, coalesce(f, ''), r) = 1),
multis AS (SELECT object, upper(field) AS field, part AS o, part_field AS f, len(list_distinct(list(part) OVER (PARTITION BY object, upper(field)))) - 1 AS s FROM field_parts QUALIFY row_number() OVER (PARTITION BY object, upper(field) ORDER BY part, part_field) = 1),
navs AS (SELECT upper(field) AS field, characteristic AS o, attribute AS f FROM field_navigations WHERE characteristic <> ''), refs AS (SELECT object, base AS o FROM field_references WHERE base <> object),
starts AS (SELECT DISTINCT object, field FROM field_rules UNION SELECT object, field FROM field_composites UNION SELECT object, field FROM field_parts UNION SELECT 'O' || CAST(o_orderkey AS VARCHAR), 'FX' FROM orders WHERE o_orderkey % 7 = 0),
walk AS (SELECT object AS so, field AS sf, 1 AS level, object, field, [object || ':' || upper(field)] AS seen FROM starts UNION ALL SELECT so, sf, level + 1, o, f, list_append(seen, o || ':' || upper(f)) FROM (<step>) x WHERE stop IS NULL)"""
_STEP = """SELECT w.*, CASE WHEN u.object IS NOT NULL THEN 'transformation' WHEN c.object IS NOT NULL THEN 'composite_part' WHEN m.object IS NOT NULL THEN 'multiprovider_part' WHEN n.field IS NOT NULL THEN 'nav_attribute' WHEN e.object IS NOT NULL THEN 'reference_characteristic' END AS via,
  CASE WHEN u.object IS NOT NULL THEN u.o WHEN c.object IS NOT NULL THEN c.o WHEN m.object IS NOT NULL THEN m.o WHEN n.field IS NOT NULL THEN n.o ELSE e.o END AS o, CASE WHEN u.object IS NOT NULL THEN u.f WHEN c.object IS NOT NULL THEN c.f WHEN m.object IS NOT NULL THEN m.f WHEN n.field IS NOT NULL THEN n.f WHEN e.object IS NOT NULL THEN w.field END AS f,
  CASE WHEN u.object IS NOT NULL THEN u.r WHEN c.object IS NOT NULL THEN c.r WHEN m.object IS NOT NULL THEN 'multiprovider_identification' WHEN n.field IS NOT NULL THEN 'navigation_attribute' WHEN e.object IS NOT NULL THEN 'reference_characteristic' END AS r,
  CASE WHEN u.object IS NOT NULL THEN u.a WHEN coalesce(c.object, m.object, n.field, e.object) IS NOT NULL THEN FALSE END AS a, CASE WHEN u.object IS NOT NULL THEN u.s WHEN c.object IS NOT NULL THEN c.s WHEN m.object IS NOT NULL THEN m.s WHEN coalesce(n.field, e.object) IS NOT NULL THEN 0 END AS s,
  CASE WHEN coalesce(u.object, c.object, m.object, n.field, e.object) IS NULL THEN CASE WHEN level > 1 THEN 'chain_ends' WHEN w.object IN (SELECT object FROM multis) THEN 'not_identified' ELSE 'no_rule' END WHEN CASE WHEN u.object IS NOT NULL THEN u.b WHEN c.object IS NOT NULL THEN c.b ELSE FALSE END THEN 'datasource' WHEN u.object IS NULL AND c.v THEN 'calc_view'
  WHEN (CASE WHEN u.object IS NOT NULL THEN u.f WHEN c.object IS NOT NULL THEN c.f ELSE 'x' END) IS NULL THEN 'no_source'
  WHEN list_contains(seen, (CASE WHEN u.object IS NOT NULL THEN u.o WHEN c.object IS NOT NULL THEN c.o WHEN m.object IS NOT NULL THEN m.o WHEN n.field IS NOT NULL THEN n.o ELSE e.o END) || ':' || upper(CASE WHEN u.object IS NOT NULL THEN u.f WHEN c.object IS NOT NULL THEN c.f WHEN m.object IS NOT NULL THEN m.f WHEN n.field IS NOT NULL THEN n.f ELSE w.field END)) THEN 'cycle' WHEN level = 5 THEN 'too_deep' END AS stop
  FROM walk w LEFT JOIN rules u ON u.object = w.object AND u.field = upper(w.field) LEFT JOIN comps c ON c.object = w.object AND c.field = upper(w.field) LEFT JOIN multis m ON m.object = w.object AND m.field = upper(w.field) LEFT JOIN navs n ON n.field = upper(w.field) LEFT JOIN refs e ON e.object = w.object"""
_HOPS = _HOPS.replace("<step>", _STEP) + ",\nwalked AS (" + _STEP + ")"
_KINDS = ("field_rules", "field_composites", "field_parts", "field_navigations", "field_references")


def _field_walk(spark, d):
    rules, comps, parts, navs, refs = (view(spark, d, name) for name in _KINDS)
    odd = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("object"), F.lit("FX").alias("field"))
    starts = rules.select("object", "field").union(comps.select("object", "field")).union(parts.select("object", "field")).union(odd)
    return fields.field_hops(starts, fields.hop_tables(rules, comps, parts, navs, refs), depth=5)


@query(_HOPS + "\nSELECT so AS start_object, sf AS start_field, level, object, field, via, o AS next_object, f AS next_field, r AS rule_type, a AS advisory, s AS siblings, stop FROM walked", _KINDS, recursive=True)
def z30_field_hops(spark, d):
    return _field_walk(spark, d)


@query(_HOPS + """
SELECT so AS start_object, sf AS start_field, count(via) AS hops, coalesce(string_agg(via, '>' ORDER BY level), '') AS kinds, arg_max(CASE WHEN via IS NULL THEN object ELSE o END, level) AS end_object,
  max_by(CASE WHEN via IS NULL THEN [field] ELSE [f] END, level)[1] AS end_field, arg_max(stop, level) AS stop, arg_max(stop, level) = 'datasource' AS reaches_datasource, coalesce(bool_or(a), FALSE) AS by_routine FROM walked GROUP BY 1, 2""", _KINDS, recursive=True)
def z31_field_paths(spark, d):
    return fields.field_paths(_field_walk(spark, d))


_BASIC = """,
each AS (SELECT name, CASE WHEN base = '' THEN name ELSE base END AS base FROM characteristics),
chain AS (SELECT name, base AS tip, [name] AS seen FROM each UNION ALL SELECT c.name, e.base, list_append(c.seen, c.tip) FROM chain c JOIN each e ON e.name = c.tip WHERE e.base <> c.tip AND NOT list_contains(c.seen, c.tip)),
finals AS (SELECT name, arg_max(tip, len(seen)) AS tip FROM chain GROUP BY name),
basics AS (SELECT f.name AS characteristic, CASE WHEN e.base = f.name THEN 'basic' WHEN x.name IS NULL THEN 'dangling' WHEN x.base = x.name THEN 'reference' ELSE 'cycle' END AS status, CASE WHEN x.name IS NOT NULL AND x.base <> x.name THEN f.name ELSE f.tip END AS basic FROM finals f JOIN each e ON e.name = f.name LEFT JOIN each x ON x.name = f.tip)"""


@query(_BASIC + "\nSELECT characteristic, basic, status FROM basics", ("characteristics",), recursive=True)
def z3_basic_characteristics(spark, d):
    return characteristics.basic_characteristics(view(spark, d, "characteristics"))


_ATTRIBUTES = _BASIC + """,
navs AS (SELECT characteristic, attribute, min(nullif(trim(name), '')) AS navigation_name, bool_or(upper(auth_relevant) = 'X') AS auth_relevant, bool_or(upper(text_from_characteristic) = 'X') AS text_from, bool_or(transitive = 'X') AS transitive FROM attribute_navigations GROUP BY 1, 2),
found AS (SELECT b.characteristic, a.attribute, CASE WHEN upper(a.kind) = 'NAV' THEN 'navigation' ELSE 'display' END AS kind, a.position, a.time_dependent = '1' AS time_dependent, a.hidden = 'X' AS hidden, navigation_name, navigation_name IS NOT NULL AS navigable, coalesce(auth_relevant, FALSE) AS auth_relevant,
  coalesce(text_from, FALSE) AS text_from_characteristic, coalesce(n.transitive, FALSE) AS transitive, CASE WHEN b.basic <> b.characteristic THEN b.basic END AS inherited_from, status FROM basics b JOIN attributes a ON a.characteristic = b.basic LEFT JOIN navs n ON n.characteristic = b.characteristic AND n.attribute = a.attribute)"""


@query(_ATTRIBUTES + "\nSELECT * FROM found", ("characteristics", "attributes", "attribute_navigations"), recursive=True)
def z3_inherited_attributes(spark, d):
    return characteristics.attributes(view(spark, d, "characteristics"), view(spark, d, "attributes"), view(spark, d, "attribute_navigations"))


@query(_ATTRIBUTES + "\nSELECT characteristic, count(*) AS attributes, string_agg(DISTINCT attribute, ',' ORDER BY attribute) AS names FROM found WHERE kind = 'navigation' AND NOT navigable GROUP BY characteristic", ("characteristics", "attributes", "attribute_navigations"), recursive=True)
def z4_lost_navigations(spark, d):
    return characteristics.lost_navigations(z3_inherited_attributes(spark, d))


@query("""
, way AS (SELECT area, parent AS up, [area] AS w FROM areas UNION ALL SELECT y.area, a.parent, list_append(y.w, a.area) FROM way y JOIN areas a ON a.area = y.up WHERE NOT list_contains(y.w, y.up)),
last AS (SELECT area, arg_max(up, len(w)) AS up, arg_max(w, len(w)) AS w FROM way GROUP BY area),
known AS (SELECT l.area, a.parent, CASE WHEN up = '' THEN 'placed' WHEN list_contains(w, up) THEN 'cycle' ELSE 'dangling' END AS status, CASE WHEN up = '' THEN array_to_string(list_reverse(w), '/') END AS path, CASE WHEN up = '' THEN CAST(len(w) - 1 AS INTEGER) END AS level,
  CASE WHEN up <> '' AND NOT list_contains(w, up) THEN list_append(w, up) ELSE w END AS w FROM last l JOIN areas a USING (area)),
own AS (SELECT trim(area) AS area, count(*) FILTER (WHERE family = 'adso') AS own_adso, count(*) FILTER (WHERE family = 'infocube') AS own_infocube, count(*) FILTER (WHERE family = 'dso') AS own_dso, count(*) AS own FROM area_members GROUP BY 1),
above AS (SELECT x AS area, sum(own) AS below FROM (SELECT unnest(w) AS x, own FROM known JOIN own USING (area)) GROUP BY 1),
every AS (SELECT area, parent, path, level, status FROM known UNION ALL SELECT area, NULL, NULL, NULL, CASE WHEN area = '' THEN 'unassigned' ELSE 'unresolved' END FROM own WHERE area NOT IN (SELECT area FROM areas))
SELECT area, parent, path, level, status, coalesce(own_adso, 0) AS own_adso, coalesce(own_infocube, 0) AS own_infocube, coalesce(own_dso, 0) AS own_dso, coalesce(own, 0) AS own, CAST(coalesce(below, own, 0) AS BIGINT) AS below FROM every LEFT JOIN own USING (area) LEFT JOIN above USING (area)""", ("areas", "area_members"), recursive=True)
def a19_area_tree(spark, d):
    return governance.area_tree(view(spark, d, "areas"), view(spark, d, "area_members"), ["adso", "infocube", "dso"])


_EVIDENCE = """,
summary AS (SELECT answer, count(*) FILTER (WHERE basis = 'observed') AS observed, count(*) FILTER (WHERE basis = 'derived') AS derived, count(*) FILTER (WHERE basis = 'inferred') AS inferred, count(*) FILTER (WHERE basis NOT IN ('observed', 'derived', 'inferred')) AS unknown, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM answer_facts GROUP BY answer)"""
_CONFIDENCE = _EVIDENCE + """,
per AS (SELECT answer, count(*) FILTER (WHERE status <> 'not_applicable') AS sections, count(*) FILTER (WHERE status IN ('complete', 'empty')) AS complete, count(*) FILTER (WHERE status = 'unsupported') AS unsupported, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped_budget') AS skipped,
  ['failed', 'unsupported', 'skipped_budget', 'empty', 'complete', 'not_applicable'][min(list_position(['failed', 'unsupported', 'skipped_budget', 'empty', 'complete', 'not_applicable'], status))] AS worst FROM answer_sections GROUP BY answer),
loose AS (SELECT answer, count(*) FILTER (WHERE advisory) AS advisory FROM answer_relations GROUP BY answer),
confidence AS (SELECT answer, CASE WHEN unsupported + failed + skipped = 0 THEN CASE WHEN coalesce(advisory, 0) > 0 THEN 'medium' ELSE 'high' END WHEN 2 * (unsupported + failed + skipped) >= greatest(1, sections) THEN 'low' ELSE 'medium' END AS level, worst, sections, complete, unsupported, failed, skipped, coalesce(advisory, 0) AS advisory,
  coalesce(observed, 0) AS observed, coalesce(derived, 0) AS derived, coalesce(inferred, 0) AS inferred, coalesce(unknown, 0) AS unknown FROM per LEFT JOIN loose USING (answer) LEFT JOIN summary USING (answer))"""
_ANSWERS = ("answer_sections", "answer_relations", "answer_facts")


@query(_EVIDENCE + "\nSELECT answer, observed, derived, inferred, unknown, inferred + unknown AS advisory, methods FROM summary", ("answer_facts",))
def a25_evidence_summary(spark, d):
    return evidence.evidence_summary(view(spark, d, "answer_facts"))


@query(_CONFIDENCE + "\nSELECT * FROM confidence", _ANSWERS)
def c17_confidence(spark, d):
    return evidence.confidence(*(view(spark, d, name) for name in _ANSWERS))


@query(_CONFIDENCE + """
SELECT answer, 'sections_unavailable_on_release' AS reason, unsupported AS count FROM confidence WHERE unsupported > 0 UNION ALL SELECT answer, 'sections_not_readable', failed FROM confidence WHERE failed > 0 UNION ALL SELECT answer, 'sections_not_read_for_budget', skipped FROM confidence WHERE skipped > 0
UNION ALL SELECT answer, 'relationships_derived_not_declared', advisory FROM confidence WHERE advisory > 0 UNION ALL SELECT answer, 'everything_read_and_declared', 0 FROM confidence WHERE unsupported + failed + skipped + advisory = 0""", _ANSWERS)
def c17_reasons(spark, d):
    return evidence.reasons(c17_confidence(spark, d))


_READS = """,
based AS (SELECT DISTINCT dependent AS view, base, dependency_type AS kind, CASE WHEN regexp_matches(base, 'bw2hana[.]query[.]') THEN '?' WHEN regexp_matches(base, 'bw2hana[.][a-z]+/') THEN '/' || upper(regexp_extract(base, 'bw2hana[.]([a-z]+)/', 1)) || '/' || string_split(base, '/')[-1] WHEN contains(base, 'bw2hana/') THEN string_split(base, '/')[-1] END AS provider FROM object_dependencies WHERE dependent <> base),
by_view AS (SELECT b.view, b.kind, b.provider, c.kind AS provider_kind, b.base AS via, TRUE AS confirmed FROM based b JOIN provider_catalogue c ON c.name = b.provider),
readings AS (SELECT DISTINCT base, 1 AS k, regexp_extract(base, '^/BIC/A(.+)00$', 1) AS name, 'dso' AS kind FROM based WHERE base LIKE '/BIC/A%00' UNION SELECT DISTINCT base, 4, regexp_extract(base, '^/BIC/A(.+)$', 1), 'adso' FROM based WHERE base LIKE '/BIC/A%'
  UNION SELECT DISTINCT base, 1, '0' || regexp_extract(base, '^/BI0/P(.+)$', 1), 'infoobject' FROM based WHERE base LIKE '/BI0/P%' UNION SELECT DISTINCT base, 2, regexp_extract(base, '^/BI0/P(.+)$', 1), 'infoobject' FROM based WHERE base LIKE '/BI0/P%'),
read AS (SELECT r.*, c.name IS NOT NULL AS confirmed FROM readings r LEFT JOIN provider_catalogue c ON c.name = r.name AND c.kind = r.kind QUALIFY row_number() OVER (PARTITION BY base ORDER BY (c.name IS NOT NULL) DESC, k) = 1),
by_table AS (SELECT b.view, b.kind, r.name AS provider, r.kind AS provider_kind, b.base AS via, r.confirmed FROM based b JOIN read r ON r.base = b.base),
reads AS (SELECT * FROM (SELECT * FROM by_view UNION ALL SELECT * FROM by_table) QUALIFY row_number() OVER (PARTITION BY view, kind, provider ORDER BY confirmed DESC, via, provider_kind) = 1)"""


@query(_READS + """,
chosen AS (SELECT *, CASE kind WHEN 1 THEN 'direct' ELSE 'transitive' END AS route FROM reads r WHERE kind = 1 OR view NOT IN (SELECT view FROM reads WHERE kind = 1))
SELECT view, provider, provider_kind, via, confirmed, route, count(*) OVER (PARTITION BY view) AS providers, count(*) OVER (PARTITION BY view) > 7 AS truncated FROM chosen QUALIFY row_number() OVER (PARTITION BY view ORDER BY provider) <= 7""", ("object_dependencies", "provider_catalogue"))
def z6_view_providers(spark, d):
    return dependencies.view_providers(view(spark, d, "object_dependencies"), view(spark, d, "provider_catalogue"), most=7)


@query(_READS + """,
used AS (SELECT DISTINCT provider, CASE WHEN contains(view, 'bw2hana/') THEN string_split(view, '/')[-1] ELSE view END AS consumer, CASE WHEN contains(view, 'bw2hana/') THEN 'provider' ELSE 'calcview' END AS consumer_kind FROM reads)
SELECT provider, consumer, consumer_kind, count(*) OVER (PARTITION BY provider) AS consumers, count(*) OVER (PARTITION BY provider) > 50 AS truncated FROM used WHERE provider <> consumer QUALIFY row_number() OVER (PARTITION BY provider ORDER BY consumer) <= 50""", ("object_dependencies", "provider_catalogue"))
def g13_provider_consumers(spark, d):
    return dependencies.provider_consumers(view(spark, d, "object_dependencies"), view(spark, d, "provider_catalogue"))


@query(_READS + "\nSELECT view, count(DISTINCT provider) AS providers FROM reads WHERE confirmed GROUP BY view", ("object_dependencies", "provider_catalogue"))
def s7_warehouse_views(spark, d):
    return dependencies.warehouse_views(view(spark, d, "object_dependencies"), view(spark, d, "provider_catalogue"))


def _two_snapshots(spark, d):
    """A store with a snapshot of each side; the second one lacks a family."""
    store = SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    for k, (name, side) in enumerate((("s1", "snapshot_left"), ("s2", "snapshot_right"))):
        rows = view(spark, d, side).where(f"id % 5 <> {k * 4 + 5 * (1 - k)}").select(F.concat(F.lit("B"), (F.col("id") % 5).cast("string")).alias("family"), F.col("id").cast("string").alias("name"), "f_status", "f_priority")
        store.put(name, diff.captured(rows, ["f_status", "f_priority"], None), "DEMO", dt.datetime(2024, 1, 1 + k))
    return store


@query("""
, l AS (SELECT 'B' || CAST(id % 5 AS VARCHAR) AS family, CAST(id AS VARCHAR) AS name, f_status, f_priority FROM snapshot_left), r AS (SELECT 'B' || CAST(id % 5 AS VARCHAR) AS family, CAST(id AS VARCHAR) AS name, f_status, f_priority FROM snapshot_right WHERE id % 5 <> 4)
SELECT family, name, CASE WHEN family NOT IN (SELECT family FROM r) OR family NOT IN (SELECT family FROM l) THEN 'not_comparable' WHEN l.f_status IS NULL THEN 'added' WHEN r.f_status IS NULL THEN 'removed' WHEN l.f_status <> r.f_status OR l.f_priority <> r.f_priority THEN 'changed' ELSE 'unchanged' END AS change
FROM l FULL JOIN r USING (family, name)""", ("snapshot_left", "snapshot_right"))
def s15_snapshot_compare(spark, d):
    return _two_snapshots(spark, d).compare("s1", "s2")


@query("""
SELECT 's2' AS snapshot_id, 'DEMO' AS system, count(*) AS objects, 'B0,B1,B2,B3' AS families, FALSE AS capped FROM snapshot_right WHERE id % 5 <> 4 UNION ALL SELECT 's1', 'DEMO', count(*), 'B0,B1,B2,B3,B4', FALSE FROM snapshot_left""", ("snapshot_left", "snapshot_right"))
def s15_snapshot_list(spark, d):
    return _two_snapshots(spark, d).list("DEMO").select("snapshot_id", "system", "objects", F.array_join("families", ",").alias("families"), "capped")
