"""Queries of the operators on transformation code."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import code, search
from cairn.plans.base import query
from cairn.plans.views import view

#: SQL's own reading of code: a list of tokens a line, and for each rule the places in it, stated here apart from the library.
_TOKENS = r"regexp_extract_all({}, '''[^'']*''|[A-Za-z0-9_/<>]+|=>|->|[^\sA-Za-z0-9_/<>]')"
_NAME, _PLAIN = "coalesce(regexp_full_match({}, '[A-Z0-9_/<>]+'), FALSE)", "coalesce(regexp_full_match({}, '[A-Z0-9_/]+'), FALSE)"


def _at(rule: str) -> str:
    return f"list_filter(range(1, len(t) + 1), lambda i: coalesce({rule}, FALSE))"


def _any(rule: str) -> str:
    return f"(len({_at(rule)}) > 0)"


def _is_table(x: str) -> str:
    return f"((starts_with({x}, '/BIC/') OR starts_with({x}, '/BI0/')) AND len({x}) > 5)"


_OPEN = _any("(t[i] = 'LOOP' AND t[i + 1] = 'AT') OR t[i] = 'DO' OR t[i] = 'WHILE'")
_CLOSE = _any("t[i] IN ('ENDLOOP', 'ENDDO', 'ENDWHILE')")
_SELECT = "list_contains(t, 'SELECT')"
_WRITE = _any(f"t[i] IN ('INSERT', 'UPDATE', 'MODIFY', 'DELETE') AND ({_is_table('t[i + 1]')} OR (t[i + 1] = 'FROM' AND {_is_table('t[i + 2]')}))")
_DELETE = _any(f"t[i] = 'DELETE' AND ((t[i + 1] = 'ADJACENT' AND t[i + 2] = 'DUPLICATES') OR ({_NAME.format('t[i + 1]')} AND t[i + 2] IN ('WHERE', 'INDEX', 'FROM')))")
_FIXED = "(list_contains(t, 'WHERE') AND " + _any("(starts_with(t[i], '''') AND len(t[i]) > 1) OR (t[i] = '=' AND regexp_matches(t[i + 1], '^[0-9]'))") + ")"
_EMPTY = "((t[i + {0}] = 'IS' AND t[i + {1}] = 'INITIAL') OR (t[i + {0}] = 'IS' AND t[i + {1}] = 'NOT' AND t[i + {2}] = 'INITIAL'))"
_TESTED = _at(f"{_NAME.format('t[i]')} AND ({_EMPTY.format(1, 2, 3)} OR (t[i + 1] = '[' AND t[i + 2] = ']' AND {_EMPTY.format(3, 4, 5)}))")
_COUNTED = _at(f"((t[i] = 'LINES' AND t[i + 1] = '(') OR (t[i] = 'DESCRIBE' AND t[i + 1] = 'TABLE')) AND {_NAME.format('t[i + 2]')}")
_FOR_ALL = _at("t[i] = 'FOR' AND t[i + 1] = 'ALL' AND t[i + 2] = 'ENTRIES' AND t[i + 3] = 'IN'")
_FUNCTION = _at("t[i] = 'CALL' AND t[i + 1] = 'FUNCTION' AND t[i + 2] IS NOT NULL")
_METHOD = _at(f"{_PLAIN.format('t[i]')} AND t[i + 1] IN ('=>', '->') AND {_PLAIN.format('t[i + 2]')} AND t[i + 3] = '('")
_PERFORM = _at(f"t[i] = 'PERFORM' AND {_NAME.format('t[i + 1]')}")
_READ = _at(f"t[i] IN ('FROM', 'JOIN') AND {_PLAIN.format('t[i + 1]')}")
_CODE = f""",
code AS (SELECT codeid, line_no, line, {_TOKENS.format('line')} AS t FROM (SELECT codeid, line_no, upper(CASE WHEN instr(line, '"') > 0 THEN substr(line, 1, instr(line, '"') - 1) ELSE line END) AS line FROM routine_lines WHERE NOT starts_with(ltrim(line), '*')))"""
_STATEMENTS = f""",
parts AS (SELECT codeid, line_no, string_split(line, '.') AS p, coalesce(sum(len(string_split(line, '.')) - 1) OVER (PARTITION BY codeid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM code),
pieces AS (SELECT codeid, line_no, before + k - 1 AS statement, k, p[k] AS piece FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM parts)),
statements AS (SELECT *, {_TOKENS.format('text')} AS t FROM (SELECT codeid, CAST(statement AS BIGINT) AS statement, min(line_no) AS first_line, string_agg(piece, ' ' ORDER BY line_no, k) AS text FROM pieces WHERE piece <> '' GROUP BY 1, 2))"""
_READS = _STATEMENTS + f""",
reads AS (SELECT codeid, table_name, min(first_line) AS first_line FROM (SELECT codeid, first_line, unnest(list_transform({_READ}, lambda i: t[i + 1])) AS table_name FROM statements WHERE {_SELECT}) WHERE table_name <> 'TABLE' GROUP BY 1, 2)"""
_DEPTH = f""",
steps AS (SELECT *, CAST({_OPEN} AS INT) AS o, CAST({_CLOSE} AS INT) AS c FROM code),
total AS (SELECT *, sum(o - c) OVER (PARTITION BY codeid ORDER BY line_no) AS total FROM steps),
depths AS (SELECT codeid, line_no, line, t, o, c, CAST(total - least(0, min(total) OVER (PARTITION BY codeid ORDER BY line_no)) AS BIGINT) AS depth FROM total)"""
_PATTERNS = _DEPTH + f""",
guards AS (SELECT DISTINCT codeid, unnest(list_transform({_TESTED}, lambda i: t[i]) || list_transform({_COUNTED}, lambda i: t[i + 2])) AS guarded FROM code),
drivers AS (SELECT codeid, unnest(list_transform({_FOR_ALL}, lambda i: CASE WHEN t[i + 4] = '@' AND t[i + 5] = '(' THEN t[i + 6] WHEN t[i + 4] IN ('@', '(') THEN t[i + 5] ELSE t[i + 4] END)) AS driver FROM code),
found AS (SELECT codeid, 'nested_loop' AS pattern FROM depths WHERE o = 1 AND depth + c >= 2 UNION ALL SELECT codeid, 'select_in_loop' FROM depths WHERE {_SELECT} AND depth > 0
  UNION ALL SELECT codeid, 'database_modification' FROM depths WHERE {_WRITE} UNION ALL SELECT codeid, 'recordset_delete' FROM depths WHERE {_DELETE} AND NOT {_WRITE}
  UNION ALL SELECT codeid, 'hardcoded_value' FROM depths WHERE {_FIXED}
  UNION ALL SELECT codeid, 'missing_for_all_entries' FROM drivers d WHERE {_NAME.format('driver')} AND driver NOT IN ('C_T_DATA', 'I_T_DATA', 'I_DATA', 'SOURCE_PACKAGE', 'RESULT_PACKAGE', '<SOURCE_FIELDS>', '<RESULT_FIELDS>')
    AND NOT EXISTS (SELECT 1 FROM guards g WHERE g.codeid = d.codeid AND g.guarded = d.driver))"""
_CALLS = f""",
called AS (SELECT codeid, t[list_min({_FUNCTION}) + 2] AS f, list_min({_METHOD}) AS m, list_min({_PERFORM}) AS p, t FROM code),
refs AS (SELECT codeid, CASE WHEN starts_with(f, '''') THEN 'function_module' ELSE 'dynamic' END AS call_kind, CASE WHEN starts_with(f, '''') THEN f[2:len(f) - 1] ELSE '(dynamic)' END AS name FROM called WHERE f IS NOT NULL
  UNION ALL SELECT codeid, 'class_method', t[m] || t[m + 1] || t[m + 2] FROM called WHERE m IS NOT NULL UNION ALL SELECT codeid, 'form', t[p + 1] FROM called WHERE p IS NOT NULL)"""
_FORMS = f""",
raw AS (SELECT *, {_TOKENS.format('upper(line)')} AS t, coalesce({_TOKENS.format('upper(line)')}[1] = 'ENDFORM', FALSE) AS ends FROM routine_lines),
numbered AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY codeid ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM raw),
opened AS (SELECT codeid, part, min(line_no) AS opened, arg_min(t[2], line_no) AS form FROM numbered WHERE t[1] = 'FORM' AND {_NAME.format('t[2]')} GROUP BY 1, 2),
closed AS (SELECT codeid, part FROM numbered GROUP BY 1, 2 HAVING bool_or(ends)),
firsts AS (SELECT codeid, part, form, opened FROM opened JOIN closed USING (codeid, part) QUALIFY row_number() OVER (PARTITION BY codeid, form ORDER BY part) = 1),
bodies AS (SELECT n.codeid, form, line_no, line FROM numbered n JOIN firsts f ON n.codeid = f.codeid AND n.part = f.part WHERE line_no > opened AND NOT ends)"""
_PERFORMED = _STATEMENTS + f""",
named AS (SELECT codeid, statement, t[k + 1] AS form, k AS nth FROM (SELECT codeid, statement, t, unnest({_PERFORM}) AS k FROM statements WHERE NOT {_any("t[i] = 'IN' AND t[i + 1] = 'PROGRAM'")})),
performed AS (SELECT codeid, form, row_number() OVER (PARTITION BY codeid ORDER BY min((statement, nth))) AS place FROM named GROUP BY codeid, form)"""


def _lines(spark, d):
    return view(spark, d, "routine_lines")


@query(_CODE + "\nSELECT codeid, line_no, line FROM code", ("routine_lines",))
def t1_stripped_code(spark, d):
    return code.stripped(_lines(spark, d)).select("codeid", "line_no", "line")


@query(_CODE + _DEPTH + "\nSELECT codeid, line_no, line, depth FROM depths", ("routine_lines",))
def w7_loop_depth(spark, d):
    return code.loop_depths(_lines(spark, d)).select("codeid", "line_no", "line", "depth")


@query(_CODE + _PATTERNS + "\nSELECT codeid, pattern, count(*) AS occurrences FROM found GROUP BY codeid, pattern", ("routine_lines",))
def t3_code_patterns(spark, d):
    return code.patterns(_lines(spark, d))


@query(_CODE + _READS + "\nSELECT codeid, table_name, first_line FROM reads", ("routine_lines",))
def t2_table_reads(spark, d):
    return code.table_reads(_lines(spark, d))


@query(_CODE + _CALLS + "\nSELECT codeid, call_kind, name, count(*) AS calls FROM refs GROUP BY 1, 2, 3", ("routine_lines",))
def t4_calls(spark, d):
    return code.calls(_lines(spark, d))


@query(_CODE + _READS + _PATTERNS + _CALLS + f"""
SELECT codeid, lines, coalesce(loops, 0) AS loops, coalesce(nesting, 0) AS nesting, coalesce(selects, 0) AS selects, coalesce(calls, 0) AS calls, coalesce(tables, 0) AS tables, coalesce(patterns, 0) AS patterns
FROM (SELECT codeid, count(*) AS lines FROM routine_lines GROUP BY 1) s LEFT JOIN (SELECT codeid, sum(o)::BIGINT AS loops, max(CASE WHEN o = 1 THEN depth + c END)::BIGINT AS nesting, count(*) FILTER (WHERE {_SELECT}) AS selects FROM depths GROUP BY 1) h USING (codeid)
LEFT JOIN (SELECT codeid, count(*) AS calls FROM refs GROUP BY 1) r USING (codeid) LEFT JOIN (SELECT codeid, count(*) AS tables FROM reads GROUP BY 1) t USING (codeid) LEFT JOIN (SELECT codeid, count(*) AS patterns FROM found GROUP BY 1) f USING (codeid)""", ("routine_lines",))
def t5_routine_analysis(spark, d):
    return code.analysis(_lines(spark, d))


@query(_CODE + _PERFORMED + _FORMS + """
SELECT p.codeid, p.form, b.lines IS NOT NULL AS defined, coalesce(b.lines, 0) AS lines FROM performed p LEFT JOIN (SELECT codeid, form, count(*) AS lines FROM bodies GROUP BY 1, 2) b ON b.codeid = p.codeid AND b.form = p.form""", ("routine_lines",))
def t6_followed_forms(spark, d):
    return code.followed_forms(_lines(spark, d))


@query(_CODE + _FORMS + "\nSELECT codeid, form, line_no, line FROM bodies", ("routine_lines",))
def w8_form_lines(spark, d):
    return code.form_lines(_lines(spark, d))


@query(_CODE + _PERFORMED + "\nSELECT codeid, form, place FROM performed", ("routine_lines",))
def w6_first_appearance(spark, d):
    return code.performed(_lines(spark, d))


@query(_CODE + _PATTERNS + """,
sizes AS (SELECT codeid, count(*) AS lines FROM routine_lines GROUP BY codeid), largest AS (SELECT codeid FROM sizes ORDER BY lines DESC, codeid LIMIT 100), hits AS (SELECT codeid, count(*) AS n FROM found GROUP BY codeid)
SELECT codeid, lines, CASE WHEN l.codeid IS NOT NULL THEN coalesce(n, 0) END AS patterns, l.codeid IS NOT NULL AS analysed FROM (SELECT codeid, lines FROM sizes) s LEFT JOIN (SELECT codeid FROM largest) l USING (codeid) LEFT JOIN hits USING (codeid)
ORDER BY patterns DESC NULLS LAST, lines DESC, codeid LIMIT 50""".replace("l.codeid IS NOT NULL", "codeid IN (SELECT codeid FROM largest)").replace(" LEFT JOIN (SELECT codeid FROM largest) l USING (codeid)", ""), ("routine_lines",))
def c18_routine_register(spark, d):
    return code.register(_lines(spark, d), 50)


@query(_CODE + _PATTERNS + """
SELECT 'routines' AS measure, count(DISTINCT codeid) AS value FROM routine_lines UNION ALL SELECT 'lines', count(*) FROM routine_lines UNION ALL SELECT pattern, count(*) FROM found GROUP BY pattern""", ("routine_lines",))
def a16_portfolio_totals(spark, d):
    return code.portfolio(_lines(spark, d))


_RESOLVED = """,
names AS (SELECT DISTINCT table_name FROM reads),
split AS (SELECT table_name, regexp_extract(table_name, '^(/[^/]+/)', 1) AS ns, substr(regexp_extract(table_name, '^/[^/]+/(.+)$', 1), 1, 1) AS cls, substr(regexp_extract(table_name, '^/[^/]+/(.+)$', 1), 2) AS rest FROM names),
readings AS (SELECT table_name, ns, 1 AS k, left(rest, len(rest) - 2) AS name, 'dso' AS kind, 'active' AS role FROM split WHERE cls = 'A' AND ends_with(rest, '00') AND len(rest) > 2
  UNION ALL SELECT table_name, ns, 2, left(rest, len(rest) - 2), 'dso', 'inbound' FROM split WHERE cls = 'A' AND ends_with(rest, '40') AND len(rest) > 2
  UNION ALL SELECT table_name, ns, 3, left(rest, len(rest) - 1), 'adso', CASE right(rest, 1) WHEN '1' THEN 'inbound' WHEN '2' THEN 'active' ELSE 'changelog' END FROM split WHERE cls = 'A' AND right(rest, 1) IN ('1', '2', '3')
  UNION ALL SELECT table_name, ns, 4, rest, 'adso', 'active' FROM split WHERE cls = 'A' UNION ALL SELECT table_name, ns, 5, rest, 'dso', 'active' FROM split WHERE cls = 'A' UNION ALL SELECT table_name, ns, 6, rest, 'infoobject', 'master_attr' FROM split WHERE cls = 'P'),
spelled AS (SELECT table_name, k, 1 AS f, CASE WHEN ns = '/BI0/' THEN '0' || name ELSE name END AS name, kind, role FROM readings UNION ALL SELECT table_name, k, 2, name, kind, role FROM readings WHERE ns = '/BI0/'),
ranked AS (SELECT s.*, p.name IS NOT NULL AS known FROM spelled s LEFT JOIN (SELECT DISTINCT name, kind FROM providers) p ON p.name = s.name AND p.kind = s.kind),
resolved AS (SELECT n.table_name, r.name AS object, r.kind, r.role, coalesce(r.known, FALSE) AS confirmed FROM names n LEFT JOIN (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY known DESC, k, f) = 1) r USING (table_name))"""


@query(_CODE + _READS + _RESOLVED + "\nSELECT table_name, object, kind, role, confirmed FROM resolved", ("routine_lines", "providers"))
def j18_resolved_tables(spark, d):
    return search.resolved_tables(code.table_reads(_lines(spark, d)), view(spark, d, "providers"))


@query(_CODE + _READS + _RESOLVED + "\nSELECT object, kind, count(DISTINCT codeid) AS routines, min(codeid) AS first_routine FROM reads JOIN resolved USING (table_name) WHERE object IS NOT NULL GROUP BY 1, 2", ("routine_lines", "providers"))
def g9_routine_consumers(spark, d):
    reads = code.table_reads(_lines(spark, d))
    objects = search.resolved_tables(reads, view(spark, d, "providers")).where("object IS NOT NULL")
    return reads.join(objects, "table_name").groupBy("object", "kind").agg(F.countDistinct("codeid").alias("routines"), F.min("codeid").alias("first_routine"))
