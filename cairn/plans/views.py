"""Tables shaped like a warehouse's own catalogue, derived from the star schema and the event log by text both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP))", "duckdb": "epoch_us(ts)"}

#: A link of each order within its block of 16 numbers, and a second one of urgent orders: graphs grow with the table, while what a node
#: reaches stays small enough for DuckDB's recursive queries.
_ORDERED = "SELECT o_orderkey AS s, CAST(FLOOR(o_orderkey / 16) AS BIGINT) * 16 + o_custkey % 16 AS d FROM <orders>"
_LINKS = _ORDERED + " UNION ALL SELECT o_orderkey, CAST(FLOOR(o_orderkey / 16) AS BIGINT) * 16 + CAST(FLOOR(o_custkey / 16) AS BIGINT) % 16 FROM <orders> WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
_KIND = "CASE WHEN ? % 10 = 0 THEN 'HCPR' WHEN ? % 7 = 0 THEN 'IOBJ' WHEN ? % 3 = 0 THEN 'ADSO' ELSE 'ODSO' END"



def _map(target: str, source: str, kind: str = "") -> str:
    """A mapping of a stored model within a text that '...' || encloses."""
    return f"""<mapping xsi:type="Type:{kind}ElementMapping" targetName="{target}" sourceName="' || {source} || '"/>"""


#: log_chain brings events forward by some days to shape daily, weekly and monthly chains; every view holds all rows of its table, or all of a kind.
VIEWS = {
    "log_chain": """SELECT CAST(user_id AS STRING) AS chain_id, event_id AS log_id, CAST(ts AS DATE) - early AS run_day, <micros> - CAST(early AS BIGINT) * 86400000000 AS start_us, CASE WHEN event_type = 'error' THEN 'R' ELSE 'G' END AS status
FROM (SELECT *, CAST(CASE user_id % 6 WHEN 1 THEN (EXTRACT(DAY FROM ts) - 1) % 7 WHEN 2 THEN CASE WHEN EXTRACT(DAY FROM ts) < 29 THEN EXTRACT(DAY FROM ts) - 1 ELSE EXTRACT(DAY FROM ts) - 29 END WHEN 3 THEN EXTRACT(DAY FROM ts) % 3
WHEN 4 THEN EXTRACT(DAY FROM ts) - 1 ELSE 0 END AS INT) AS early FROM <events>) e""",
    "process_log": """SELECT CAST(user_id AS STRING) AS chain_id, CAST(user_id AS STRING) || '|' || CAST(CAST(ts AS DATE) AS STRING) AS log_id, event_type AS step_type, CAST(event_id % 7 AS STRING) AS variant,
CASE event_type WHEN 'error' THEN 'R' WHEN 'view' THEN 'S' WHEN 'signup' THEN 'F' ELSE 'G' END AS state, <micros> AS start_us,
CASE WHEN event_id % 11 = 0 THEN NULL ELSE <micros> + CAST(FLOOR(value * 60000000) AS BIGINT) END AS end_us FROM <events>""",
    "transformation": f"""SELECT DISTINCT 'N' || CAST(s AS STRING) AS src, 'N' || CAST(d AS STRING) AS dst, {_KIND.replace("?", "s")} AS src_type, {_KIND.replace("?", "d")} AS dst_type FROM ({_LINKS}) e""",
    "transformation_dag": f"SELECT DISTINCT LEAST(s, d) AS src, GREATEST(s, d) AS dst, {_KIND.replace('?', 'LEAST(s, d)')} AS src_type, {_KIND.replace('?', 'GREATEST(s, d)')} AS dst_type FROM ({_LINKS}) e WHERE s <> d",
    "transformation_header": f"""SELECT s AS tranid, 'N' || CAST(s AS STRING) AS src, 'N' || CAST(d AS STRING) AS dst, {_KIND.replace("?", "s")} AS src_type, {_KIND.replace("?", "d")} AS dst_type,
CASE WHEN s % 4 = 0 THEN 'S' || CAST(s AS STRING) ELSE '' END AS startroutine, CASE WHEN s % 6 = 1 THEN 'E' || CAST(s AS STRING) ELSE '' END AS endroutine, CASE WHEN s % 11 = 5 THEN 'X' || CAST(s AS STRING) ELSE '' END AS expert,
CASE WHEN s % 9 = 2 THEN 'M' ELSE 'A' END AS version FROM ({_ORDERED}) e""",
    "lookups": "SELECT DISTINCT l_orderkey AS tranid, 'N' || CAST(CAST(FLOOR(l_orderkey / 16) AS BIGINT) * 16 + l_suppkey % 16 AS STRING) AS object FROM <lineitem> WHERE l_linestatus = 'O'",
    "rates": "SELECT 'N' || CAST(o_orderkey AS STRING) AS object, CAST(o_custkey % 5 AS DOUBLE) / 2 AS rate FROM <orders>",
    "dtp": """SELECT DISTINCT l_orderkey * 10 + l_linenumber AS dtp, 'N' || CAST(l_orderkey AS STRING) AS src, 'N' || CAST(CAST(FLOOR(l_orderkey / 16) AS BIGINT) * 16 + l_partkey % 16 AS STRING) AS tgt,
CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'D' ELSE 'I' END AS updmode FROM <lineitem>""",
    "chain_steps": """SELECT o_custkey AS chain_id, o_orderkey AS step_no,
CASE o_orderpriority WHEN '1-URGENT' THEN 'CHAIN' WHEN '2-HIGH' THEN 'DTP_LOAD' WHEN '3-MEDIUM' THEN 'ADSOACT' WHEN '4-NOT SPECIFIED' THEN 'ABAP' ELSE 'PSADELETE' END AS step_type,
CASE o_orderpriority WHEN '1-URGENT' THEN CAST(FLOOR(o_custkey / 8) AS BIGINT) * 8 + o_orderkey % 8 WHEN '2-HIGH' THEN o_orderkey * 10 + 1 ELSE NULL END AS variant FROM <orders>""",
    "routine_source": """SELECT user_id AS codeid, event_id AS line_no, CASE event_type WHEN 'click' THEN 'LOOP AT lt_data.' WHEN 'view' THEN 'ENDLOOP.'
WHEN 'signup' THEN 'SELECT * FROM /BIC/ADEMO' || CAST(event_id % 5 AS STRING) || '00 INTO TABLE lt_x WHERE a = ''1''.' WHEN 'purchase' THEN 'CALL FUNCTION ''DEMO_FM''.' ELSE '* select in a comment' END AS line FROM <events>""",
    "routine_lines": """SELECT user_id AS codeid, event_id AS line_no, CASE CAST(FLOOR(value * 100) AS BIGINT) % 29 WHEN 0 THEN '  LOOP AT lt_' || CAST(event_id % 3 AS STRING) || ' INTO ls.' WHEN 1 THEN '  ENDLOOP.' WHEN 2 THEN '  DO 5 TIMES.' WHEN 3 THEN '  ENDDO.'
WHEN 4 THEN '  SELECT a b' WHEN 5 THEN '    FROM /BIC/ADEMO' || CAST(event_id % 7 AS STRING) || '00 AS x' WHEN 6 THEN '    INNER JOIN /BI0/PMAT' || CAST(event_id % 5 AS STRING) || ' AS y ON x~k = y~k' WHEN 7 THEN '    INTO TABLE lt_r FOR ALL ENTRIES IN lt_' || CAST(event_id % 4 AS STRING)
WHEN 8 THEN '    WHERE k = lt_k-k.' WHEN 9 THEN '    WHERE land = ''DE''.' WHEN 10 THEN '  IF lt_' || CAST(event_id % 4 AS STRING) || '[] IS NOT INITIAL.' WHEN 11 THEN '  ENDIF.' WHEN 12 THEN '  DELETE lt_x WHERE k = 5.' WHEN 13 THEN '  DELETE ADJACENT DUPLICATES FROM lt_x.'
WHEN 14 THEN '  MODIFY /BIC/ADEMO' || CAST(event_id % 4 AS STRING) || '00 FROM ls.' WHEN 15 THEN '  CALL FUNCTION ''Z_FM_' || CAST(event_id % 6 AS STRING) || '''' WHEN 16 THEN '    EXPORTING i = 1.' WHEN 17 THEN '  CALL FUNCTION lv_name.' WHEN 18 THEN '  lo_x->get_' || CAST(event_id % 5 AS STRING) || '( ).'
WHEN 19 THEN '  PERFORM fill_' || CAST(event_id % 5 AS STRING) || ' USING a.' WHEN 20 THEN '  PERFORM far IN PROGRAM (lv_p).' WHEN 21 THEN '* SELECT nothing FROM /BIC/ANOTHING00.' WHEN 22 THEN '  x = y. "PERFORM never FROM here.' WHEN 23 THEN 'FORM fill_' || CAST(event_id % 5 AS STRING) || ' USING p.' WHEN 24 THEN 'ENDFORM.'
WHEN 25 THEN '  a = ''fixed''.' WHEN 26 THEN '  READ TABLE lt_x.' WHEN 27 THEN '  SELECT SINGLE t FROM zown_' || CAST(event_id % 3 AS STRING) || ' INTO lv WHERE k = 7.' ELSE '  ls-f = ls-g.' END AS line FROM <events>""",
    "providers": """SELECT 'DEMO' || CAST(p_partkey % 4 AS STRING) AS name, 'dso' AS kind FROM <part> UNION SELECT 'DEMO4' || CAST(p_partkey % 2 AS STRING), 'adso' FROM <part> UNION SELECT '0MAT' || CAST(p_partkey % 3 AS STRING), 'infoobject' FROM <part>""",
    "keyfigures": """SELECT 'K' || CAST(p_partkey AS STRING) AS name, CASE p_partkey % 4 WHEN 0 THEN 'MIN' WHEN 1 THEN 'SUM' WHEN 2 THEN '' ELSE 'NOP' END AS aggrgen,
CASE p_partkey % 7 WHEN 0 THEN 'LAS' WHEN 1 THEN 'AV0' WHEN 2 THEN 'SUM' WHEN 3 THEN 'ZZZ' ELSE '' END AS aggrexc, CASE p_size % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '9' ELSE '' END AS ncumfl FROM <part>""",
    "request_codes": """SELECT 'N' || CAST(o_custkey AS STRING) AS provider, o_orderkey AS rnr, CASE WHEN o_custkey % 4 = 0 THEN 'classic' ELSE 'tsn' END AS ledger, CASE o_orderkey % 17 WHEN 0 THEN '@08@' WHEN 1 THEN '@09@' WHEN 2 THEN '@0A@' WHEN 3 THEN 'GG' WHEN 4 THEN 'YG' WHEN 5 THEN 'Y' WHEN 6 THEN 'GR' WHEN 7 THEN 'U' WHEN 8 THEN 'N' WHEN 9 THEN 'RG'
WHEN 10 THEN 'RR' WHEN 11 THEN 'YR' WHEN 12 THEN 'D' WHEN 13 THEN 'M' WHEN 14 THEN '' WHEN 15 THEN 'X' ELSE '??' END AS code FROM <orders>""",
    "objects": """SELECT 'P_' || CAST(p_partkey AS STRING) AS name, p_type AS object_type, p_name AS text, CASE p_partkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'E' ELSE 'F' END AS langu, p_brand AS area FROM <part>""",
    "snapshot_left": "SELECT o_orderkey AS id, o_orderstatus AS f_status, o_orderpriority AS f_priority FROM <orders> WHERE o_orderkey % 10 <> 1",
    "snapshot_right": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS f_status, CASE WHEN o_orderkey % 13 = 0 THEN 'Z' ELSE o_orderpriority END AS f_priority
FROM <orders> WHERE o_orderkey % 10 <> 2""",
    "auth_values": """SELECT l_suppkey AS auth, l_returnflag || CAST(l_linenumber AS STRING) AS characteristic, CASE WHEN l_suppkey % 9 = 0 THEN '*' WHEN l_partkey % 17 = 0 THEN '$VAR' ELSE CAST(l_partkey AS STRING) END AS low
FROM <lineitem>""",
    "auth_user": "SELECT DISTINCT o_custkey AS auth, 'U' || CAST(o_orderkey % 1000 AS STRING) AS uname FROM <orders>",
    "info_area": """SELECT 'R' || CAST(r_regionkey AS STRING) AS area, '' AS parent, r_name AS txt FROM <region> UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING), n_name FROM <nation>
UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), 'N' || CAST(s_nationkey AS STRING), s_name FROM <supplier>""",
    "requests": """SELECT o_custkey AS provider, o_orderkey AS rnr, o_orderdate AS started, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'incomplete' ELSE 'error' END AS status FROM <orders>""",
    "volumes": """SELECT l_suppkey AS provider, CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'N' THEN 'changelog' ELSE 'inbound' END AS role, l_quantity AS records, l_extendedprice AS memory FROM <lineitem>""",
    "reports": "SELECT c_custkey AS report, CAST(c_custkey % 150 AS STRING) AS chain_id, (c_custkey * 37) % 1440 AS start_min FROM <customer>",
    "composite_models": f"""SELECT 'CP' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_partkey % 23 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN '<!DOCTYPE x [<!ENTITY e "a">]><Composite:compositeView name="D"/>' WHEN p_partkey % 17 = 0 THEN '<Composite:compositeView name="broken"><viewNode'
WHEN p_partkey % 29 = 0 THEN '<other name="x"/>' ELSE '<?xml version="1.0" encoding="UTF-8"?><Composite:compositeView xmlns:Composite="http://c" xmlns:View="http://v" xmlns:Type="http://t" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" name="CP"'
|| CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' defaultNode="#///TOP"' END || '><viewNode xsi:type="View:JoinNode" name="TOP"><element name="A"/><element name="Z"/><input alias="MID" selectAll="false"><viewNode xsi:type="View:JoinNode">#///MID</viewNode>{_map("A", "'B'")}{_map("Z", "'Y'")}</input>'
|| '<input alias="TOP.CALC.1"><entity>PKG/SUB/CV_' || CAST(p_partkey % 4 AS STRING) || '.calculationview#/</entity>{_map("a", "'C' || CAST(p_partkey % 3 AS STRING)")}</input></viewNode>'
|| '<viewNode xsi:type="View:JoinNode" name="MID"><input alias="U1"><viewNode xsi:type="View:Union">#///U1</viewNode>{_map("B", "'D'")}{_map("Y", "'NONE'")}</input><input alias="MID.IOBJ.1"><entity>$NS$CHA' || CAST(p_partkey % 6 AS STRING) || '.composite#//</entity>{_map("B", "'ignored'", "Constant")}</input></viewNode>'
|| '<viewNode xsi:type="View:Union" name="U1"><input alias="U1.ADSO.1"><entity>SALES_' || CAST(p_partkey % 7 AS STRING) || '.composite#//</entity>{_map("D", "'F' || CAST(p_partkey % 3 AS STRING)")}</input>'
|| '<input alias="U1.' || CASE p_partkey % 4 WHEN 0 THEN 'ODSO' WHEN 1 THEN 'FBPA' WHEN 2 THEN 'CUBE' ELSE 'HCPR' END || '.2"><entity>OTHER_' || CAST(p_partkey % 7 AS STRING) || '.composite#//</entity>{_map("D", "'G'")}</input>'
|| CASE WHEN p_partkey % 3 = 0 THEN '<input alias="TOP"><viewNode xsi:type="View:JoinNode">#///TOP</viewNode>{_map("D", "'A'")}</input>' ELSE '' END || CASE WHEN p_partkey % 7 = 1 THEN '<input alias="U1.ADSO.9"><entity>unreadable</entity>{_map("D", "'Q'")}</input>' ELSE '' END
|| CASE WHEN p_partkey % 11 = 1 THEN '<input alias="U1.ADSO.7"><entity>SALES_' || CAST(p_partkey % 7 AS STRING) || '.composite#//</entity>{_map("d", "'f' || CAST(p_partkey % 3 AS STRING)")}</input>' ELSE '' END || '</viewNode></Composite:compositeView>' END AS xml FROM <part>""",
    "exit_lines": """SELECT user_id AS codeid, event_id AS line_no, CASE CAST(FLOOR(value * 100) AS BIGINT) % 23 WHEN 0 THEN '  CASE i_datasource.' WHEN 1 THEN 'case lv_x.' WHEN 2 THEN '  WHEN ''DS_' || CAST(event_id % 6 AS STRING) || '''.' WHEN 3 THEN '  when ''DS_a'' OR '' ds_b ''.'
WHEN 4 THEN '  WHEN OTHERS.' WHEN 5 THEN '  ENDCASE.' WHEN 6 THEN 'endcase.' WHEN 7 THEN '  IF i_datasource = ''DS_X' || CAST(event_id % 4 AS STRING) || '''.' WHEN 8 THEN '* WHEN ''NO''.' WHEN 9 THEN '  CONCATENATE ''ZEX_'' i_datasource INTO lv_prog.' WHEN 10 THEN '  lv = |YEX_{ i_datasource }|.'
WHEN 11 THEN '  PERFORM go IN PROGRAM (lv_prog).' WHEN 12 THEN '  PERFORM go IN PROGRAM zfix.' WHEN 13 THEN '  x = y. "WHEN ''NO''.' WHEN 14 THEN '  CONCATENATE ''hello there'' i_datasource INTO lv_msg.' WHEN 15 THEN '  WHEN ''/NSP/DS_' || CAST(event_id % 3 AS STRING) || '''.'
WHEN 16 THEN '  lv = ''/PAR/X_'' && i_datasource.' ELSE '  ls-f = ls-g' || CAST(event_id % 9 AS STRING) || '.' END AS line FROM <events>""",
    "exit_programs": "SELECT 'ZEX_DS_' || CAST(p_partkey AS STRING) AS program FROM <part> WHERE p_partkey % 2 = 0 UNION SELECT 'YEX_DS_X' || CAST(p_partkey AS STRING) FROM <part>",
    "element_xref": """SELECT CASE WHEN o_orderkey % 1024 < 16 THEN o_orderkey - 1 ELSE CAST(FLOOR(o_orderkey / 1024) AS BIGINT) * 1024 + o_orderkey % 8 END AS parent, o_orderkey AS child,
CASE o_orderkey % 7 WHEN 0 THEN 'ROW' WHEN 1 THEN 'COL' WHEN 2 THEN 'AGG' WHEN 3 THEN 'FLT' WHEN 4 THEN 'NIL' WHEN 5 THEN 'sht' ELSE 'XYZ' END AS laytp, o_orderkey % 11 AS position FROM <orders> WHERE o_orderkey % 1024 <> 0
UNION ALL SELECT o_orderkey, CAST(FLOOR(o_orderkey / 1024) AS BIGINT) * 1024 + o_custkey % 8, 'OPD', 0 FROM <orders> WHERE o_orderkey % 97 = 5""",
    "element_directory": """SELECT o_orderkey AS element, CASE WHEN o_orderkey % 1024 = 0 THEN 'REP' ELSE CASE o_orderkey % 9 WHEN 1 THEN 'SHT' WHEN 2 THEN 'SOB' WHEN 3 THEN 'SEL' WHEN 4 THEN 'SEL' WHEN 5 THEN 'sel ' WHEN 6 THEN 'FML' WHEN 7 THEN 'STR' WHEN 8 THEN 'CKF' ELSE 'ZZZ' END END AS deftp,
CASE o_custkey % 6 WHEN 0 THEN 'CHA' WHEN 1 THEN 'RKF' WHEN 2 THEN 'CON' WHEN 3 THEN 'EXC' WHEN 4 THEN 'STM' ELSE '' END AS subdeftp FROM <orders>""",
    "element_selects": "SELECT l_orderkey AS element, CASE WHEN l_partkey % 5 = 0 THEN '1KYFNM' WHEN l_partkey % 5 = 1 THEN '1CONDITION' ELSE 'C' || CAST(l_suppkey % 10 AS STRING) END AS infoobject, CASE WHEN l_partkey % 2 = 0 THEN 'X' ELSE '' END AS active FROM <lineitem> WHERE l_linenumber < 3",
    "element_ranges": """SELECT l_orderkey AS element, CASE l_partkey % 6 WHEN 0 THEN '1CONDITION' WHEN 1 THEN '1EXCEPTION' WHEN 2 THEN '' ELSE 'C' || CAST(l_suppkey % 4 AS STRING) END AS infoobject, CASE l_suppkey % 3 WHEN 0 THEN '1STRUC' WHEN 1 THEN '1VALUE' ELSE 'C' || CAST(l_suppkey % 5 AS STRING) END AS facet,
'I' AS sign, CASE l_partkey % 4 WHEN 0 THEN 'EQ' WHEN 1 THEN 'tc' WHEN 2 THEN 'BC' ELSE 'BT' END AS opt, CAST(l_partkey % 7 AS STRING) AS low, CASE WHEN l_partkey % 4 = 3 THEN CAST(l_partkey % 3 AS STRING) ELSE ' ' END AS high, CAST(l_suppkey % 8 AS STRING) AS lowflag, CAST(l_partkey % 4 AS STRING) AS highflag,
CASE WHEN l_linenumber % 2 = 0 THEN '00' ELSE '0' || CAST(l_linenumber AS STRING) END AS level FROM <lineitem>""",
    "field_rules": """SELECT 'O' || CAST(o_orderkey AS STRING) AS object, 'F' || CAST(o_orderkey % 3 AS STRING) AS field, CASE WHEN o_orderkey % 11 = 0 THEN 'DS' || CAST(o_custkey AS STRING) ELSE 'O' || CAST(CAST(FLOOR(o_orderkey / 32) AS BIGINT) * 32 + o_custkey % 32 AS STRING) END AS source_object,
CASE WHEN o_orderkey % 13 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN 'nav' || CAST(o_custkey AS STRING) ELSE 'f' || CAST(o_custkey % 3 AS STRING) END AS source_field, CASE WHEN o_orderkey % 13 = 1 THEN 'constant' WHEN o_orderkey % 4 = 0 THEN 'routine' ELSE 'direct' END AS rule_type, o_orderkey % 4 = 0 AS by_routine, o_orderkey % 11 = 0 AS from_datasource
FROM <orders> WHERE o_orderkey % 6 IN (0, 1, 2)""",
    "field_composites": """SELECT 'O' || CAST(o_orderkey AS STRING) AS object, 'F' || CAST(o_custkey % 3 AS STRING) AS field, 'O' || CAST(CAST(FLOOR(o_orderkey / 32) AS BIGINT) * 32 + o_custkey % 32 AS STRING) AS part, CASE WHEN o_orderkey % 5 = 0 THEN 'calcview' WHEN o_orderkey % 7 = 0 THEN 'datasource' ELSE 'adso' END AS part_kind,
CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'F' || CAST(o_orderkey % 3 AS STRING) END AS source, CASE WHEN o_orderkey % 9 = 0 THEN 'constant' ELSE 'element' END AS mapping_kind, CASE WHEN o_orderkey % 10 = 0 THEN 'PKG/CV' || CAST(o_orderkey AS STRING) END AS runtime_view FROM <orders> WHERE o_orderkey % 6 IN (2, 3)""",
    "field_parts": "SELECT DISTINCT 'O' || CAST(l_orderkey AS STRING) AS object, 'F' || CAST(l_linenumber % 3 AS STRING) AS field, 'O' || CAST(CAST(FLOOR(l_orderkey / 32) AS BIGINT) * 32 + l_suppkey % 32 AS STRING) AS part, 'F' || CAST(l_partkey % 3 AS STRING) AS part_field FROM <lineitem> WHERE l_orderkey % 6 = 4 AND l_linenumber < 3",
    "field_navigations": "SELECT 'NAV' || CAST(c_custkey AS STRING) AS field, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'O' || CAST(c_custkey AS STRING) END AS characteristic, 'F' || CAST(c_custkey % 3 AS STRING) AS attribute FROM <customer>",
    "field_references": "SELECT 'O' || CAST(o_orderkey AS STRING) AS object, CASE WHEN o_orderkey % 4 = 1 THEN 'O' || CAST(o_orderkey AS STRING) ELSE 'O' || CAST(CAST(FLOOR(o_orderkey / 32) AS BIGINT) * 32 + o_custkey % 32 AS STRING) END AS base FROM <orders> WHERE o_orderkey % 3 = 2",
    "characteristics": """SELECT 'C' || CAST(c_custkey AS STRING) AS name, CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 41 = 1 THEN 'GONE' || CAST(c_custkey AS STRING) WHEN c_custkey % 37 = 5 THEN 'C' || CAST(c_custkey AS STRING) WHEN c_custkey % 53 = 3 THEN 'C' || CAST(c_custkey + 1 AS STRING) ELSE 'C' || CAST(c_custkey - 1 AS STRING) END AS base FROM <customer>""",
    "attributes": """SELECT DISTINCT CASE WHEN l_suppkey % 5 = 0 THEN 'GONE' ELSE 'C' END || CAST(l_orderkey % 1500 AS STRING) AS characteristic, 'A' || CAST(l_linenumber AS STRING) AS attribute, l_linenumber AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'nav' ELSE 'DIS' END AS kind,
CASE WHEN l_linenumber = 3 THEN '1' ELSE '0' END AS time_dependent, CASE WHEN l_linenumber = 5 THEN 'X' ELSE '' END AS hidden FROM <lineitem>""",
    "attribute_navigations": """SELECT DISTINCT 'C' || CAST(l_partkey % 1500 AS STRING) AS characteristic, 'A' || CAST(l_linenumber AS STRING) AS attribute, CASE WHEN l_linenumber = 6 THEN ' ' ELSE 'C' || CAST(l_partkey % 1500 AS STRING) || '__A' || CAST(l_linenumber AS STRING) END AS name,
CASE WHEN l_partkey % 3 = 0 THEN 'X' ELSE '' END AS auth_relevant, CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE '' END AS text_from_characteristic, '' AS transitive FROM <lineitem>""",
    "areas": """SELECT 'R' || CAST(r_regionkey AS STRING) AS area, '' AS parent FROM <region> UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), 'R' || CAST(n_regionkey AS STRING) FROM <nation> UNION ALL SELECT 'S' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 10 = 7 THEN 'S' || CAST(s_suppkey + 1 AS STRING)
WHEN s_suppkey % 10 = 8 THEN 'S' || CAST(s_suppkey - 1 AS STRING) WHEN s_suppkey % 10 = 9 THEN 'LOST' ELSE 'N' || CAST(s_nationkey AS STRING) END FROM <supplier>""",
    "area_members": "SELECT CASE p_partkey % 13 WHEN 0 THEN ' ' WHEN 1 THEN 'X' || CAST(p_size AS STRING) WHEN 2 THEN 'R1' WHEN 3 THEN 'N' || CAST(p_partkey % 25 AS STRING) ELSE 'S' || CAST(p_partkey % 11 AS STRING) END AS area, CASE p_size % 4 WHEN 0 THEN 'adso' WHEN 1 THEN 'infocube' WHEN 2 THEN 'dso' ELSE 'odd' END AS family FROM <part>",
    "answer_sections": """SELECT CAST(user_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) AS answer, event_id AS section, CASE WHEN user_id % 5 = 0 THEN CASE event_type WHEN 'view' THEN 'complete' ELSE 'empty' END ELSE CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'unsupported' WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'skipped_budget' ELSE 'not_applicable' END WHEN 'view' THEN 'complete' ELSE 'empty' END END AS status
FROM <events>""",
    "answer_relations": "SELECT CAST(user_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) AS answer, value > 80 AND user_id % 10 <> 0 AS advisory FROM <events> WHERE event_id % 3 = 0",
    "answer_facts": "SELECT CAST(user_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) AS answer, CASE event_id % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'derived' WHEN 2 THEN 'inferred' WHEN 3 THEN 'declared?' ELSE 'observed' END AS basis, 'm' || CAST(event_id % 5 AS STRING) AS method FROM <events> WHERE event_id % 2 = 0",
    "object_dependencies": """SELECT DISTINCT 'PKG/CV_' || CAST(l_suppkey % 10 AS STRING) || '_' || CAST(l_orderkey % 40 AS STRING) AS dependent, CASE l_partkey % 5 WHEN 0 THEN 'system-local.bw.bw2hana/DEMO' || CAST(l_linenumber % 6 AS STRING) WHEN 1 THEN '/BIC/ADEMO' || CAST(l_linenumber % 6 AS STRING) || '00' WHEN 2 THEN 'system-local.bw.bw2hana.query.demo1/Q' || CAST(l_linenumber AS STRING)
WHEN 3 THEN 'system-local.bw.bw2hana.nsp/V' || CAST(l_partkey % 90 AS STRING) ELSE '/BI0/PMAT' || CAST(l_linenumber % 5 AS STRING) END AS base, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 2 END AS dependency_type FROM <lineitem> WHERE l_orderkey % 4 <> 3
UNION SELECT 'system-local.bw.bw2hana/DEMO' || CAST(l_orderkey % 6 AS STRING), '/BIC/ADEMO' || CAST(l_linenumber % 6 AS STRING) || '00', 1 FROM <lineitem>""",
    "provider_catalogue": """SELECT DISTINCT 'DEMO' || CAST(p_partkey % 4 AS STRING) AS name, 'dso' AS kind FROM <part> UNION SELECT '/NSP/V' || CAST(p_partkey % 80 AS STRING), 'compositeprovider' FROM <part> UNION SELECT '0MAT' || CAST(p_partkey % 3 AS STRING), 'infoobject' FROM <part>""",
    "query_components": "SELECT 'N' || CAST(l_partkey AS STRING) AS provider, 'Q' || CAST(l_orderkey AS STRING) AS component FROM <lineitem> WHERE l_linenumber = 1",
    "extracts": "SELECT 'N' || CAST(o_orderkey AS STRING) AS datasource, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'ROOS' || CAST(o_custkey AS STRING) END AS structure, CASE WHEN o_orderkey % 2 = 0 THEN 'ABR' ELSE 'ADD' END AS delta FROM <orders> WHERE o_orderkey % 16 = 5 UNION ALL SELECT 'N' || CAST(o_orderkey AS STRING), 'ROOS' || CAST(o_custkey AS STRING), 'FIL' FROM <orders> WHERE o_orderkey % 32 = 5",
    "composite_part_rows": f"SELECT dst AS composite, src AS part, via, via IS NULL OR LENGTH(src) % 2 = 0 AS confirmed FROM (SELECT 'N' || CAST(s AS STRING) AS dst, 'N' || CAST(d AS STRING) AS src, CASE WHEN s % 3 = 0 THEN NULL ELSE '/BIC/A' || CAST(d AS STRING) || '00' END AS via FROM ({_ORDERED}) e WHERE s % 10 = 0) x",
    "element_settings": """SELECT o_orderkey AS element, CASE WHEN o_custkey % 9 = 0 THEN 'EUR' ELSE ' ' END AS currency, CASE o_custkey % 8 WHEN 1 THEN '3' WHEN 2 THEN '1' ELSE '0' END AS currency_flag, CASE WHEN o_custkey % 11 = 0 THEN 'T1' END AS translation, CASE WHEN o_orderkey % 10 = 3 THEN 'KG' ELSE '' END AS unit,
CASE WHEN o_orderkey % 14 = 1 THEN '2' ELSE '' END AS unit_flag, CASE o_orderkey % 6 WHEN 0 THEN '01' WHEN 1 THEN '07' WHEN 2 THEN '77' WHEN 3 THEN '00' ELSE '' END AS aggregation, CASE o_orderkey % 5 WHEN 0 THEN 'X' WHEN 1 THEN '#' ELSE '' END AS sign, CASE WHEN o_orderkey % 7 = 0 THEN 'X' END AS cumulative,
CASE WHEN o_orderkey % 17 = 0 THEN 'X' ELSE '' END AS constant, CASE o_orderkey % 12 WHEN 0 THEN '6' WHEN 1 THEN '1' ELSE '0' END AS key_date_flag, CASE o_orderkey % 13 WHEN 0 THEN '3' WHEN 1 THEN '2' ELSE '0' END AS hierarchy_flag, CASE o_orderkey % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'Z' ELSE '' END AS totals, CASE o_orderkey % 3 WHEN 0 THEN 'Y' ELSE '#' END AS display FROM <orders>""",
    "caveats": """SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'Resolved by an ADVISORY reading' WHEN 1 THEN 'the list is capped at 25' WHEN 2 THEN 'a customer-exit variable, parsed from code' WHEN 3 THEN 'values resolve at runtime' WHEN 4 THEN 'plain remark ' || CAST(event_id AS STRING) WHEN 5 THEN NULL ELSE 'a lower bound, truncated' END AS caveat FROM <events>""",
    "dso_headers": "SELECT 'ND' || CAST(p_partkey AS STRING) AS name, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_brand END AS area, 'U' || CAST(p_size AS STRING) AS owner FROM <part> WHERE p_partkey % 3 = 0",
    "adso_headers": "SELECT 'NA' || CAST(p_partkey AS STRING) AS name, p_brand AS area, '' AS owner FROM <part> WHERE p_partkey % 3 = 1",
    "cube_headers": "SELECT 'NC' || CAST(p_partkey AS STRING) AS name, CASE p_size % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'M' WHEN 2 THEN 'v' ELSE 'Z' END AS type, CASE WHEN p_size % 3 = 0 THEN 'INA' ELSE 'ACT' END AS status, p_brand AS area, 'X' AS owner FROM <part> WHERE p_partkey % 3 = 2",
    "stored_fields": """SELECT CASE WHEN l_partkey % 3 = 0 THEN 'ND' ELSE 'NC' END || CAST(l_partkey AS STRING) AS provider, CASE WHEN l_suppkey % 7 = 0 THEN '0MAT__A' || CAST(l_linenumber AS STRING) ELSE 'F' || CAST(l_suppkey % 20 AS STRING) END AS field, l_linenumber AS position, CASE WHEN l_linenumber = 1 THEN 'X' ELSE ' ' END AS key
FROM <lineitem> WHERE l_partkey % 3 <> 1""",
    "generated_columns": """SELECT 'NA' || CAST(l_partkey AS STRING) AS provider, CASE l_suppkey % 5 WHEN 0 THEN '/BIC/ZF' || CAST(l_linenumber AS STRING) WHEN 1 THEN 'MAT' || CAST(l_linenumber AS STRING) WHEN 2 THEN '/NS/C' || CAST(l_linenumber AS STRING) WHEN 3 THEN '0MAT__A' || CAST(l_linenumber AS STRING) ELSE '/BI0/DEL' || CAST(l_linenumber AS STRING) END AS column,
l_linenumber AS position FROM <lineitem> WHERE l_partkey % 3 = 1""",
    "column_keys": "SELECT DISTINCT 'NA' || CAST(l_partkey AS STRING) AS provider, CASE WHEN l_suppkey % 2 = 0 THEN '/BIC/ZF1' ELSE '0MAT2' END AS field FROM <lineitem> WHERE l_partkey % 3 = 1 AND l_linenumber = 1",
    "infoobject_names": "SELECT 'ZF' || CAST(p_partkey % 5 AS STRING) AS name FROM <part> UNION SELECT '0MAT' || CAST(p_partkey % 4 AS STRING) FROM <part> UNION SELECT '0DEL' || CAST(p_partkey % 3 AS STRING) FROM <part> UNION SELECT '/NS/C' || CAST(p_partkey % 2 AS STRING) FROM <part>",
    "field_navs": "SELECT DISTINCT '0MAT__A' || CAST(p_partkey % 4 AS STRING) AS name, '0MAT' AS characteristic, 'A' || CAST(p_partkey % 4 AS STRING) AS attribute FROM <part>",
    "provider_parts": "SELECT DISTINCT 'NC' || CAST(l_partkey AS STRING) AS composite, 'ND' || CAST(l_suppkey AS STRING) AS part FROM <lineitem> WHERE l_partkey % 3 = 2 AND l_linenumber < 3",
    "classic_ledger": "SELECT 'N' || CAST(o_custkey AS STRING) AS provider, CASE o_custkey % 6 WHEN 0 THEN 'ODSO' WHEN 1 THEN 'FLEX_T' WHEN 2 THEN 'cube' WHEN 3 THEN 'WHAT' ELSE 'IOBJ' END AS code FROM <orders> WHERE o_custkey % 4 <> 0",
    "newer_ledger": "SELECT 'N' || CAST(o_custkey AS STRING) AS provider, CASE WHEN o_orderkey % 2 = 0 THEN 'ADSO' ELSE 'HCPR' END AS code FROM <orders> WHERE o_custkey % 3 <> 1",
    "query_directory": """SELECT o_orderkey AS query, CASE WHEN o_orderkey % 8 = 0 THEN '!!' ELSE 'Z' END || CAST(o_orderkey AS STRING) AS name, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'U' || CAST(o_custkey AS STRING) END AS owner, o_orderdate AS last_used, v.version, CASE WHEN o_orderkey % 9 = 0 THEN 'INA' ELSE 'ACT' END AS status
FROM <orders> CROSS JOIN (SELECT 'A' AS version UNION ALL SELECT 'M') v""",
    "union_parts": """SELECT DISTINCT 'N' || CAST(o_orderkey AS STRING) AS composite, 'N' || CAST(o_custkey AS STRING) AS part FROM <orders> WHERE o_orderkey % 10 = 0 AND o_orderkey % 50 <> 0
UNION SELECT 'N' || CAST(l_orderkey AS STRING), 'N' || CAST(l_partkey AS STRING) FROM <lineitem> WHERE l_orderkey % 10 = 0 AND l_orderkey % 50 <> 0""",
    "routine_headers": """SELECT o_orderkey AS tranid, CASE WHEN o_orderkey % 4 = 0 THEN 'R' || CAST(o_custkey AS STRING) ELSE '' END AS startroutine, CASE WHEN o_orderkey % 6 = 1 THEN ' E' || CAST(o_orderkey AS STRING) || ' ' END AS endroutine, CASE WHEN o_orderkey % 11 = 5 THEN 'X' || CAST(o_orderkey AS STRING) ELSE ' ' END AS expert,
CASE WHEN o_orderkey % 8 = 4 THEN 'R' || CAST(o_custkey AS STRING) ELSE ' ' END AS glbcode, CASE WHEN o_orderkey % 5 = 2 THEN 'G' || CAST(o_orderkey % 10 AS STRING) END AS glbcode2 FROM <orders>""",
    "routine_steps": """SELECT l_orderkey AS tranid, l_partkey AS rule_id, l_linenumber AS step_id, CASE l_partkey % 4 WHEN 0 THEN 'G' || CAST(l_orderkey % 10 AS STRING) WHEN 1 THEN ' ' ELSE 'F' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey % 3 AS STRING) END AS codeid,
CASE l_linenumber % 5 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'FORMULA ' WHEN 2 THEN 'UNIT' ELSE 'ODD' END AS kind FROM <lineitem>""",
    "code_lines": "SELECT CASE WHEN event_id % 1000 = 7 THEN 'G' || CAST(event_id % 9 AS STRING) WHEN event_id % 2 = 0 THEN 'R' || CAST(user_id AS STRING) ELSE 'E' || CAST(event_id AS STRING) END AS codeid, event_id AS line_no, 'x = ' || event_type || '.' AS line FROM <events>",
    "code_registry": """SELECT CASE c_custkey % 10 WHEN 9 THEN 'G' || CAST(c_custkey % 7 AS STRING) ELSE 'R' || CAST(c_custkey AS STRING) || ' ' END AS codeid, CASE c_custkey % 9 WHEN 0 THEN 'UR' WHEN 1 THEN 'TC' WHEN 2 THEN 'TR' WHEN 3 THEN 'IC' WHEN 4 THEN 'GR' WHEN 5 THEN 'S1' WHEN 6 THEN 'TF' WHEN 7 THEN 'ZZ' ELSE ' ' END AS codetp, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'U' || CAST(c_custkey % 13 AS STRING) END AS owner,
CASE WHEN c_custkey % 6 = 0 THEN 'INA' ELSE 'ACT' END AS objstat, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'X' END AS activfl, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1 ' ELSE '2' END AS dependency FROM <customer>""",
    "code_texts": "SELECT 'R' || CAST(c_custkey AS STRING) AS codeid, CASE WHEN c_custkey % 3 = 0 THEN 'D' ELSE 'E' END AS langu, c_name AS text FROM <customer> WHERE c_custkey % 8 <> 0 UNION ALL SELECT 'R' || CAST(c_custkey AS STRING), 'F', CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END FROM <customer>",
    "source_systems": "SELECT 'DS' || CAST(o_custkey AS STRING) AS datasource, CASE o_orderkey % 3 WHEN 0 THEN 'SYS1' WHEN 1 THEN ' ' ELSE 'SYS2' END AS system, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'ROOS' || CAST(o_orderkey % 50 AS STRING) END AS structure, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'D' END AS type, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'ABR' END AS delta FROM <orders> WHERE o_custkey % 3 <> 0 AND o_orderkey % 4 <> 1",
    "contract": """SELECT 'C' || CAST(p_partkey AS STRING) AS capability, p_brand AS object, CASE WHEN p_size % 5 = 0 THEN 'PLANNED' WHEN p_size % 5 = 1 THEN 'PARTIAL' ELSE 'DONE' END AS state, CASE p_partkey % 4 WHEN 0 THEN 'not_validated' WHEN 1 THEN 'unit_tested' WHEN 2 THEN 'system_validated' ELSE 'customer_validated' END AS validation, p_size % 5 <> 0 AS implemented FROM <part>""",
    "probes": """SELECT 'C' || CAST(p_partkey AS STRING) AS capability, p_brand AS object, CASE p_partkey % 9 WHEN 0 THEN 'denied' WHEN 1 THEN 'failed' WHEN 2 THEN 'not_probed' ELSE 'answered' END AS probe, CASE WHEN p_partkey % 9 < 3 THEN NULL ELSE p_size > 12 END AS present, p_size * 100 AS row_estimate FROM <part> WHERE p_partkey % 5 <> 1
UNION ALL SELECT 'X' || CAST(s_suppkey AS STRING), 'T' || CAST(s_suppkey AS STRING), 'answered', s_suppkey % 3 <> 0, s_suppkey FROM <supplier>""",
    "grants": "SELECT 'G' || CAST(CAST(FLOOR(p_partkey / 4) AS BIGINT) AS STRING) AS grp, 'C' || CAST(p_partkey AS STRING) AS capability FROM <part> UNION ALL SELECT 'H' || CAST(s_suppkey AS STRING), 'X' || CAST(s_suppkey + 3 AS STRING) FROM <supplier>",
    "domain_declared": "SELECT n_nationkey AS code, n_name AS label FROM <nation> WHERE n_nationkey % 5 <> 4",
    "domain_mapped": "SELECT n_nationkey AS code, CASE WHEN n_nationkey % 6 = 0 THEN 'other' ELSE n_name END AS label FROM <nation> WHERE n_nationkey % 7 <> 3",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Braces name the tables; those of a view's own text are doubled.
    text = VIEWS[name].replace("<micros>", _MICROS["spark"]).replace("{", "{{").replace("}", "}}")
    tables = {}
    for t in TABLES:
        if f"<{t}>" in text:
            text = text.replace(f"<{t}>", "{" + t + "}")
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(text, **tables)


def duck(*names: str) -> str:
    """The same views as the head of a WITH clause for DuckDB."""
    parts = []
    for name in names:
        text = VIEWS[name].replace("<micros>", _MICROS["duckdb"])
        for t in TABLES:
            text = text.replace(f"<{t}>", t)
        parts.append(f"{name} AS ({text})")
    return ",\n".join(parts)
