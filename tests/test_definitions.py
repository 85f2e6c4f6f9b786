"""Exits, query definitions, field lineage, characteristics, areas, evidence and dependencies on small landscapes."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import characteristics, dependencies, evidence, exits, fields, governance
from cairn.operators import query_definitions as definitions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def code(spark, *lines):
    return spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)], "codeid int, line_no int, line string")


NESTED = ["CASE i_datasource.", "WHEN 'A' OR 'B'.", "  x = 1.", "* a comment", "  CASE lv.", "  WHEN 'I'.", "    y = 2.", "  WHEN OTHERS.", "    z = 3.", "  ENDCASE.", "  w = 4.", "WHEN 'C'.", "  v = 5.", "ENDCASE.", "u = 6."]


def test_a_branch_holds_the_blocks_within_it(spark):
    got = {}
    for name, line_no in rows(exits.branches(code(spark, *NESTED)).select("name", "line_no")):
        got.setdefault(name, []).append(line_no)
    assert {k: sorted(v) for k, v in got.items()} == {"A": [2, 4, 5, 6, 7, 8, 9, 10], "B": [2, 4, 5, 6, 7, 8, 9, 10], "I": [6], "C": [12]}


def test_flat_branches_end_at_any_branching(spark):
    got = {}
    for name, line_no in rows(exits.branches(code(spark, *NESTED), nested=False).select("name", "line_no")):
        got.setdefault(name, []).append(line_no)
    assert got == {"A": [2, 4], "B": [2, 4], "I": [6], "C": [12]}


def test_unclosed_and_stray_blocks(spark):
    names = lambda *lines: [(n, k) for n, k in rows(exits.branches(code(spark, *lines)).select("name", "line_no"))]
    assert names("CASE a.", "WHEN 'X'.", "one.", "two.") == [("X", 2), ("X", 3)]
    assert names("ENDCASE.", "WHEN 'X'.", "one.", "ENDCASE.", "two.") == [("X", 2)]
    assert names("CASE a.", "WHEN 'X'.", "CASE b.", "WHEN 'Y'.", "one.") == [("X", 2), ("X", 3), ("X", 4), ("Y", 4)]
    assert names("WHEN ' '.", "one.") == names("x.") == []


def test_handled_sources_and_dispatch(spark):
    lines = code(spark, "WHEN 'ds_1' OR 'DS_2'.", "IF i_datasource = 'DS_3' OR i_datasource = 'DS_1'.", "* WHEN 'NO'.", "CONCATENATE 'ZEX_' i_datasource INTO p.", "CONCATENATE 'no prefix' i_datasource INTO m.", "p = |/NS/Y_{ i_datasource }|.", "q = 'ZOTHER' && x.", "PERFORM f IN PROGRAM (p).")
    assert rows(exits.handled(lines)) == [(1, "DS_1", 1), (1, "DS_2", 2), (1, "DS_3", 3)]
    assert [tuple(r) for r in exits.dispatches(lines).collect()] == [(1, True, ["/NS/Y_", "ZEX_"])]
    assert [r.dynamic for r in exits.dispatches(code(spark, "PERFORM f IN PROGRAM zfix.", "PERFORM a. x = b IN PROGRAM (c).")).collect()] == [False]
    wanted = spark.createDataFrame([(1, "ds_1"), (1, "/NS/DS_2"), (1, "A B"), (1, "X/Y"), (1, "L" * 36), (1, "L" * 37), (1, " ")], "codeid int, datasource string")
    programs = spark.createDataFrame([("ZEX_DS_2",)], "program string")
    got = {(r.datasource, r.status) for r in exits.satellites(exits.dispatches(code(spark, "CONCATENATE 'ZEX_' i_datasource INTO p.")), wanted, programs).collect()}
    assert got == {("DS_1", "absent"), ("/NS/DS_2", "available"), ("A B", "no_name"), ("X/Y", "no_name"), ("L" * 36, "absent"), ("L" * 37, "no_name")}
    assert rows(exits.exit_only(exits.handled(lines), spark.createDataFrame([("ds_1",)], "name string"))) == [("DS_2", 1), ("DS_3", 1)]


def test_definitions_tell_where_they_are_cut(spark):
    chain = spark.createDataFrame([("q", "e1"), ("e1", "e2"), ("e2", "e3"), ("e3", "q"), ("q", "w1"), ("q", "w2"), ("q", "")], "parent string, child string")
    roots = spark.createDataFrame([("q",), ("alone",)], "query string")
    found = lambda **how: [(r.query, r.element, r.level, r.capped, r.cut) for r in definitions.element_tree(roots, chain, **how).orderBy("query", "place").collect()]
    whole = [("q", "q", 0), ("q", "e1", 1), ("q", "w1", 1), ("q", "w2", 1), ("q", "e2", 2), ("q", "e3", 3)]
    assert found() == [("alone", "alone", 0, False, False)] + [(*x, False, False) for x in whole]
    assert found(depth=2) == [("alone", "alone", 0, False, False)] + [(*x, False, True) for x in whole[:5]]
    assert found(most=2) == [("alone", "alone", 0, False, False)] + [(*x, True, False) for x in whole[:2]]


def test_elements_restrictions_and_conditions(spark):
    xref = spark.createDataFrame([("q", "s", "SHT", 1), ("q", "f", "SOB", 2), ("f", "c", "AGG", 1), ("f", "d", "AGG", 2), ("s", "k", "NIL", 1), ("s", "c", "ROW", 3)], "parent string, child string, laytp string, position int")
    directory = spark.createDataFrame([("q", "REP", ""), ("s", "SHT", ""), ("f", "SOB", None), ("c", "sel", ""), ("d", "SEL", "STM"), ("k", "SEL", "CON"), ("x", "???", "")], "element string, deftp string, subdeftp string")
    selects = spark.createDataFrame([("c", "MAT", ""), ("d", "1KYFNM", ""), ("d", "MAT", ""), ("k", "1CONDITION", "x")], "element string, infoobject string, active string")
    ranges = spark.createDataFrame(
        [("c", "MAT", None, "I", "EQ", "1", None, "1", None, None), ("d", "MAT", None, "I", "EQ", "1", None, "1", None, None), ("d", "VAR", None, "I", "BT", "V1", "V2", "3", "3", None), ("k", "1CONDITION", "1STRUC", "I", "EQ", "d", None, "2", None, "00"), ("k", "1CONDITION", "1VALUE", "I", "BC", "10", None, "1", None, "00")],
        "element string, infoobject string, facet string, sign string, opt string, low string, high string, lowflag string, highflag string, level string")
    tree = definitions.element_tree(spark.createDataFrame([("q",)], "query string"), xref)
    types = definitions.element_types(directory, selects)
    assert {r.element: (r.type, r.infoobject) for r in types.collect()} == {"q": ("query", None), "s": ("query_sheet", None), "f": ("filter", None), "c": ("characteristic", "MAT"), "d": ("restricted_key_figure", None), "k": ("condition", None), "x": ("unknown", None)}
    rolled = definitions.rolled_restrictions(tree, xref, types, ranges)
    assert rows(rolled.where("element = 'f'").select("own", "infoobject", "low", "low_is_variable")) == [(False, "MAT", "1", False), (False, "VAR", "V1", True)]
    assert {r.element: (r.restrictions, r.variables) for r in definitions.definition(tree, types, rolled).collect()} == {"q": (0, ""), "s": (0, ""), "f": (2, "V1,V2"), "c": (1, ""), "d": (2, "V1,V2"), "k": (2, "")}
    assert rows(definitions.placed_edges(tree, xref, types).select("parent", "child", "role", "axis")) == [("f", "c", "aggregated", "filter"), ("f", "d", "aggregated", "filter"), ("q", "f", "selection_object", "structural"), ("q", "s", "query_sheet", "structural"), ("s", "c", "rows", "rows"), ("s", "k", "unplaced", "unplaced")]
    state = selects.withColumnRenamed("x", "active")
    assert rows(definitions.conditions(tree, types, ranges, state)) == [("q", "k", "condition", True, "BC", None, "advisory", "10", "literal", "d", None, "")]


def test_a_field_is_followed_over_every_kind_of_hop(spark):
    make = lambda data, schema: spark.createDataFrame(data, schema)
    rules = make([("D", "F1", "S", "g1", "direct", True, False), ("S", "G1", "DS", "x", "direct", False, True), ("K", "C", "K0", None, "constant", False, False), ("L", "F", "M", "F", "direct", False, False), ("M", "F", "L", "f", "direct", False, False)], "object string, field string, source_object string, source_field string, rule_type string, by_routine boolean, from_datasource boolean")
    composites = make([("P", "A", "MP", "adso", "B", "element", None), ("P", "A", "ZZ", "adso", "B", "element", None), ("P", "V", "VW", "calcview", "C", "element", "PK/VW")], "object string, field string, part string, part_kind string, source string, mapping_kind string, runtime_view string")
    identifications = make([("MP", "B", "D", "N1")], "object string, field string, part string, part_field string")
    navigations = make([("N1", "R", "F1"), ("N2", "", "F1")], "field string, characteristic string, attribute string")
    references = make([("R", "D"), ("D", "D"), ("Q", "")], "object string, base string")
    hops = fields.hop_tables(rules, composites, identifications, navigations, references)
    starts = make([("P", "a"), ("P", "V"), ("K", "C"), ("L", "F"), ("MP", "other"), ("X", "Y"), ("R", "nope"), ("P", "a")], "object string, field string")
    got = {(r.start_object, r.start_field): (r.kinds, r.stop, r.end_object, r.by_routine) for r in fields.field_paths(fields.field_hops(starts, hops)).collect()}
    assert got == {
        ("P", "a"): ("composite_part>multiprovider_part>nav_attribute>reference_characteristic>transformation>transformation", "datasource", "DS", True), ("P", "V"): ("composite_part", "calc_view", "PK/VW", False), ("K", "C"): ("transformation", "no_source", "K0", False),
        ("L", "F"): ("transformation>transformation", "cycle", "L", False), ("MP", "other"): ("", "not_identified", "MP", False), ("X", "Y"): ("", "no_rule", "X", False), ("R", "nope"): ("reference_characteristic", "chain_ends", "D", False),
    }
    assert {r.stop for r in fields.field_hops(starts.where("field = 'a'"), hops, depth=2).collect()} == {None, "too_deep"}
    assert [r.siblings for r in fields.field_hops(starts.where("field = 'a'"), hops).where("level = 1").collect()] == [1]
    assert fields.field_hops(starts.limit(0), hops).count() == 0


def test_references_are_followed_to_their_end(spark):
    chars = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", ""), ("s", "s"), ("x", "y"), ("y", "x"), ("z", "x"), ("g", "gone"), ("h", "g"), ("", "q")], "name string, base string")
    assert rows(characteristics.basic_characteristics(chars)) == [
        ("a", "d", "reference"), ("b", "d", "reference"), ("c", "d", "reference"), ("d", "d", "basic"), ("g", "gone", "dangling"), ("h", "gone", "dangling"), ("s", "s", "basic"), ("x", "x", "cycle"), ("y", "y", "cycle"), ("z", "z", "cycle")]
    long = spark.range(300).select(F.format_string("c%03d", "id").alias("name"), F.when(F.col("id") == 0, "").otherwise(F.format_string("c%03d", F.col("id") - 1)).alias("base"))
    assert {r.basic for r in characteristics.basic_characteristics(long).collect()} == {"c000"}
    held = spark.createDataFrame([("d", "A1", 1, "NAV", "1", ""), ("d", "A2", 2, "dis", "0", "X"), ("gone", "A3", 1, "NAV", "X", "")], "characteristic string, attribute string, position int, kind string, time_dependent string, hidden string")
    navs = spark.createDataFrame([("a", "A1", "a__A1", "X", "", ""), ("d", "A1", " ", "", "", "")], "characteristic string, attribute string, name string, auth_relevant string, text_from_characteristic string, transitive string")
    found = characteristics.attributes(chars, held, navs)
    pick = {(r.characteristic, r.attribute): (r.kind, r.time_dependent, r.hidden, r.navigation_name, r.navigable, r.auth_relevant, r.inherited_from) for r in found.collect()}
    assert pick[("a", "A1")] == ("navigation", True, False, "a__A1", True, True, "d") and pick[("d", "A1")] == ("navigation", True, False, None, False, False, None) and pick[("h", "A3")][6] == "gone" and len(pick) == 10
    assert rows(characteristics.lost_navigations(found)) == [("b", 1, "A1"), ("c", 1, "A1"), ("d", 1, "A1"), ("g", 1, "A3"), ("h", 1, "A3")]
    assert {r.navigable for r in characteristics.attributes(chars, held, None).collect()} == {None}


def test_areas_roll_up_past_cycles(spark):
    areas = spark.createDataFrame([("r", ""), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("d", "lost"), ("e", None)], "area string, parent string")
    members = spark.createDataFrame([("b", "adso"), ("b", "cube"), ("a", "adso"), ("z", "adso"), ("x", "cube"), ("d", "adso"), ("nowhere", "adso"), (None, "adso"), (" ", "cube")], "area string, family string")
    got = {r.area: (r.path, r.level, r.status, r.own_adso, r.own, r.below) for r in governance.area_tree(areas, members, ["adso"]).collect()}
    assert got == {
        "r": ("r", 0, "placed", 0, 0, 3), "a": ("r/a", 1, "placed", 1, 1, 3), "b": ("r/a/b", 2, "placed", 1, 2, 2), "e": ("e", 0, "placed", 0, 0, 0), "x": (None, None, "cycle", 0, 1, 2), "y": (None, None, "cycle", 0, 0, 2), "z": (None, None, "cycle", 1, 1, 1),
        "d": (None, None, "dangling", 1, 1, 1), "nowhere": (None, None, "unresolved", 1, 1, 1), "": (None, None, "unassigned", 1, 2, 2),
    }
    assert governance.area_tree(areas.limit(0), members.limit(0), ["adso"]).count() == 0


@pytest.mark.parametrize("statuses, advisory, level, worst", [
    (["complete", "empty"], [], "high", "empty"), (["complete"], [True], "medium", "complete"), (["complete", "complete", "unsupported"], [], "medium", "unsupported"), (["complete", "failed"], [], "low", "failed"),
    (["not_applicable"], [], "high", "not_applicable"), (["not_applicable", "skipped_budget"], [False], "low", "skipped_budget"), (["unsupported", "failed", "skipped_budget"], [True], "low", "failed"),
])
def test_confidence_levels(spark, statuses, advisory, level, worst):
    sections = spark.createDataFrame([("q", str(k), s) for k, s in enumerate(statuses)], "answer string, section string, status string")
    relations = spark.createDataFrame([("q", a) for a in advisory], "answer string, advisory boolean")
    facts = spark.createDataFrame([("q", "observed", "m"), ("q", "odd", "n"), ("q", None, "m")], "answer string, basis string, method string")
    found = evidence.confidence(sections, relations, facts)
    r = found.first()
    assert (r.level, r.worst, r.observed, r.unknown) == (level, worst, 1, 2)
    assert rows(evidence.evidence_summary(facts)) == [("q", 1, 0, 0, 2, 2, "m,n")]
    assert (rows(evidence.reasons(found)) == [("q", "everything_read_and_declared", 0)]) == (not any(s in evidence.GAPS for s in statuses) and not any(advisory))


def test_dependencies_are_resolved_before_they_are_cut(spark):
    edges = [("V", f"system-local.bw.bw2hana/P{k:02}", 1) for k in range(60)] + [("V", "/BIC/AP0100", 1), ("V", "system-local.bw.bw2hana.query.p/Q", 1), ("V", "system-local.bw.bw2hana/hier/H", 1), ("V", "system-local.bw.bw2hana/NONE", 1), ("W", "/BIC/AP0200", 2), ("W", "system-local.bw.bw2hana.ns/X", 2), ("system-local.bw.bw2hana/P03", "/BIC/AP0200", 1), ("V", "/BIC/AP9900", 2)]
    deps = spark.createDataFrame(edges, "dependent string, base string, dependency_type int")
    catalogue = spark.createDataFrame([(f"P{k:02}", "dso") for k in range(60)] + [("/NS/X", "compositeprovider")], "name string, kind string")
    found = dependencies.view_providers(deps, catalogue)
    assert {(r.view, r.route, r.providers, r.truncated) for r in found.collect()} == {("V", "direct", 60, True), ("W", "transitive", 2, False), ("system-local.bw.bw2hana/P03", "direct", 1, False)}
    assert found.where("view = 'V'").count() == 50
    used = {(r.provider, r.consumer, r.consumer_kind, r.consumers) for r in dependencies.provider_consumers(deps, catalogue).where("provider IN ('P02', '/NS/X')").collect()}
    assert used == {("P02", "P03", "provider", 3), ("P02", "V", "calcview", 3), ("P02", "W", "calcview", 3), ("/NS/X", "W", "calcview", 1)}
