"""The walk of missing data, routines and their source, reports about a system, and answers cut to size."""

import datetime

from cairn.operators import analysis, diagnosis, reports, routines


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_unions_give_way_to_their_parts(spark):
    make = spark.createDataFrame
    targets = make([("q", "M"), ("q", "D"), ("q", "M"), ("r", "E"), ("s", "U"), ("t", " "), ("v", None), ("w", "N")], "target string, provider string")
    kinds = make([("M", "multiprovider"), ("D", "dso"), ("E", "compositeprovider"), ("N", "compositeprovider"), ("I", "compositeprovider")], "provider string, kind string")
    parts = make([("M", "A"), ("M", "B"), ("M", "A"), ("D", "X"), ("E", " "), ("E", None), ("N", "I"), ("I", "A")], "composite string, part string")
    held = diagnosis.bearers(targets, kinds, parts)
    # D holds its own data whatever the part table says; E is a union whose parts can't be read; parts that are unions aren't opened.
    assert rows(held) == [("q", "A", "M", "parts", True), ("q", "B", "M", "parts", True), ("q", "D", None, "not_union", True), ("r", "E", None, "unresolved", True), ("s", "U", None, "unresolved", True), ("w", "I", "N", "parts", True)]
    assert [r.provider for r in diagnosis.bearers(targets, kinds, parts, most=2).where("NOT diagnosed").collect()] == ["D"]
    assert rows(diagnosis.limits(targets, diagnosis.bearers(targets, kinds, parts, most=2))) == [
        ("q", "D", "truncated"), ("q", "M", "reader_caveat"), ("r", "E", "metadata_dead_end"), ("s", "U", "metadata_dead_end"), ("t", None, "metadata_dead_end"), ("v", None, "metadata_dead_end"), ("w", "N", "reader_caveat")]


def test_what_a_provider_shows(spark):
    make = spark.createDataFrame
    day = lambda n: datetime.date(2024, 1, 31) - datetime.timedelta(n)
    requests = make([("now", 9, day(0), "success"), ("now", 8, day(3), "error"), ("day", 1, day(1), "success"), ("two", 1, day(2), "success"), ("old", 1, day(8), "success"), ("bad", 2, day(0), "incomplete"), ("bad", 1, day(4), "success"), ("never", 1, day(5), "error"), ("odd", 1, day(0), None)], "provider string, rnr long, started date, status string")
    health = diagnosis.load_health(requests, make([("now", 5), ("day", 0), ("two", None), ("void", 0), ("now", 2)], "provider string, active_records long"))
    assert {r.provider: (r.requests, r.failed, r.last_status, r.age_days, r.active_records) for r in health.collect()} == {
        "now": (2, 1, "success", 0, 7), "day": (1, 0, "success", 1, 0), "two": (1, 0, "success", 2, None), "old": (1, 0, "success", 8, None), "bad": (2, 0, "incomplete", 4, None), "never": (1, 1, "error", None, None), "odd": (1, 0, None, None, None), "void": (0, 0, None, None, 0)}
    every = make([(p,) for p in ("now", "day", "two", "old", "bad", "never", "odd", "void", "alone", "two")], "provider string")
    loaded = make([(p,) for p in ("now", "day", "two", "old", "bad", "never", "odd", "now", "elsewhere")], "provider string")
    risks = diagnosis.provider_risks(every, health, loaded, make([("void",), ("void",), ("now",)], "provider string"), make([("two", 1), ("two", 2), ("two", 1), ("elsewhere", 3)], "provider string, tranid long"))
    assert rows(risks) == sorted([
        ("now", "failed_requests", "medium", "1"), ("day", "no_rows", "critical", None), ("two", "late", "medium", "2"), ("two", "routines", "medium", "2"), ("old", "late", "high", "8"), ("bad", "last_load_failed", "critical", "incomplete"), ("bad", "late", "medium", "4"),
        ("never", "last_load_failed", "critical", "error"), ("never", "failed_requests", "medium", "1"), ("void", "no_rows", "critical", None), ("void", "no_loader", "medium", "2"), ("alone", "no_loader", "high", None)], key=str)


def test_parts_of_different_age(spark):
    parts = spark.createDataFrame(
        [("far", "a", 0, 5), ("far", "b", 400, 7), ("far", "c", 30, None), ("far", "d", None, 9), ("near", "a", 0, 5), ("near", "b", 29, 1), ("month", "a", 360, 1), ("month", "b", 390, 2), ("one", "a", 900, 1), ("one", "b", None, 1), ("mild", "a", 1, 1), ("mild", "b", 31, 1)],
        "part_of string, provider string, age_days int, active_records long")
    assert rows(diagnosis.mixed_currency(parts)) == [("far", 4, 3, 400, 400, 2, 1, 7, "high"), ("mild", 2, 2, 30, 31, 1, 0, 1, "medium"), ("month", 2, 2, 30, 390, 2, 0, 3, "high")]
    old = spark.createDataFrame([("o", 360), ("o", 390), ("p", 0), ("p", 365)], "object string, age_days int")
    assert rows(analysis.currency_spread(old)) == [("o", 2, 30, "high"), ("p", 2, 365, "medium")]


def test_verdicts_tell_loads_from_users_and_gaps(spark):
    make = spark.createDataFrame
    targets = make([("load", "A"), ("users", "B"), ("gap", "U"), ("fine", "B"), ("void", None)], "target string, provider string")
    held = diagnosis.bearers(targets, make([("A", "dso"), ("B", "adso")], "provider string, kind string"), make([], "composite string, part string"))
    health = make([("A", 1, 0, "success", 3, 1), ("B", 1, 0, "success", 0, 1)], "provider string, requests long, failed long, last_status string, age_days int, active_records long")
    risks = diagnosis.provider_risks(make([("A",), ("B",)], "provider string"), health, make([("A",), ("B",)], "provider string"), make([], "provider string"), make([("B", 1)], "provider string, tranid long"))
    found = diagnosis.findings(held, risks, health, make([("users", "C"), ("users", "C"), ("users", "D")], "target string, characteristic string"))
    got = diagnosis.verdicts(targets, held, found, diagnosis.limits(targets, held))
    assert {r.target: (r.holders, r.risks, r.worst, r.gaps, r.points_to) for r in got.collect()} == {
        "load": (1, 1, "medium", 0, "load"), "users": (1, 2, "high", 0, "users"), "gap": (1, 0, None, 1, "unknown"), "fine": (1, 1, "medium", 0, "logic"), "void": (0, 0, None, 1, "unknown")}
    empty = targets.limit(0)
    assert diagnosis.verdicts(empty, held.limit(0), found.limit(0), diagnosis.limits(empty, held.limit(0))).count() == 0


def test_routines_at_their_first_place(spark):
    make = spark.createDataFrame
    headers = make([(1, "S", " E ", None, "S", "G"), (1, "S", " E ", None, "S", "G"), (2, "", " ", "X", None, None), (3, None, None, None, None, None)], "tranid long, startroutine string, endroutine string, expert string, glbcode string, glbcode2 string")
    steps = make([(1, 5, 1, "F", "UNIT "), (1, 2, 9, "F", "FORMULA"), (1, 7, 1, "G", "NORMAL"), (2, 1, 1, "", "NORMAL"), (2, 1, 2, "N", "what"), (2, 1, 3, "M", None), (9, 1, 1, "Z", "NORMAL")], "tranid long, rule_id long, step_id long, codeid string, kind string")
    refs = routines.routine_refs(headers, steps)
    assert rows(refs) == [(1, "E", "end", None, 2), (1, "F", "formula", 2, 4), (1, "G", "global", None, 3), (1, "S", "start", None, 1), (2, "M", "field", 1, 3), (2, "N", "field", 1, 2), (2, "X", "expert", None, 1)]
    assert [r.codeid for r in routines.routine_refs(headers, None).orderBy("tranid", "place").collect()] == ["S", "E", "G", "X"]
    lines = make([("S", 2, "b"), ("S", 1, "a"), ("Q", 1, "no")], "codeid string, line_no long, line string")
    assert rows(routines.routine_source(refs.where("codeid IN ('S', 'X')"), lines)) == [(1, "S", "start", None, 1, 1, "a"), (1, "S", "start", None, 1, 2, "b"), (2, "X", "expert", None, 1, None, None)]
    registry = make([("S ", "UR", " me", "ACT", "X", "2"), ("E", "??", "", "ACT", None, None), ("F", None, None, None, "X", "7"), ("Q", "TC", "", "ACT", "X", "0"), (" ", "TC", "", "", "", "")], "codeid string, codetp string, owner string, objstat string, activfl string, dependency string")
    texts = make([("S", "D", "deutsch"), ("S", "E", " english "), ("E", "F", "f"), ("E", "D", "d"), ("F", "E", " ")], "codeid string, langu string, text string")
    got = routines.routine_registry(make([("S",), ("E",), ("F",), ("H",), (None,)], "codeid string"), registry, texts, lines)
    assert rows(got) == [
        ("E", "??", "unknown", "d", None, False, "indeterminate", 0, False), ("F", None, "unknown", None, None, False, None, 0, False), ("S", "UR", "update_rule", "english", "me", True, "uses the whole source structure", 2, True)]


def test_extracts_of_the_named_system(spark):
    make = spark.createDataFrame
    sources = make([("D", "S1", "B", "T", "A"), ("D", "S2", "A", "T", None), ("D", " ", "C", "T", "x"), ("E", None, " ", None, "d")], "datasource string, system string, structure string, type string, delta string")
    ends = make([("D", "S1 "), ("D", "S1"), ("D", "S3"), ("D", None), ("E", ""), ("F", "S1")], "datasource string, system string")
    assert rows(routines.extracts(ends, sources)) == sorted([("D", "S1", "B", "T", "A"), ("D", "S3", None, None, None), ("D", None, "A", "T", ""), ("E", None, "", "", "d"), ("F", "S1", None, None, None)], key=str)


def test_reports_about_a_system(spark):
    make = spark.createDataFrame
    contract = make([("a", "A", "DONE", "unit_tested", True), ("b", "B", "DONE", "system_validated", True), ("c", "C", "PLANNED", "not_validated", False), ("d", "D", "PLANNED", "not_validated", False), ("e", "E", "DONE", "unit_tested", True)], "capability string, object string, state string, validation string, implemented boolean")
    probes = make([("a", "A", "answered", True, 5), ("b", "B", "denied", False, None), ("c", "C", "answered", True, 1), ("d", "D", "answered", False, 0), ("x", "X", "answered", True, 2)], "capability string, object string, probe string, present boolean, row_estimate long")
    report = reports.capability_report(contract, probes)
    assert {r.capability: r.verdict for r in report.collect()} == {"a": "usable", "b": "absent_on_system", "c": "not_implemented", "d": "not_applicable", "e": "usable", "x": "not_implemented"}
    assert rows(reports.capability_totals(report)) == [
        ("caveat", "unproven", 2), ("caveat", "untracked", 1), ("state", "DONE", 3), ("state", "PLANNED", 3), ("validation", "unit_tested", 2), ("verdict", "absent_on_system", 1), ("verdict", "not_applicable", 1), ("verdict", "not_implemented", 2), ("verdict", "usable", 2)]
    asked = make([("p", "a"), ("p", "b"), ("q", "b"), ("r", "gone"), ("s", "a"), ("t", "d"), ("u", "f")], "grp string, capability string")
    states = reports.grant_groups(asked, probes.union(make([("f", "F", "failed", None, None)], probes.schema)))
    assert {r.grp: r.state for r in states.collect()} == {"p": "partial", "q": "denied", "r": "undetermined", "s": "granted", "t": "absent", "u": "undetermined"}
    mode = lambda *groups: reports.access_mode(states.where(states.grp.isin(*groups))).first().mode
    assert (mode("p", "s"), mode("s", "u"), mode("s", "t", "r"), mode("r"), mode("none")) == ("least_privilege", "unknown", "technical_read", "unknown", "unknown")
    tools = reports.tool_support(make([("ok", "a"), ("ok", "x"), ("not", "b"), ("not", "e"), ("not", "a")], "tool string, capability string"), report)
    assert rows(tools) == [("not", 3, 2, "b", False), ("ok", 2, 0, None, True)]
    models = reports.object_models(make([("dso_header", True, True), ("adso", False, True), ("adso", False, False), ("composite_provider", None, None)], "capability string, present boolean, unreadable boolean"))
    assert rows(models) == [("adso", False, True), ("classic_dso", True, False), ("composite_provider", False, False), ("multiprovider", False, False)]


def test_large_graphs_are_cut_near_their_root(spark):
    make = spark.createDataFrame
    nodes = make([("r", "r", 0), ("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("r", "c", 3), ("s", "s", 0), ("s", "t", 1), ("u", "u", 0), ("z", "z", 5), ("z", "y", 0), ("z", "x", 1)], "root string, node string, level int")
    edges = make([("r", "r", "a"), ("r", "r", "b"), ("r", "a", "c"), ("r", "a", "b"), ("s", "s", "t"), ("s", "s", "t"), ("z", "y", "z")], "root string, src string, dst string")
    got = rows(reports.shaped_graphs(nodes, edges, most_nodes=3, most_edges=2))
    assert got == [("r", "a", "b", 4, 4, 3, True), ("r", "r", "a", 4, 4, 3, True), ("s", "s", "t", 2, 1, 2, False), ("u", None, None, 1, 0, 1, False), ("z", "y", "z", 3, 1, 3, False)]
    assert rows(reports.shaped_graphs(nodes, edges, most_nodes=2, most_edges=9).where("root = 'z'")) == [("z", None, None, 3, 1, 2, True)]
    fields = make([("p", f"f{k}", k < 2) for k in range(5)] + [("q", "g", False)], "provider string, field string, is_key boolean")
    assert rows(reports.shaped_fields(fields, most=4).drop("is_key")) == [("p", "f0", 5, True), ("p", "f1", 5, True), ("q", "g", 1, False)]
    assert rows(reports.named_boundary(make([("r", "b"), ("r", "a"), ("r", "a"), ("r", "c")], "root string, node string"), most=2)) == [("r", "a", 3), ("r", "b", 3)]


def test_types_have_one_spelling(spark):
    from cairn.functions import decode

    values = spark.createDataFrame([(" ODSO ", "a"), ("odso", " A "), ("DSO", "A"), ("Calc_View", "v"), ("TRCS", "i"), ("other", "x"), ("", "x"), (None, "x"), ("nonsense", "x")], "kind string, name string")
    assert [r[0] for r in values.select(decode.object_id(values.kind, values.name)).collect()] == ["dso:A", "dso:A", "dso:A", "calcview:V", "infosource:I", "unknown:X", "unknown:X", "unknown:X", "unknown:X"]


def test_scans_take_the_active_version_unless_told_otherwise(spark):
    from cairn.sources.registry import Landscape

    held = Landscape({"t": spark.createDataFrame([(1, "A", "x"), (1, "M", "x"), (2, "M", "OBJVERS")], "id long, OBJVERS string, name string"), "u": spark.createDataFrame([(1,)], "id long")})
    assert rows(held.scan("t", columns=["id"])) == [(1,)] and held.scan("t", compare_versions=True).count() == 3
    assert held.scan("t", "objvers = 'M'").count() == 2 and held.scan("t", "name = 'OBJVERS'").count() == 0 and held.scan("t", "id = 1", "name = 'x'").count() == 1
    assert held.scan("u").count() == 1


def test_code_leads_to_consumers_that_no_hop_shows(spark):
    make = spark.createDataFrame
    lines = make([("c1", "select * from a into x."), ("c1", "* A again, ab"), ("c2", "z = xa."), ("c3", "b-k = 1."), (None, "a"), ("c4", None)], "codeid string, line string")
    found = routines.mentions(lines, make([("A",), ("b",), (" ",), (None,), ("A",)], "name string"))
    assert rows(found.where("codeid IS NOT NULL")) == [("c1", "A"), ("c3", "b")]
    refs = make([(1, "c1"), (2, "c1"), (3, "c1"), (4, "c3")], "tranid long, codeid string")
    consumers = routines.code_consumers(found, refs, make([(1, "T"), (2, "T"), (3, "A"), (4, " ")], "tranid long, dst string"))
    assert rows(consumers) == [("A", "T", 2)]
    reached = make([("A", "T", 2), ("A", "U", 1), ("A", "A", 3), ("B", "C", 1)], "root string, node string, hops int")
    assert rows(routines.impact_with_code(reached.where("node <> 'T'"), consumers)) == [("A", "T", None, True), ("A", "U", 1, False), ("B", "C", 1, False)]
    assert rows(routines.impact_with_code(reached, consumers)) == [("A", "T", 2, True), ("A", "U", 1, False), ("B", "C", 1, False)]


def test_snapshots_of_transformations_go_by_presence(spark):
    headers = spark.createDataFrame([(" T ", "s", None, "A1", " ", None, None, "G"), ("U", "s", "d", "A2", None, "X", None, None), (" ", "s", "d", "A", "", "", "", "")], "tranid string, src string, dst string, startroutine string, endroutine string, expert string, glbcode string, glbcode2 string")
    assert rows(routines.transformation_facts(headers)) == [("transformation", "T", "s", "", "True", "False", "False", "True"), ("transformation", "U", "s", "d", "True", "False", "True", "False")]
