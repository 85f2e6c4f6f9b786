"""Typed hops, composed answers and the small operators that they are made of."""

from cairn.operators import analysis, answers, diff, governance, hops, models, runs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_typed_hops(spark):
    make = spark.createDataFrame
    typed = make([("a", "b", "ODSO", "HCPR"), ("", "b", "X", "HCPR")], "src string, dst string, src_type string, dst_type string")
    loads = make([("a", "b"), ("c", "b"), (None, "b")], "src string, tgt string")
    parts = make([("b", "p", False, None), ("b", "q", True, "T1"), ("b", "r", False, "T2"), ("b", " B", False, "T3")], "composite string, part string, confirmed boolean, via string")
    assigned = make([("b", "Q1"), ("b", "Q2"), ("b", "Q3"), ("b", "STRUCT"), ("b", "Q1")], "provider string, component string")
    roots = make([("Q1",), ("Q2",), ("Q3",)], "component string")
    declared, parsed = make([("l", "a"), ("a", "a")], "object string, target string"), make([("l", "a"), ("m", "a")], "object string, target string")
    extracts = make([("a", "RO", "ABR"), ("a", "RO", "ADD"), ("x", " ", "ADD")], "datasource string, structure string, delta string")
    found = hops.all_hops(hops.load_hops(typed, loads), hops.part_hops(parts), hops.query_hops(assigned, roots, most=2), hops.lookup_hops(declared, parsed), hops.extract_hops(extracts))
    assert rows(found) == [
        ("RO", "a", "source_extract", True, "exact", "ABR,ADD"), ("a", "b", "transformation", False, "exact", ""), ("b", "Q1", "query_provider", True, "exact", "+1"), ("b", "Q2", "query_provider", True, "exact", "+1"), ("c", "b", "dtp", False, "exact", ""), ("l", "a", "lookup", False, "exact", ""),
        ("m", "a", "lookup", False, "advisory", ""), ("p", "b", "composite_part", True, "exact", ""), ("q", "b", "composite_part", True, "exact", "T1"), ("r", "b", "composite_part", True, "advisory", "T2"),
    ]
    kinds = hops.node_types(found, typed, make([("p",), ("b",)], "name string"), make([("q",)], "name string"), make([("r", "dso"), ("c", "infocube")], "name string, kind string"))
    assert {r.node: (r.type, r.basis) for r in kinds.collect()} == {
        "a": ("dso", "source_code"), "b": ("compositeprovider", "target_code"), "p": ("compositeprovider", "composite_header"), "q": ("query", "query_directory"), "r": ("dso", "catalogue"), "c": ("infocube", "catalogue"), "Q1": ("query", "hop"), "Q2": ("query", "hop"),
        "RO": ("extract_structure", "hop"), "l": ("unknown", "none"), "m": ("unknown", "none"),
    }


def test_answers_about_objects(spark):
    make = spark.createDataFrame
    objects = make([("a", True), ("b", False), ("c", True)], "answer string, active boolean")
    loads = make([("a", "c1", "daily"), ("a", "c2", "weekly"), ("b", "c1", "daily"), ("zz", "c1", "x")], "answer string, chain string, cadence string")
    one = lambda *names: make([(n,) for n in names], "answer string")
    volumes = make([("a", 10, 30), ("b", 0, 4), ("zz", 0, 99)], "answer string, active_records long, changelog_records long")
    risks = answers.object_risks(objects, loads, one("c"), volumes, one("a", "b"))
    assert rows(risks) == [("a", "mixed_cadences", "medium", "daily,weekly"), ("b", "changelog_outgrows_active", "medium", ""), ("b", "not_active", "high", ""), ("c", "no_consumer", "low", ""), ("c", "no_loader", "medium", "inactive_loader")]
    found = answers.sections(objects.select("answer"), {"loads": loads, "views": None, "health": volumes})
    assert rows(found) == [("a", "health", "complete", 1), ("a", "loads", "complete", 2), ("a", "views", "unsupported", None), ("b", "health", "complete", 1), ("b", "loads", "complete", 1), ("b", "views", "unsupported", None), ("c", "health", "empty", 0), ("c", "loads", "empty", 0), ("c", "views", "unsupported", None)]
    relations, facts = make([("a", True)], "answer string, advisory boolean"), make([("a", "observed", "m")], "answer string, basis string, method string")
    assert rows(answers.answers(objects, found, risks, relations, facts)) == [("a", "medium", "unsupported", 3, 2, 1, "medium", 1), ("b", "medium", "unsupported", 3, 2, 2, "high", 0), ("c", "medium", "unsupported", 3, 2, 2, "medium", 0)]


def test_risks_of_queries(spark):
    make = spark.createDataFrame
    one = make([("q",), ("r",)], "answer string")
    got = answers.query_risks(
        one, make([("q", "P")], "answer string, provider string"), make([("q", "B", True), ("q", "A", False), ("x", "A", False)], "answer string, characteristic string, covered boolean"), make([("r", 500)], "answer string, idle_days int"), make([("q", "V")], "answer string, variable string"),
        make([("q", "condition", True), ("q", "condition", True), ("q", "exception", True), ("r", "exception", False), ("r", "condition", False)], "answer string, kind string, active boolean"))
    assert rows(got) == [
        ("q", "active_conditions", "medium", "2"), ("q", "active_exceptions", "info", "1"), ("q", "customer_exit_variables", "info", "V"), ("q", "uncovered_characteristics", "high", "A"), ("q", "user_specific_result", "medium", "A,B"), ("r", "decommission_candidate", "low", "500"), ("r", "inactive_conditions", "info", "2"), ("r", "no_provider", "medium", ""),
    ]


def test_scenarios_that_assess_nothing(spark):
    make = spark.createDataFrame
    one = lambda *names: make([(n,) for n in names], "scenario string")
    got = answers.scenario_statuses(one("a", "b", "c", "d"), one("a"), make([("b", 3), ("b", 4), ("c", 0), ("d", 9)], "scenario string, candidates int"), one("d"))
    assert rows(got) == [("a", "unsupported", 0), ("b", "assessed", 7), ("c", "nothing_to_assess", 0), ("d", "connector_required", 9)]


def test_settings_that_change_a_figure(spark):
    columns = ["element", "currency", "currency_flag", "translation", "unit", "unit_flag", "aggregation", "sign", "cumulative", "constant", "key_date_flag", "hierarchy_flag", "totals", "display"]
    settings = spark.createDataFrame([("plain", *[None] * 13), ("sum", "", "0", " ", "", "0", "01", "#", "", "", "0", "2", "Z", "#"), ("odd", "EUR", "3", "", "", "1", "99", "X", "X", "X", "6", "3", "C", "Y")], ", ".join(f"{c} string" for c in columns))
    assert rows(answers.element_properties(settings)) == [
        ("odd", "99", True, True, True, "currency_translation,unit_conversion,local_aggregation,sign_inverted,cumulative,constant_selection,own_key_date,hierarchy_by_variable"), ("plain", None, False, False, False, ""), ("sum", "Summation", False, False, False, ""),
    ]


def test_step_targets_count_once(spark):
    steps = spark.createDataFrame([("c", 1, "DTP_LOAD", "d1"), ("c", 2, "LOADING", "d2"), ("c", 3, "DTP_LOAD", "gone"), ("c", 4, "CHAIN", "d1"), ("c", 0, "DTP_LOAD", "d3"), ("e", 1, "DTP_LOAD", None)], "chain_id string, step_no int, step_type string, variant string")
    loads = spark.createDataFrame([("d1", "T", "F"), ("d2", "T", "D"), ("d3", "U", "F")], "dtp string, tgt string, updmode string")
    assert rows(runs.step_targets(steps, loads)) == [("c", "T", "d1", "F", 2, 1), ("c", "U", "d3", "F", 1, 1)]


def test_unreadable_is_unknown_not_uncovered(spark):
    relevant = spark.createDataFrame([("A",), ("B",), ("A",)], "characteristic string")
    values = spark.createDataFrame([("x", "A"), ("y", "A"), ("y", "C")], "auth string, characteristic string")
    assert rows(governance.coverage(relevant, values)) == [("A", 2, "covered"), ("B", 0, "uncovered")]
    assert rows(governance.coverage(relevant, None)) == [("A", None, "unknown"), ("B", None, "unknown")]


def test_rules_with_their_routines(spark):
    rules = spark.createDataFrame([(1, "k"), (2, "k")], "rule_id int, kind string")
    fields = spark.createDataFrame([(1, 0, "b"), (1, 0, "a"), (1, 1, "t")], "rule_id int, role int, field string")
    constants, routines = spark.createDataFrame([(2, "X")], "rule_id int, value string"), spark.createDataFrame([(1, "R9"), (2, "")], "rule_id int, codeid string")
    assert rows(models.assembled_rules(rules, fields, constants, routines)) == [(1, "k", "a,b", "t", None, "R9"), (2, "k", "", "", "X", None)]
    assert models.assembled_rules(rules, fields, constants).columns == ["rule_id", "kind", "sources", "targets", "constant"]


def test_drift_of_whole_domains(spark):
    decoded = spark.createDataFrame([("D", "1", "a", True), ("D", "2", "b", True), ("E", "1", "a", False), ("G", "1", "a", True)], "domain string, code string, label string, complete boolean")
    declared = spark.createDataFrame([("D", "1", "x"), ("D", "3", "c"), ("E", "2", "b"), ("H", "1", "z")], "domain string, code string, label string")
    assert rows(diff.domain_drift(decoded, declared)) == [
        ("D", "1", "label_differs", "low"), ("D", "2", "undeclared", "info"), ("D", "3", "unmapped", "high"), ("E", "1", "undeclared", "info"), ("E", "2", "unmapped", "info"), ("G", None, "domain_absent", "high"), ("H", None, "not_decoded", "info"),
    ]


def test_an_affected_object_is_listed_once(spark):
    pair = lambda *data: spark.createDataFrame(list(data), "object string, affected string")
    looked = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("a", "q", False), ("a", "a", False)], "object string, affected string, advisory boolean")
    got = analysis.impact_items(pair(("a", "b")), looked, pair(("a", "q"), ("a", "r")), pair(("a", "r")))
    assert rows(got) == [("a", "b", "feeds", "high", False), ("a", "c", "looked_up", "high", True), ("a", "q", "looked_up", "high", False), ("a", "r", "calculation_view", "high", False)]
