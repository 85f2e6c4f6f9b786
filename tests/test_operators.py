"""Operators at their edges: empty tables, single runs, missing times, cycles and refused tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import analysis, code, composites, diff, governance, graph, models, runs, search
from cairn.sources.registry import Landscape, capped, page
from cairn.sources.snapshots import SnapshotStore
from cairn.streaming import run_log


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    data = [("daily", k, day(k)) for k in range(30)] + [("weekly", 100 + k, day(7 * k)) for k in range(4)] + [("once", 200, day(3))] + [("hourly", 1000 + k, day(k // 24)) for k in range(24 * 5)]
    return spark.createDataFrame([(c, n, d, 0, "G") for c, n, d in data], "chain_id string, log_id long, run_day date, start_us long, status string")


def test_cadence_bands(log):
    found = {r.chain_id: (r.cadence, r.confidence, r.live) for r in runs.cadences(log).collect()}
    assert found == {"daily": ("daily", "high", True), "weekly": ("weekly", "high", True), "once": ("unknown", "low", True), "hourly": ("hourly", "high", True)}


def test_empty_log(spark, log):
    assert runs.cadences(log.limit(0)).count() == 0


def test_durations_leave_out_steps_without_end(spark):
    steps = spark.createDataFrame([("c", "l", 0, 5_000_000), ("c", "l", 1, None), ("c", "m", 0, None)], "chain_id string, log_id string, start_us long, end_us long")
    assert [(r.runs, r.max_s) for r in runs.durations(steps).collect()] == [(1, 5.0)]


def test_self_overlap_sees_past_a_short_run(spark):
    w = spark.createDataFrame([("c", "a", 0, 100), ("c", "b", 10, 20), ("c", "d", 50, 60), ("c", "e", 100, 110)], "chain_id string, log_id string, start_us long, end_us long")
    assert [r.log_id for r in runs.self_overlaps(w).orderBy("log_id").collect()] == ["b", "d"]


def test_contention_over_an_hour_boundary(spark):
    h = runs.HOUR
    w = spark.createDataFrame([("a", "1", h - 10, 2 * h + 10), ("b", "2", h, h + 5), ("b", "3", 2 * h, 2 * h + 1), ("b", "4", 2 * h + 10, 3 * h)], "chain_id string, log_id string, start_us long, end_us long")
    assert rows(runs.contention(w)) == [("a", 2, 1, 1)]


def test_cycles_and_self_loops(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "g"))
    assert rows(graph.cycles(g)) == [("a", "a", 3), ("a", "b", 3), ("a", "c", 3), ("e", "e", 1)]
    assert rows(graph.self_loops(g)) == [("e",)]


def test_reachability_returns_to_the_root_through_a_cycle_only(spark):
    g = edges(spark, ("a", "b"), ("b", "a"), ("c", "d"))
    assert rows(graph.reachability(g, 5)) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2), ("c", "d", 1)]


def test_diamond_layers_and_paths(spark):
    g = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"))
    assert rows(graph.layers(g)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(graph.longest_paths(g)) == [("a", 3)]
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert rows(graph.simple_paths(g, one("a"), one("d"))) == [("a", "d", "a>b>d", 2, False), ("a", "d", "a>c>d", 2, False)]
    assert rows(graph.simple_paths(g, one("a"), one("e"), most=1)) == [("a", "e", "a>b>d>e", 3, True)]
    assert rows(graph.simple_paths(g, one("a"), one("e"), hops=2)) == []


def slow_components(pairs):
    """Strongly connected components by who reaches whom."""
    reach = {a: {b for x, b in pairs if x == a} for a in {x for p in pairs for x in p}}
    changed = True
    while changed:
        changed = False
        for a in reach:
            more = set().union(*(reach[b] for b in reach[a])) - reach[a] if reach[a] else set()
            reach[a] |= more
            changed |= bool(more)
    groups = {a: frozenset({b for b in reach[a] if a in reach[b]}) for a in reach}
    return sorted((min(g), a, len(g)) for a, g in groups.items() if a in reach[a])


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randint(0, 25):02}", f"n{rng.randint(0, 25):02}") for _ in range(30)} | {("z1", "z2"), ("z2", "z3"), ("z3", "z1"), ("z3", "z4"), ("z4", "z5"), ("z5", "z4"), ("z0", "z1")}
    assert rows(graph.cycles(edges(spark, *pairs))) == slow_components(pairs)


def test_lineage_takes_free_hops_on_their_level(spark):
    hops = spark.createDataFrame([("s", "q", "extract", True), ("q", "a", "load", False), ("a", "b", "load", False), ("b", "c", "part", True), ("c", "a", "load", False), ("b", "b", "load", False)], "src string, dst string, kind string, free boolean")
    root = spark.createDataFrame([("c",)], "root string")
    up = graph.lineage(hops, 1, "up", root)
    assert rows(up) == [("c", "a", "b", "load", 0), ("c", "b", "b", "load", 0), ("c", "b", "c", "part", 0)]
    up = graph.lineage(hops, 2, "up", root)
    assert ("c", "s", "q", "extract", 2) in rows(up) and ("c", "c", "a", "load", 1) in rows(up) and len(rows(up)) == 6
    assert rows(graph.sources_of(up, hops)) == [("c", "s", True)]
    root = spark.createDataFrame([("a",)], "root string")
    assert rows(graph.lineage(hops, 1, "down", root)) == [("a", "a", "b", "load", 0)]
    assert rows(graph.lineage(hops.limit(0), 2, "up")) == rows(graph.lineage(hops.limit(0), 2)) == []


def test_call_trees_stop_at_a_call_of_one_above(spark):
    calls = edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))
    assert rows(graph.call_trees(calls, spark.createDataFrame([("a",)], "node string"))) == [("a", "a", 0, False), ("a", "a>b", 1, False), ("a", "a>b>a", 2, True), ("a", "a>b>c", 2, False)]
    assert max(r.level for r in graph.call_trees(edges(spark, *[(f"{k}", f"{k + 1}") for k in range(9)]), spark.createDataFrame([("0",)], "node string"), depth=4).collect()) == 4


def test_statistics_count_isolated_nodes(spark):
    nodes = spark.createDataFrame([("a", "ADSO"), ("b", "ADSO"), ("x", "IOBJ")], "node string, type string")
    found = dict(rows(graph.statistics(edges(spark, ("a", "b"), ("a", "c")), nodes)))
    assert found == {"nodes": 4, "edges": 2, "sources": 1, "sinks": 2, "isolated": 1, "max_fan_in": 1, "max_fan_out": 2, "type:ADSO": 2, "type:IOBJ": 1, "type:unknown": 1}


def test_longest_path_of_a_long_chain(spark):
    """Its length is the layer of its first node in the turned graph."""
    g = edges(spark, *[(f"{k:02}", f"{k + 1:02}") for k in range(66)]).coalesce(1)
    assert rows(graph.longest_paths(g)) == [("00", 66)]


def slow_condensed(pairs):
    """(node, component, size, layer) by who reaches whom."""
    nodes = {x for p in pairs for x in p}
    reach = {a: {a} for a in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            for x in nodes:
                if a in reach[x] and not reach[b] <= reach[x]:
                    reach[x] |= reach[b]
                    changed = True
    of = {a: min(b for b in reach[a] if a in reach[b]) for a in nodes}
    size = {c: sum(of[a] == c for a in nodes) for c in of.values()}
    layer = dict.fromkeys(of.values(), 0)
    for _ in nodes:
        for a, b in pairs:
            if of[a] != of[b]:
                layer[of[b]] = max(layer[of[b]], layer[of[a]] + 1)
    return sorted((a, of[a], size[of[a]], layer[of[a]]) for a in nodes)


@pytest.mark.parametrize("seed", range(4))
def test_any_graph_condenses(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([6, 14, 30])
    pairs = {(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(rng.choice([n // 2, n, 2 * n]))} | {("z1", "z2"), ("z2", "z1"), ("z2", "z3"), ("s", "s")}
    want = slow_condensed(pairs)
    for local in (500_000, 3, 0):
        assert rows(graph.condensed(edges(spark, *pairs), local)) == want
    layer, fed = {a: k for a, _, _, k in slow_condensed({(b, a) for a, b in pairs})}, {b for a, b in pairs if a != b}
    assert rows(graph.longest_paths(edges(spark, *pairs))) == sorted((a, layer[a]) for a in {a for a, b in pairs if a != b} - fed)
    assert rows(graph.layers(edges(spark, *pairs))) == [(a, k) for a, _, _, k in want]


def test_condensation_of_no_edges_and_of_a_long_cycle(spark):
    assert rows(graph.condensed(edges(spark, ("a", "b")).limit(0))) == []
    n = 5000
    ring = spark.range(n).select(F.format_string("%05d", "id").alias("src"), F.format_string("%05d", (F.col("id") + 1) % n).alias("dst"))
    found = graph.condensed(ring.union(spark.createDataFrame([("04999", "x")], "src string, dst string")))
    assert rows(found.groupBy("component", "size", "layer").count()) == [("00000", n, 0, n), ("x", 1, 1, 1)]


def test_whole_parts_are_never_cut():
    import pyarrow as pa

    from cairn.operators.local import whole_parts

    key = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    for size in (1, 2, 3, 11):
        batches = [pa.RecordBatch.from_pydict({"key": key[k : k + size]}) for k in range(0, len(key), size)]
        for together in (1, 2, 4, 100):
            parts = [t.column("key").to_pylist() for t in whole_parts(iter(batches), "key", together)]
            assert sum(parts, []) == key
            assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))
            assert all(len(p) >= together for p in parts[:-1])


def test_stacks_and_violations_of_a_landscape_with_cycles(spark):
    typed = spark.createDataFrame(
        [("r", "a", "ODSO", "ADSO"), ("a", "b", "ADSO", "ADSO"), ("b", "a", "ADSO", "ADSO"), ("b", "c", "ADSO", "ODSO"), ("c", "c", "ODSO", "ODSO"), ("c", "d", "ODSO", "ADSO"), ("d", "p", "ADSO", "HCPR"), ("p", "d", "HCPR", "ADSO"), ("p", "i", "HCPR", "IOBJ")],
        "src string, dst string, src_type string, dst_type string",
    )
    assert rows(graph.deep_stacks(typed)) == [("deep_stack", "r:3", "high")]
    assert rows(graph.layer_violations(typed)) == [
        ("composite_to_characteristic", "p>i", "medium"), ("composite_to_store", "p>d", "medium"), ("cycle", "a", "high"), ("cycle", "d", "high"), ("deep_stack", "r:3", "high"), ("self_loop", "c", "high"),
    ]


def test_places_within_groups_spread_over_tasks(spark):
    rng = random.Random(1)
    data = [(rng.choice("aaab"), rng.randrange(50), k) for k in range(400)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    want = sorted((g, v, k, 1 + sum((w, i) < (v, k) for h, w, i in data if h == g)) for g, v, k in data)
    assert rows(graph.numbered(df, "g", ["v", "id"], "place")) == want


def test_hierarchies_of_any_depth(spark):
    areas = spark.createDataFrame([("n00", "")] + [(f"n{k:02}", f"n{k - 1:02}") for k in range(1, 20)], "area string, parent string")
    assert max(r.level for r in graph.hierarchy_paths(areas).collect()) == 19


def test_blank_ends_are_no_edges(spark):
    assert rows(graph.edges_of(edges(spark, ("a", ""), (None, "b"), ("a", "b"), ("a", "b")))) == [("a", "b")]


def test_hierarchy_below_a_cycle_has_no_path(spark):
    areas = spark.createDataFrame([("r", ""), ("x", "r"), ("p", "q"), ("q", "p")], "area string, parent string")
    assert rows(graph.hierarchy_paths(areas)) == [("r", "r", 0), ("x", "r/x", 1)]


def test_search_takes_underscores_literally(spark):
    objects = spark.createDataFrame([("t", "A_1", "x"), ("t", "AB1", "a_1 here"), ("t", "C", None)], "object_type string, name string, text string")
    assert rows(search.search(objects, "a_1")) == [("t", "AB1", "description"), ("t", "A_1", "name")]


def test_fingerprint_ignores_the_order_of_facts(spark):
    r = spark.createDataFrame([(1, "x", "y")], "id int, a string, b string")
    assert diff.fingerprints(r, "id", ["a", "b"]).first().fingerprint == diff.fingerprints(r, "id", ["b", "a"]).first().fingerprint


def test_users_unknown_without_assignments(spark):
    values = spark.createDataFrame([(1, "c", "*")], "auth int, characteristic string, low string")
    none = spark.createDataFrame([], "auth int, uname string")
    assert rows(governance.users_per_auth(values, none)) == [(1, None)]


def test_loop_depth_is_floored(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["ENDLOOP.", "LOOP AT a.", "* LOOP AT b.", "SELECT * FROM t.", "ENDLOOP.", "SELECT 1."])], "codeid int, line_no int, line string")
    assert [r.depth for r in code.loop_depths(lines).orderBy("line_no").collect()] == [0, 1, 1, 0, 0]
    assert ("select_in_loop", 1) in {(r.pattern, r.occurrences) for r in code.patterns(lines).collect()}


def test_registry_tells_absent_from_refused(spark):
    t = spark.createDataFrame([("a", "A"), ("b", "M")], "x string, OBJVERS string")
    landscape = Landscape({"t": t}, {"secret"})
    assert landscape.require("t") is None
    assert landscape.require("u").reason == "absent_on_system"
    assert landscape.require("u", "secret").reason == "permission_denied"
    assert landscape.require_columns("t", "x", "Y").missing == ["t.Y"]
    assert landscape.active("t").count() == 1 and landscape.raw("t").count() == 2


def test_pages_and_caps(spark):
    df = spark.range(10)
    assert [r.id for r in page(df, ["id"], 3, 4).collect()] == [4, 5, 6]
    first, more = capped(df, ["id"], 10)
    assert first.count() == 10 and not more.first().truncated
    assert capped(df, ["id"], 9)[1].first().truncated


def test_clock(spark):
    assert spark.range(1).select(decode.clock_minutes(F.lit("06:40")).alias("m")).first().m == 400


def test_view_nodes(spark):
    xml = """<C:scenario xmlns:C="urn:c" xmlns:xsi="urn:x"><dataSources><DataSource id="T1" type="T"/><DataSource type="a>b" id="T2"/></dataSources><calculationViews>
    <calculationView xsi:type="C:JoinView" id="J"><input node="#T1" note="x>y"><mapping source="B" target="A"/></input><input node="#T2"/><joinAttribute name="K"/></calculationView>
    <calculationView id="P" xsi:type="C:ProjectionView" filterExpression="A &gt; 1"><input node="#J"/></calculationView></calculationViews></C:scenario>"""
    df = spark.createDataFrame([("V", xml), ("bad", "<!DOCTYPE x>" + xml), ("broken", "<a><b"), ("none", None)], "name string, xml string")
    assert rows(models.view_nodes(df)) == [("V", "J", "JoinView", "T1,T2", "K", ""), ("V", "P", "ProjectionView", "J", "", "A > 1")]
    assert rows(models.view_sources(df)) == [("V", "T1"), ("V", "T2")]
    assert rows(models.view_mappings(df)) == [("V", "J", "T1", "A", "B")]


def test_field_lineage_stops_at_a_cycle(spark):
    hops = spark.createDataFrame([("c", "b", "t", 1), ("c", "x", "t", 0), ("x", "c", "t", 0)], "field string, parent string, kind string, priority int")
    assert rows(models.field_lineage(hops, spark.createDataFrame([("c",)], "field string"))) == [("c", "c", "x", "t", 1, 1), ("c", "x", "c", "t", 0, 2)]


def test_stream_counts_equal_batch(spark, tmp_path):
    log = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), "R" if h == 3 else "G") for h in range(5)] + [("b", dt.datetime(2024, 1, 2), "G")], "chain_id string, started timestamp, status string")
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    q = run_log.run_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == rows(run_log.run_counts(log)) == [("a", dt.datetime(2024, 1, 1), 5, 1), ("b", dt.datetime(2024, 1, 2), 1, 0)]
    assert [r.starts for r in run_log.busy_sessions(log, "2 hours").orderBy("chain_id").collect()] == [5, 1]


def code_of(spark, text):
    return spark.createDataFrame([(1, k, x) for k, x in enumerate(text.split("\n"))], "codeid int, line_no int, line string")


def test_forms(spark):
    lines = code_of(spark, "PERFORM b. perform A using x.\n  PERFORM far\n IN PROGRAM (p).\nx = 1.\nFORM a.\ny = 2.\nFORM inner.\nENDFORM.\nz = 3.\nENDFORM.\nFORM b.\nENDFORM.\nFORM a.\n1.\nENDFORM.\nFORM open.\nx.")
    assert [(r.form, r.line_no) for r in code.form_lines(lines).orderBy("line_no").collect()] == [("A", 5), ("A", 6)]
    assert rows(code.performed(lines)) == [(1, "A", 2), (1, "B", 1)]
    assert rows(code.followed_forms(lines)) == [(1, "A", True, 2), (1, "B", False, 0)]


def test_reads_over_several_lines(spark):
    lines = code_of(spark, "* SELECT x FROM /BIC/ANO00.\nSELECT a b\n  FROM /bic/ademo00 AS x\n  INNER JOIN zown AS y ON x~k = y~k \" FROM never\n  INTO TABLE lt. READ t FROM nothing.\nSELECT * FROM\n  /BI0/PMAT INTO TABLE lt.")
    assert rows(code.table_reads(lines)) == [(1, "/BI0/PMAT", 5), (1, "/BIC/ADEMO00", 1), (1, "ZOWN", 1)]


def test_six_patterns(spark):
    text = "LOOP AT result_package ASSIGNING <r>.\n  SELECT SINGLE t FROM /BIC/ASALES00 INTO lv WHERE spras = 'E'.\n  DO 2 TIMES.\n  ENDDO.\nENDLOOP.\nSELECT * FROM x INTO TABLE y FOR ALL ENTRIES IN lt_x WHERE m = lt_x-m.\nDELETE ADJACENT DUPLICATES FROM lt.\nDELETE lt WHERE m = ''.\nUPDATE /BIC/AX00 SET a = b.\na = 'no condition'.\nSELECT 1 FOR ALL ENTRIES IN source_package.\nSELECT 1 FOR ALL ENTRIES IN lt_ok. IF lt_ok[] IS NOT INITIAL."
    assert {r.pattern: r.occurrences for r in code.patterns(code_of(spark, text)).collect()} == {"nested_loop": 1, "select_in_loop": 1, "hardcoded_value": 2, "recordset_delete": 2, "database_modification": 1, "missing_for_all_entries": 1}
    assert {(r.loops, r.nesting, r.selects, r.tables) for r in code.analysis(code_of(spark, text)).collect()} == {(2, 2, 4, 2)}


def test_four_kinds_of_calls(spark):
    lines = code_of(spark, "CALL FUNCTION 'CONV_X'\n  EXPORTING a = b.\nCALL FUNCTION lv_f.\nlo_h->go( ).\nCALL METHOD cl_x=>run( ).\nPERFORM f.\nPERFORM f USING a.")
    assert rows(code.calls(lines)) == [(1, "class_method", "CL_X=>RUN", 1), (1, "class_method", "LO_H->GO", 1), (1, "dynamic", "(dynamic)", 1), (1, "form", "F", 2), (1, "function_module", "CONV_X", 1)]


def test_names_of_generated_tables(spark):
    names = ["/BIC/ADEMO00", "/BIC/ADEMO40", "/BIC/ADEMO082", "/BI0/PMAT", "/BIC/XCUST", "/ABC/AOWN1", "/BIC/FCUBE", "MARA", "/BIC/A", "/B1H/ATHING2"]
    catalogue = spark.createDataFrame([("dso", "DEMO"), ("adso", "DEMO08"), ("infoobject", "0MAT"), ("adso", "/ABC/OWN")], "kind string, name string")
    found = {r.table_name: (r.object, r.kind, r.role, r.confirmed) for r in search.resolved_tables(spark.createDataFrame([(n,) for n in names], "table_name string"), catalogue).collect()}
    assert found == {
        "/BIC/ADEMO00": ("DEMO", "dso", "active", True), "/BIC/ADEMO40": ("DEMO", "dso", "inbound", True), "/BIC/ADEMO082": ("DEMO08", "adso", "active", True), "/BI0/PMAT": ("0MAT", "infoobject", "master_attr", True),
        "/BIC/XCUST": ("CUST", "infoobject", "master_other", False), "/ABC/AOWN1": ("/ABC/OWN", "adso", "inbound", True), "/BIC/FCUBE": ("CUBE", "infocube", "fact_f", False), "MARA": (None, None, None, False), "/BIC/A": (None, None, None, False),
        "/B1H/ATHING2": ("THING", "adso", "active", False),
    }
    made = spark.range(1).select(*[decode.generated_tables(F.lit(n), F.lit(k)).alias(n + k) for n, k in (("0MAT", "infoobject"), ("/ABC/OWN", "adso"), ("DEMO", "dso"), ("C", "infocube"), ("H", "composite"))]).first()
    assert list(made) == [["/BI0/PMAT"], ["/ABC/AOWN1", "/ABC/AOWN2", "/ABC/AOWN3"], ["/BIC/ADEMO00", "/BIC/ADEMO40"], ["/BIC/FC", "/BIC/EC"], []]


def test_assessment_counts_assessed_scenarios_only(spark):
    scenarios = spark.createDataFrame([("a", "assessed"), ("b", "unsupported"), ("c", "assessed")], "scenario string, status string")
    found = spark.createDataFrame([("a", "x", "high"), ("a", "y", "critical"), ("b", "z", "critical")], "scenario string, object string, severity string")
    assert rows(analysis.assessment(scenarios, found)) == [("a", "assessed", 2, "critical", 82.0, "B"), ("b", "unsupported", None, "critical", 82.0, "B"), ("c", "assessed", 0, None, 82.0, "B")]
    assert rows(analysis.assessment(scenarios, found.limit(0)))[0][-2:] == (100.0, "A")
    assert [r.object for r in analysis.most_severe(found, 2).collect()] == ["y", "z"]


def test_chain_findings(spark):
    log = spark.createDataFrame([("a", k, "G" if k else "R") for k in range(10)] + [("b", k, "G" if k > 4 else "R") for k in range(10)], "chain_id string, log_id int, status string")
    second = 1_000_000
    steps = spark.createDataFrame([("a", str(k), 100 * k * second, (100 * k + (90 if k == 9 else 1)) * second) for k in range(10)] + [("c", "1", 0, 50 * second), ("c", "2", 10 * second, 20 * second)], "chain_id string, log_id string, start_us long, end_us long")
    assert rows(analysis.chain_findings(log, steps)) == [("contention", "a", "medium"), ("contention", "c", "medium"), ("duration_spread", "a", "medium"), ("self_overlap", "c", "high"), ("success_rate", "a", "high"), ("success_rate", "b", "critical")]


def test_snapshot_capture_and_comparability(spark):
    data = [("f", "n1", "A", "x"), ("f", "n1", "B", ""), ("f", "n2", "A", None), ("g", "n1", "A", "x")]
    taken = diff.captured(spark.createDataFrame(data, "family string, name string, s string, c string"), ["s", "c"], 1)
    found = {(r.family, r.name): (r.s, r.c, r.capped) for r in taken.collect()}
    assert found == {("f", "n1"): ("A,B", "x", True), ("g", "n1"): ("A", "x", False)}
    assert rows(diff.comparable_families(taken, taken.where("family = 'f'"))) == [("f", True), ("g", False)]


def test_endpoint_keeps_a_system_with_a_space(spark):
    df = spark.createDataFrame([("DS1      FLAT FILE",), ("DS2",)], "endpoint string")
    assert rows(search.endpoint_parts(df)) == [("DS1      FLAT FILE", "DS1", "FLAT FILE"), ("DS2", "DS2", None)]


def test_contention_counts_by_a_sweep(spark):
    rng = random.Random(8)
    data = []
    for k in range(300):
        s = rng.choice([rng.randrange(4 * runs.HOUR), 7_000_000, runs.HOUR, 30 * 24 * runs.HOUR])
        data.append((rng.choice("aaabcd"), str(k), s, s + rng.choice([0, -5, 1, 10_000_000, 3 * runs.HOUR])))
    w = spark.createDataFrame(data, "chain_id string, log_id string, start_us long, end_us long").repartition(5)
    want = []
    for c in "abcd":
        met = {(log, o, n) for d, log, s, e in data if d == c for o, n, t, _ in data if o != c and s <= t < e}
        if met:
            want.append((c, len(met), len({log for log, _, _ in met}), len({o for _, o, _ in met})))
    assert rows(runs.contention(w)) == want
    assert rows(runs.contention(w.limit(0))) == []


def test_a_target_is_not_its_own_lookup(spark):
    headers = spark.createDataFrame([(1, "T", "ADSO", "S1", "", ""), (2, "T", "ADSO", "S2", "", "")], "tranid long, dst string, dst_type string, startroutine string, endroutine string, expert string")
    full = spark.createDataFrame([("T",)], "target string")
    lookups = spark.createDataFrame([(1, "T"), (1, "L"), (2, "T")], "tranid long, object string")
    rates = spark.createDataFrame([("L", 2.0), ("T", 1.0)], "object string, rate double")
    assert rows(analysis.load_latency(headers, full, lookups, rates)) == [(1, "T", 1, 0, "medium")]


def test_each_ledger_has_its_own_codes(spark):
    requests = spark.createDataFrame([("p", "tsn", "X"), ("p", "tsn", ""), ("p", "classic", ""), ("p", "classic", "GG"), ("p", "classic", "@08@"), ("p", "tsn", "@08@"), ("p", "tsn", "yg "), ("p", "classic", "@0a@")], "provider string, ledger string, code string")
    assert rows(governance.request_statuses(requests)) == [("p", "housekeeping", 2), ("p", "success", 2), ("p", "unknown", 4)]


def test_call_trees_tell_where_they_stop(spark):
    calls = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))
    assert rows(graph.call_trees(calls, spark.createDataFrame([("a",)], "node string"), depth=2)) == [("a", "a", 0, False), ("a", "a>b", 1, False), ("a", "a>b>c", 2, True)]


def test_snapshots_are_listed_only_when_published(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert rows(store.list()) == [] and store.latest("P") is None and store.get("a") is None
    make = lambda *names: diff.captured(spark.createDataFrame([(f, n, v) for f, n, v in names], "family string, name string, fact string"), ["fact"], 10)
    at = lambda k: dt.datetime(2024, 1, k)
    store.put("a", make(("f", "x", "1"), ("f", "y", "1"), ("g", "z", "1")), "P", at(1))
    store.put("b", make(("f", "x", "2"), ("f", "w", "1"), ("f", "y", "1"), ("h", "z", "1")), "P", at(2))
    store.put("c", make(("f", "x", "2")), "Q", at(3))
    make(("f", "q", "1")).write.parquet(f"file://{tmp_path}/store/data/snapshot_id=torn/part=1")
    assert [(r.snapshot_id, r.objects, r.families, r.capped) for r in store.list().collect()] == [("c", 1, ["f"], False), ("b", 4, ["f", "h"], False), ("a", 3, ["f", "g"], False)]
    assert [r.snapshot_id for r in store.list("P", 1).collect()] == ["b"] and store.latest("P", at(2)) == "a" and store.get("torn") is None
    assert rows(store.compare("a", "b")) == [("f", "w", "added"), ("f", "x", "changed"), ("f", "y", "unchanged"), ("g", "z", "not_comparable"), ("h", "z", "not_comparable")]
    files = store.compare("a", "b").inputFiles()
    assert files and all("snapshot_id=a/" in f or "snapshot_id=b/" in f for f in files)
    store.put("a", make(("f", "x", "2")), "P", at(4))
    assert rows(store.get("a").select("family", "name", "fact")) == [("f", "x", "2")] and store.latest("P") == "a"
    assert store.delete("a") and not store.delete("a") and store.latest("P") == "b"
    with pytest.raises(KeyError):
        store.compare("a", "b")


def test_captured_keeps_the_first_names_of_a_family(spark):
    data = [("f", f"n{k:03}", str(k)) for k in range(300)] + [("g", "a", "1"), ("g", "a", "2"), ("g", "b", " ")]
    got = diff.captured(spark.createDataFrame(data, "family string, name string, fact string").repartition(4), ["fact"], 7)
    assert rows(got.select("family", "name", "fact", "capped")) == [("f", f"n{k:03}", str(k), True) for k in range(7)] + [("g", "a", "1,2", False), ("g", "b", "", False)]


def test_tokens_tell_keywords_from_literals_and_names(spark):
    text = lambda *lines: spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)], "codeid int, line_no int, line string")
    found = lambda *lines: dict(rows(code.patterns(text(*lines)).select("pattern", "occurrences")))
    assert found("a = 'loop at x'.", "select single a from zt into b where c = d.") == {}
    assert found("do 3 times.", "loop at lt.", "select a from zt where k = 'X'.", "endloop.", "enddo.") == {"nested_loop": 1, "select_in_loop": 1, "hardcoded_value": 1}
    assert found("lo_do = 1.", "x-select = 2.") == {}
    assert found("delete from /bic/atab00 where a = b.", "delete lt_x where a = b.", "delete adjacent duplicates from lt.", "modify lt from ls.") == {"database_modification": 1, "recordset_delete": 2}
    assert found("select * from t for all entries in @( lt_a ) where a = b.", "select * from t for all entries in lt_b where a = b.", "select * from t for all entries in source_package.", "if lt_b[] is not initial.") == {"missing_for_all_entries": 1}
    assert found("select * from t for all entries in lt_c.", "if lines( lt_c ) > 0.") == {} == found("select * from t for all entries in lt_d.", "describe table lt_d lines n.")
    called = text("call function 'Z_ONE'.", "call function lv_f.", "zcl_a=>run( ).", "me->go( ).", "lv = lo_x->y.", "perform f1 using a.")
    assert rows(code.calls(called)) == [(1, "class_method", "ME->GO", 1), (1, "class_method", "ZCL_A=>RUN", 1), (1, "dynamic", "(dynamic)", 1), (1, "form", "F1", 1), (1, "function_module", "Z_ONE", 1)]


MODEL = """<Composite:compositeView xmlns:Composite="c" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" name="M" defaultNode="#///T">
<viewNode xsi:type="View:JoinNode" name="T"><input alias="U"><viewNode xsi:type="View:Union">#///U</viewNode><mapping xsi:type="Type:ElementMapping" targetName="Out" sourceName="mid"/><mapping xsi:type="Type:ElementMapping" targetName="Lost" sourceName="none"/></input>
<input alias="T.CALC.1"><entity>A/B/CV_X.calculationview#/</entity><mapping xsi:type="Type:ElementMapping" targetName="OUT" sourceName="C"/><mapping xsi:type="Type:Odd" targetName="Odd" sourceName="o"/></input></viewNode>
<viewNode xsi:type="View:Union" name="U"><input alias="U.ADSO.1"><entity>$NS$ONE.composite#//</entity><mapping xsi:type="Type:ElementMapping" targetName="MID" sourceName="F1"/></input>
<input alias="U.FBPA.2"><entity>TWO.x.composite#//</entity><mapping xsi:type="Type:ConstantElementMapping" targetName="MID" sourceName="ignored"/></input><input alias="T"><viewNode>#///T</viewNode><mapping targetName="MID" sourceName="OUT"/></input></viewNode></Composite:compositeView>"""


def test_fields_of_a_composite_through_its_stack(spark):
    models = spark.createDataFrame([("M", MODEL), ("E", None), ("D", "<!doctype a><Composite:compositeView/>"), ("B", "<Composite:compositeView><a>"), ("O", "<?xml version='1.0'?><x/>"), ("N", "<!-- c --><compositeView/>")], "name string, xml string")
    assert rows(composites.statuses(models)) == [("B", "not_well_formed", None, None), ("D", "document_type", None, None), ("E", "empty", None, None), ("M", "parsed", 2, 5), ("N", "parsed", 0, 0), ("O", "other_root", None, None)]
    assert rows(composites.parts(models).fillna("")) == [("M", "/NS/ONE", "adso", "ADSO", ""), ("M", "A/B/CV_X", "calcview", "CALC", "A.B/CV_X"), ("M", "TWO.x", "unknown", "FBPA", "")]
    got = composites.resolved_fields(models).select("field", "stop", "part", "source", "node", "asked", "via", "hops")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("Lost", "no_mapping", None, None, "U", "NONE", "U", 1), ("OUT", "constant", "TWO.x", None, "U", "MID", "U>U.FBPA.2", 2), ("OUT", "loop", None, "OUT", "U", "MID", "U>T", 2), ("OUT", "object", "/NS/ONE", "F1", "U", "MID", "U>U.ADSO.1", 2),
        ("OUT", "object", "A/B/CV_X", "C", "T", "OUT", "T.CALC.1", 1), ("Odd", "object", "A/B/CV_X", "o", "T", "ODD", "T.CALC.1", 1),
    ], key=str)
    assert {r.stop for r in composites.resolved_fields(models, depth=0).collect()} == {"object", "too_deep"}
    assert composites.resolved_fields(models.limit(0)).count() == 0
