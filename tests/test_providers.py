"""Providers: headers, fields read back from generated columns, coverage by loads, kinds by ledgers, and the list of queries."""

from cairn.operators import providers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns_are_read_back_by_the_catalogue(spark):
    columns = spark.createDataFrame([(c,) for c in ("/BIC/ZA", "/BI0/MAT", "BILL", "/NS/X", "own", "/BIC/", " ", "bill")], "column string")
    known = spark.createDataFrame([("ZA",), ("0MAT",), ("0BILL",), ("OWN",)], "name string")
    assert rows(providers.column_infoobjects(columns, known)) == [
        ("/BI0/MAT", "0MAT", "confirmed"), ("/BIC/ZA", "ZA", "confirmed"), ("/NS/X", "/NS/X", "inferred"), ("BILL", "0BILL", "confirmed"), ("bill", "0BILL", "confirmed"), ("own", "OWN", "confirmed"),
    ]
    assert {(r.column, r.infoobject, r.resolution) for r in providers.column_infoobjects(columns, None).collect()} == {
        ("/BI0/MAT", "MAT", "inferred"), ("/BIC/ZA", "ZA", "inferred"), ("/NS/X", "/NS/X", "inferred"), ("BILL", "0BILL", "inferred"), ("bill", "0BILL", "inferred"), ("own", "0OWN", "inferred")}


def test_fields_of_every_kind_of_provider(spark):
    make = spark.createDataFrame
    stored = make([("D", "F", 2, ""), ("D", "F", 1, "X"), ("D", "C__A", 3, None), ("D", " ", 4, "X")], "provider string, field string, position int, key string")
    columns = make([("A", "/BIC/ZK", 1), ("A", "BILL", 2), ("A", "BILL", 5)], "provider string, column string, position int")
    keys = make([("A", "0bill"), ("B", "/BIC/ZK")], "provider string, field string")
    navigations = make([("C__A", "C", "A"), ("", "X", "Y")], "name string, characteristic string, attribute string")
    fields = providers.provider_fields(stored, columns, keys, navigations, make([("0BILL",)], "name string"))
    assert rows(fields) == [
        ("A", "/BIC/ZK", 1, False, "field", None, None, "ZK", "inferred"), ("A", "BILL", 2, True, "field", None, None, "0BILL", "confirmed"), ("D", "C__A", 3, False, "navigation_attribute", "C", "A", "C__A", "declared"), ("D", "F", 1, True, "field", None, None, "F", "declared"),
    ]
    head = lambda *names: make([(n, " ", "me") for n in names], "name string, area string, owner string")
    cubes = make([("M", "m", "ACT ", "AR", ""), ("O", "?", "INA", None, "o")], "name string, type string, status string, area string, owner string")
    found = providers.headers(head("D"), head("A"), cubes, head("P"), head(" ", "I"))
    assert rows(found.select("name", "kind", "active", "area")) == [("A", "adso", True, None), ("D", "dso", True, None), ("I", "infoobject", True, None), ("M", "multiprovider", True, "AR"), ("O", "infocube", False, None), ("P", "compositeprovider", True, None)]
    about = providers.described(found, fields, make([("P", "D"), ("P", "A"), ("P", "A")], "composite string, part string"))
    assert {r.name: (r.fields, r.keys, r.navigation_attributes, r.inferred, r.parts, r.key_names) for r in about.collect()} == {"A": (2, 1, 0, 1, 0, "BILL"), "D": (2, 1, 1, 0, 0, "F"), "I": (0, 0, 0, 0, 0, ""), "M": (0, 0, 0, 0, 0, ""), "O": (0, 0, 0, 0, 0, ""), "P": (0, 0, 0, 0, 2, "")}


def test_ledgers_coverage_and_queries(spark):
    make = spark.createDataFrame
    classic, newer = make([("a", "odso"), ("a", "ZZ"), ("b", "XX"), ("c", "FLEX_M")], "provider string, code string"), make([("b", "ADSO"), ("c", "CUBE"), ("d", "HCPR")], "provider string, code string")
    assert rows(providers.inferred_kinds(classic, newer)) == [("a", "dso", "classic"), ("b", "adso", "newer"), ("c", "infoobject", "classic"), ("d", None, None)]
    loaded = make([("t", c, "F" if c < "c3" else "D", "daily") for c in ("c1", "c2", "c3", "c4", "c5")] + [("i", "c1", "F", "weekly")], "name string, chain string, updmode string, cadence string")
    assert rows(providers.load_coverage(loaded, make([("t",), ("u",)], "name string"))) == [("i", "loaded_not_enumerated", 1, "F", "weekly", "c1"), ("t", "loaded", 5, "D,F", "daily", "c1,c2,c3 (+2)"), ("u", "unloaded", 0, "", "", "")]
    directory = make([("q", "!!A", "", 1, "A", "ACT"), ("q", "!!A", "", 1, "M", "ACT"), ("r", "B", "me", 2, "A", "ACT"), ("s", "C", "me", 3, "A", "INA"), ("k", "STRUCT", "me", 3, "A", "ACT")], "query string, name string, owner string, last_used int, version string, status string")
    got = providers.query_list(directory, make([("q",), ("r",), ("s",)], "query string"), make([("r", "P2"), ("r", "P1")], "query string, provider string"))
    assert rows(got) == [("q", "!!A", None, 1, "ad_hoc", None, 0), ("r", "B", "me", 2, "designed", "P1", 2)]
