"""Older flows: what is sent on the way is short."""

from cairn.operators import governance


def frames(spark):
    sources = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (2, 10, None), (None, 11, 6), (3, 99, 5)], "datasource long, structure long, infosource long")
    rules = spark.createDataFrame([(10, "X", None, ""), (10, "", "F", "K"), (10, None, None, None), (11, "X", "F", "K"), (12, "", "", "")], "structure long, routine string, formula string, constant string")
    return sources, rules, spark.createDataFrame([(10,), (10,)], "structure long"), spark.createDataFrame([(2,), (2,)], "datasource long"), spark.createDataFrame([(5, "b"), (5, "a"), (5, "a")], "infosource long, target string")


def test_older_flows(spark):
    got = {tuple(r) for r in governance.older_flows(*frames(spark)).collect()}
    assert got == {(1, 10, 5, 3, 1, 1, 1, True, False, "a,b"), (2, 10, None, 3, 1, 1, 1, True, True, ""), (None, 11, 6, 1, 1, 1, 1, False, False, "")}
    assert governance.older_flows(*frames(spark)).count() == 3


def test_profiles_are_not_sent_by_datasource(spark):
    """Only sources as they are go by datasource, before their structure's profile widens them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = governance.older_flows(*frames(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    by_datasource = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(datasource" in line]
    depth = lambda k: len(lines[k]) - len(lines[k].lstrip(" :+-*()0123456789"))
    assert by_datasource
    for k in by_datasource:
        below = [line for j, line in enumerate(lines[k + 1 :], k + 1) if all(depth(i) > depth(k) for i in range(k + 1, j + 1))]
        assert not any("Join" in line for line in below), "an exchange by datasource stands above a join"
