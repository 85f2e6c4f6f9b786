"""A routine that many transformations share is dealt over groups."""

import pytest

from cairn.operators import routines


@pytest.mark.parametrize("rows", [1 << 22, 50, 1])
def test_source_of_shared_routines(spark, rows):
    refs = [(t, c, "start", None, 1) for t, c in [*((t, "G") for t in range(40)), (1, "S"), (2, "none"), (-7, "G")]]
    lines = [("G", k, f"g{k}") for k in range(9)] + [("S", 1, "s"), ("unused", 1, "u")]
    r = spark.createDataFrame(refs, "tranid long, codeid string, kind string, rule_id long, place int")
    code = spark.createDataFrame(lines, "codeid string, line_no long, line string")
    got = sorted(map(tuple, routines.routine_source(r, code, 3, rows).collect()), key=str)
    own = lambda c: [x[1:] for x in lines if x[0] == c] or [(None, None)]
    assert got == sorted((ref + x for ref in refs for x in own(ref[1])), key=str)


def test_no_task_holds_a_shared_routine(spark):
    refs = spark.range(2000).selectExpr("id AS tranid", "'G' AS codeid", "'start' AS kind", "CAST(NULL AS LONG) AS rule_id", "1 AS place")
    code = spark.range(100).selectExpr("'G' AS codeid", "id AS line_no", "'x' AS line")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = routines.routine_source(refs, code, 3, 2000)
        counts = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(counts) == 200_000 and max(counts) < 100_000
