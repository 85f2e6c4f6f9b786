"""Snapshots of facts: fingerprints, differences and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import decode


def fingerprints(rows: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """(id, fingerprint, facts) of rows, each column of `facts` a fact."""
    named = F.create_map(*[x for f in facts for x in (F.lit(f), F.col(f).cast("string"))])
    return rows.select(F.col(key).alias("id"), decode.fingerprint(named).alias("fingerprint"), named.alias("facts"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, change): added, removed, changed or unchanged between two tables of (id, fingerprint)."""
    a, b = left.select("id", F.col("fingerprint").alias("was")), right.select("id", F.col("fingerprint").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def changed_facts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(fact, objects): how many objects of both tables differ in each fact."""
    both = left.select("id", F.col("facts").alias("was")).join(right.select("id", F.col("facts").alias("now")), "id")
    differs = F.map_filter(F.map_zip_with("was", "now", lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)
    return both.select(F.explode(F.map_keys(differs)).alias("fact")).groupBy("fact").agg(F.count("*").alias("objects"))


def rekeyed(removed: DataFrame, added: DataFrame, signature: str) -> DataFrame:
    """(old_id, new_id) of removed and added rows (id, signature) whose signature is the only one of its kind on both sides."""
    single = lambda df, name: df.groupBy(signature).agg(F.count("*").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return single(removed, "old_id").join(single(added, "new_id"), signature).select("old_id", "new_id")


def merged_variants(rows: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Per key, each fact's distinct values that aren't blank, sorted and joined by commas."""
    return rows.groupBy(key).agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.trim(F.col(f).cast("string")) != "", F.col(f).cast("string")))), ",").alias(f) for f in facts])


def drift(declared: DataFrame, mapped: DataFrame) -> DataFrame:
    """(code, finding, severity) between declared codes and the codes a decode table (code, label) knows."""
    a, b = declared.select("code", F.col("label").alias("declared")), mapped.select("code", F.col("label").alias("mapped"))
    both = a.join(b, "code", "full_outer")
    finding = F.when(F.col("mapped").isNull(), "unmapped").when(F.col("declared").isNull(), "undeclared").when(F.col("declared") != F.col("mapped"), "label_differs")
    severity = F.when(F.col("mapped").isNull(), "high").when(F.col("declared").isNull(), "info").otherwise("low")
    return both.select("code", finding.alias("finding"), severity.alias("severity")).where("finding IS NOT NULL")


def domain_drift(decoded: DataFrame, declared: DataFrame) -> DataFrame:
    """(domain, code, finding, severity) between decode tables (domain, code, label, complete) and the dictionary (domain, code, label) of one system.

    A domain that the dictionary doesn't hold at all is one finding, domain_absent, high, and its codes aren't compared. Otherwise a declared
    code without a decode is unmapped, high where the table claims to be complete and info where it doesn't; a decoded one that isn't
    declared is undeclared, info; another label low. A declared domain without any decode table is not_decoded, info.
    """
    ours = decoded.groupBy("domain").agg(F.bool_and("complete").alias("complete"))
    theirs = declared.select("domain", F.lit(True).alias("there")).distinct()
    sides = ours.join(theirs, "domain", "full_outer")
    whole = sides.select("domain", F.when(F.col("there").isNull(), "domain_absent").when(F.col("complete").isNull(), "not_decoded").alias("finding")).where("finding IS NOT NULL")
    whole = whole.select("domain", F.lit(None).cast("string").alias("code"), "finding", F.when(F.col("finding") == "domain_absent", "high").otherwise("info").alias("severity"))
    both = sides.where("there AND complete IS NOT NULL").select("domain", "complete")
    a, b = declared.select("domain", "code", F.col("label").alias("declared")), decoded.select("domain", "code", F.col("label").alias("mapped"))
    codes = a.join(b, ["domain", "code"], "full_outer").join(both, "domain")
    finding = F.when(F.col("mapped").isNull(), "unmapped").when(F.col("declared").isNull(), "undeclared").when(F.col("declared") != F.col("mapped"), "label_differs")
    severity = F.when(F.col("mapped").isNull(), F.when(F.col("complete"), "high").otherwise("info")).when(F.col("declared").isNull(), "info").otherwise("low")
    return codes.select("domain", "code", finding.alias("finding"), severity.alias("severity")).where("finding IS NOT NULL").unionByName(whole)


def severity_score(findings: DataFrame) -> DataFrame:
    """One row: findings by severity and the score that remains of 100, with its grade."""
    counts = {s: F.count_if(F.col("severity") == s) for s in decode.SEVERITY_WEIGHTS}
    row = findings.agg(*[n.alias(s) for s, n in counts.items()])
    lost = sum((F.col(s) * w for s, w in decode.SEVERITY_WEIGHTS.items()), F.lit(0.0))
    row = row.withColumn("score", F.greatest(F.lit(0.0), F.lit(100.0) - lost))
    return row.withColumn("grade", decode.bands(F.col("score"), decode.GRADES, "E", upper=False))


#: Parts into which the names of a family are dealt before its first ones are chosen.
PARTS = 64


def captured(rows: DataFrame, facts: list[str], most: int | None) -> DataFrame:
    """A snapshot (family, name, facts..., fingerprint, capped) of rows (family, name, facts...): variants of a name are merged; of a family the
    first `most` names are kept (all if None), and capped tells where there were more. Each part of a family gives at most its first `most` names to
    the task that chooses among them."""
    merged = merged_variants(rows.withColumn("key", F.struct("family", "name")), "key", facts).select("key.family", "key.name", *facts)
    named = F.create_map(*[x for f in facts for x in (F.lit(f), F.col(f))])
    if most is None:
        return merged.select("family", "name", *facts, decode.fingerprint(named).alias("fingerprint"), F.lit(False).alias("capped"))
    dealt = merged.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(PARTS)))
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("name"))).where(F.col("n") <= most).drop("n")
    kept = first(first(dealt, "family", "part").drop("part"), "family")
    sizes = merged.groupBy(F.col("family").alias("sized")).agg((F.count("*") > most).alias("capped"))
    return kept.join(sizes, F.col("family").eqNullSafe(F.col("sized"))).withColumn("fingerprint", decode.fingerprint(named)).select("family", "name", *facts, "fingerprint", "capped")


def comparable_families(left: DataFrame, right: DataFrame) -> DataFrame:
    """(family, comparable) of two snapshots: a family that one of them doesn't hold can't be compared."""
    sides = left.select("family").distinct().withColumn("l", F.lit(True)).join(right.select("family").distinct().withColumn("r", F.lit(True)), "family", "full_outer")
    return sides.select("family", (F.col("l").isNotNull() & F.col("r").isNotNull()).alias("comparable"))
