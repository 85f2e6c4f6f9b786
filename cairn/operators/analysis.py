"""Composed analyses: findings (scenario, object, severity) of chains, loads, streams and dashboards, and what they say of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import runs as chain_runs
from cairn.operators.graph import finding, merged_streams, union_of
from cairn.operators.search import field_collisions
from cairn.plans.cut import cut


def chain_findings(runs: DataFrame, steps: DataFrame, spread: float = 3.0) -> DataFrame:
    """Findings of every chain: success below .80 critical, below .95 high; with more than one run, a 95th percentile above `spread` times the median medium;
    runs that overlap their own chain high; starts of other chains within its runs medium."""
    rate = chain_runs.success_rates(runs).where("success_rate < 0.95").select(*finding("success_rate", F.col("chain_id"), F.when(F.col("success_rate") < 0.8, "critical").otherwise("high")))
    varied = chain_runs.durations(steps).where((F.col("runs") > 1) & (F.col("median_s") > 0) & (F.col("p95_s") > spread * F.col("median_s"))).select(*finding("duration_spread", F.col("chain_id"), "medium"))
    windows = cut(chain_runs.run_windows(steps))
    overlap = chain_runs.self_overlaps(windows).select(*finding("self_overlap", F.col("chain_id"), "high")).distinct()
    disturbed = chain_runs.disturbances(windows).select(*finding("contention", F.col("chain_id"), "medium"))
    return union_of([rate, varied, overlap, disturbed])


def load_latency(headers: DataFrame, full_targets: DataFrame, lookups: DataFrame, rates: DataFrame) -> DataFrame:
    """(tranid, target, lookups, stale, severity) of transformations with routines into stores that are loaded in full and look something
    up: medium; high where a lookup is loaded less often than the target, or with three or more of them.

    headers: (tranid, dst, dst_type, startroutine, endroutine, expert); full_targets: (target); lookups: (tranid, object); rates: (object, rate). What
    reads its own target isn't looking it up.
    """
    own = headers.where("(startroutine <> '' OR endroutine <> '' OR expert <> '') AND dst_type IN ('ADSO', 'ODSO')").select("tranid", F.col("dst").alias("target"))
    own = own.join(full_targets.select("target").distinct(), "target", "left_semi")
    rate = lambda name: rates.select(F.col("object").alias(name), F.col("rate").alias(f"{name}_rate"))
    read = own.join(lookups.select("tranid", "object").distinct(), "tranid").where("object <> target").join(rate("object"), "object", "left").join(rate("target"), "target", "left")
    stale = F.coalesce(decode.stale_lookup(F.col("object_rate"), F.col("target_rate")), F.lit(False))
    per = read.groupBy("tranid", "target").agg(F.count("*").alias("lookups"), F.count_if(stale).alias("stale"))
    return per.withColumn("severity", F.when((F.col("stale") > 0) | (F.col("lookups") >= 3), "high").otherwise("medium"))


def merged_stream_findings(edges: DataFrame, streams: DataFrame) -> DataFrame:
    """(target, sources, collisions, severity) of targets that several sources feed: high where more than one stream fills a field."""
    clashes = field_collisions(streams).groupBy("target").agg(F.count("*").alias("n"))
    merged = merged_streams(edges).select("target", "sources").join(clashes, "target", "left")
    n = F.coalesce("n", F.lit(0))
    return merged.select("target", "sources", n.alias("collisions"), F.when(n > 0, "high").otherwise("medium").alias("severity"))


def dashboard_bypasses(dashboards: DataFrame, consumers: DataFrame) -> DataFrame:
    """(dashboard, view, shared_with, severity) of dashboards (dashboard, view) that read a view themselves: high where the warehouse's own
    objects (view, provider) read it too, else medium."""
    shared = consumers.groupBy("view").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("shared_with"))
    out = dashboards.join(shared, "view", "left")
    return out.select("dashboard", "view", F.coalesce("shared_with", F.lit("")).alias("shared_with"), F.when(F.col("shared_with").isNotNull(), "high").otherwise("medium").alias("severity"))


def assessment(scenarios: DataFrame, findings: DataFrame) -> DataFrame:
    """(scenario, status, findings, worst, score, grade): every scenario (scenario, status) with its findings and the most severe of them, and
    the score of the whole, which counts the findings of assessed scenarios only."""
    counted = cut(findings.groupBy("scenario", "severity").agg(F.count("*").alias("n")))
    per = counted.groupBy("scenario").agg(F.sum("n").alias("n"), F.min_by("severity", decode.severity_rank(F.col("severity"))).alias("worst"))
    weights = F.create_map(*[F.lit(x) for pair in decode.SEVERITY_WEIGHTS.items() for x in pair])
    assessed = scenarios.where("status = 'assessed'").select("scenario")
    lost = counted.join(assessed, "scenario", "left_semi").agg(F.coalesce(F.sum(weights[F.col("severity")] * F.col("n")), F.lit(0.0)).alias("lost"))
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("lost"))
    out = scenarios.join(per, "scenario", "left").crossJoin(F.broadcast(lost)).withColumn("score", score)
    return out.select("scenario", "status", F.when(F.col("status") == "assessed", F.coalesce("n", F.lit(0))).alias("findings"), "worst", "score", decode.bands(F.col("score"), decode.GRADES, "E", upper=False).alias("grade"))


def most_severe(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The `limit` most severe findings; of equals those that sort first."""
    return findings.orderBy(decode.severity_rank(F.col("severity")), "scenario", "object").limit(limit)


def change_impact(impacts: DataFrame, lookups: DataFrame, queries: DataFrame) -> DataFrame:
    """(object, relationship, affected, severity): what a change of an object reaches: objects that it feeds and transformations that look it up
    high, queries on it medium. Of several rows of an object and relationship the declared one counts, not the advisory."""
    fed = impacts.where("kind = 'all'").select(F.col("root").alias("object"), F.lit("feeds").alias("relationship"), "affected", F.lit("high").alias("severity"))
    read = lookups.groupBy("object").agg(F.countDistinct("tranid").alias("affected")).select("object", F.lit("looked_up").alias("relationship"), "affected", F.lit("high").alias("severity"))
    asked = queries.groupBy("object").agg(F.count("*").alias("affected")).select("object", F.lit("queried").alias("relationship"), "affected", F.lit("medium").alias("severity"))
    return union_of([fed, read, asked])


def declared_first(items: DataFrame) -> DataFrame:
    """One row per (object, relationship) of items (object, relationship, advisory, note): a declared one before an advisory, then by note."""
    first = Window.partitionBy("object", "relationship").orderBy("advisory", "note")
    return items.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def impact_items(fed: DataFrame, looked_up: DataFrame, queries: DataFrame, views: DataFrame) -> DataFrame:
    """(object, affected, relationship, severity, advisory): what a change of each object reaches, by name: objects that it feeds and calculation views
    that read it high, loads that look it up high (object, affected, advisory), queries on it medium; each (object, affected). One affected
    in several ways is listed once by a declared relationship if there is one, then by the most severe, then by name."""
    kind = lambda df, name, severity, advisory: df.select("object", "affected", F.lit(name).alias("relationship"), F.lit(severity).alias("severity"), advisory.alias("advisory"))
    no = F.lit(False)
    every = union_of([kind(fed, "feeds", "high", no), kind(looked_up, "looked_up", "high", F.col("advisory")), kind(queries, "queried", "medium", no), kind(views, "calculation_view", "high", no)]).where("object <> affected").distinct()
    first = F.min(F.struct("advisory", decode.severity_rank(F.col("severity")).alias("rank"), "relationship", "severity"))
    return every.groupBy("object", "affected").agg(first.alias("f")).select("object", "affected", "f.relationship", "f.severity", "f.advisory")


def currency_spread(parts: DataFrame, least: int = 30, high: int = 365) -> DataFrame:
    """(object, parts, spread_days, severity) of unions (object, age_days of a part) whose parts are `least` days or more apart in age: high where the oldest
    is more than `high` days old, else medium."""
    per = parts.groupBy("object").agg(F.count("*").alias("parts"), (F.max("age_days") - F.min("age_days")).alias("spread_days"), F.max("age_days").alias("oldest"))
    return per.where(F.col("spread_days") >= least).withColumn("severity", F.when(F.col("oldest") > high, "high").otherwise("medium")).drop("oldest")
