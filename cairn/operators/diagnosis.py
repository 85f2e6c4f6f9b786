"""Why a report's figures look wrong or are missing: which objects hold its data, whether that arrived and was loaded, and what else explains it.

Everything is a table over all targets at once: (target, provider) says what a target reads; a provider that is no query's is its own target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators.graph import union_of

#: Kinds of providers that hold no data of their own; days after which a load is late, and badly late; days by which parts of a
#: union differ in age, and the age from which that is grave.
UNIONS = ["multiprovider", "compositeprovider"]
LATE, VERY_LATE = 1, 7
APART, LONG_AGO = 30, 365


def bearers(targets: DataFrame, kinds: DataFrame, parts: DataFrame, most: int | None = None) -> DataFrame:
    """(target, provider, part_of, source, diagnosed): the objects that hold the data of each target (target, provider).

    A provider that is no union holds its own (`not_union`); a union (by kinds (provider, kind)) holds none, so its parts (composite, part) take
    its place, each once per union (`parts`). One of unknown kind, or a union without readable parts, stays as it is, as `unresolved`: that
    is a gap, not an empty union. Parts that are unions themselves aren't opened again. diagnosed is false beyond a target's first
    `most` objects by name (None: all are diagnosed). Blank names are left out.
    """
    kind = kinds.groupBy("provider").agg(F.min("kind").alias("kind"))
    of = parts.where("trim(coalesce(part, '')) <> ''").select(F.col("composite").alias("provider"), "part").distinct()
    read = targets.where("trim(coalesce(provider, '')) <> ''").select("target", "provider").distinct()
    opened = read.join(kind, "provider", "left").join(of, "provider", "left")
    source = F.when(F.col("kind").isNull(), "unresolved").when(~F.col("kind").isin(UNIONS), "not_union").when(F.col("part").isNull(), "unresolved").otherwise("parts")
    by_part = F.col("source") == "parts"
    out = opened.withColumn("source", source).select("target", F.when(by_part, F.col("part")).otherwise(F.col("provider")).alias("provider"), F.when(by_part, F.col("provider")).alias("part_of"), "source").distinct()
    if most is None:
        return out.withColumn("diagnosed", F.lit(True))
    return out.withColumn("diagnosed", F.dense_rank().over(Window.partitionBy("target").orderBy("provider")) <= most)


def _risk(df: DataFrame, name: str, severity: Column | str, metric: Column | None = None) -> DataFrame:
    return df.select("provider", F.lit(name).alias("risk"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(None) if metric is None else metric).cast("string").alias("metric"))


def load_health(requests: DataFrame, volumes: DataFrame) -> DataFrame:
    """(provider, requests, failed, last_status, age_days, active_records) of providers with requests (provider, rnr, started, status) or volumes
    (provider, active_records). age_days counts from the last success to the newest request of all; null where nothing succeeded."""
    newest = requests.agg(F.max("started").alias("today"))
    succeeded = F.max(F.when(F.col("status") == "success", F.col("started")))
    per = requests.groupBy("provider").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "error").alias("failed"), F.max_by("status", F.struct("started", "rnr")).alias("last_status"), succeeded.alias("succeeded"))
    both = per.crossJoin(F.broadcast(newest)).join(volumes.groupBy("provider").agg(F.sum("active_records").alias("active_records")), "provider", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("provider", zero("requests"), zero("failed"), "last_status", F.datediff("today", "succeeded").alias("age_days"), "active_records")


def provider_risks(providers: DataFrame, health: DataFrame, chains: DataFrame, frozen: DataFrame, routines: DataFrame) -> DataFrame:
    """(provider, risk, severity, metric): what each provider (provider) shows, in the order in which one would ask.

    Without any active record, or with a last request that failed or is incomplete: critical. Last loaded more than a day before the newest request:
    medium, more than a week: high. Failed requests on record: medium. Loaded by no chain (provider): high, or medium where an inactive
    loader (provider) shows that it once was. Inbound transformations with routines (provider, tranid): medium, as code may drop rows.
    What can't be read (a null count, age or status) is no risk.
    """
    every = providers.select("provider").distinct()
    seen = every.join(health, "provider")
    age = F.col("age_days")
    once = frozen.groupBy("provider").agg(F.count("*").alias("loaders"))
    orphans = every.join(chains.select("provider").distinct(), "provider", "left_anti").join(once, "provider", "left")
    coded = routines.groupBy("provider").agg(F.countDistinct("tranid").alias("coded"))
    was = F.col("loaders").isNotNull()
    return union_of([
        _risk(seen.where("active_records = 0"), "no_rows", "critical"), _risk(seen.where("last_status IN ('error', 'incomplete')"), "last_load_failed", "critical", F.col("last_status")),
        _risk(seen.where(age > LATE), "late", F.when(age > VERY_LATE, "high").otherwise("medium"), age), _risk(seen.where("failed > 0"), "failed_requests", "medium", F.col("failed")),
        _risk(orphans, "no_loader", F.when(was, "medium").otherwise("high"), F.col("loaders")), _risk(every.join(coded, "provider"), "routines", "medium", F.col("coded")),
    ])


def mixed_currency(parts: DataFrame) -> DataFrame:
    """(part_of, parts, known, spread_days, oldest_days, stale_parts, current_parts, stale_records, severity) of unions whose parts (part_of, provider,
    age_days, active_records) differ in age by a month or more: high where the oldest is more than a year behind, else medium.

    Parts of unknown age count only in parts; stale ones are a month or more behind, current ones loaded within a day.
    """
    age = F.col("age_days")
    stale = age >= APART
    per = parts.groupBy("part_of").agg(
        F.count("*").alias("parts"), F.count("age_days").alias("known"), (F.max(age) - F.min(age)).alias("spread_days"), F.max(age).alias("oldest_days"), F.count_if(stale).alias("stale_parts"), F.count_if(age < LATE).alias("current_parts"),
        F.coalesce(F.sum(F.when(stale, F.col("active_records"))), F.lit(0)).alias("stale_records"),
    )
    return per.where((F.col("known") >= 2) & (F.col("spread_days") >= APART)).withColumn("severity", F.when(F.col("oldest_days") > LONG_AGO, "high").otherwise("medium"))


def findings(holders: DataFrame, risks: DataFrame, health: DataFrame, restricted: DataFrame) -> DataFrame:
    """(target, provider, risk, severity, metric) of every target: the risks of the objects that hold its data (bearers()), unions whose parts differ in
    age (metric: the days), and, high, restricted characteristics (target, characteristic; metric: how many), by which users see different rows."""
    checked = holders.where("diagnosed")
    own = checked.select("target", "provider").distinct().join(risks, "provider").select("target", "provider", "risk", "severity", "metric")
    unions = checked.where("part_of IS NOT NULL").select("part_of", "provider").distinct().join(health.select("provider", "age_days", "active_records"), "provider", "left")
    mixed = mixed_currency(unions).join(checked.select("target", "part_of").distinct(), "part_of").select("target", F.col("part_of").alias("provider"), F.lit("mixed_currency").alias("risk"), "severity", F.col("spread_days").cast("string").alias("metric"))
    per = restricted.groupBy("target").agg(F.countDistinct("characteristic").cast("string").alias("metric"))
    users = per.select("target", F.lit(None).cast("string").alias("provider"), F.lit("user_specific_result").alias("risk"), F.lit("high").alias("severity"), "metric")
    return union_of([own, mixed, users])


def limits(targets: DataFrame, holders: DataFrame) -> DataFrame:
    """(target, provider, reason): how far the answer about each target (target, provider) goes: unions that were opened (reader_caveat), providers that
    could not be (metadata_dead_end), objects beyond the bound (truncated), and targets without any provider (metadata_dead_end, null)."""
    opened = holders.where("part_of IS NOT NULL").select("target", F.col("part_of").alias("provider"), F.lit("reader_caveat").alias("reason"))
    dead = holders.where("source = 'unresolved'").select("target", "provider", F.lit("metadata_dead_end").alias("reason"))
    beyond = holders.where("NOT diagnosed").select("target", "provider", F.lit("truncated").alias("reason"))
    alone = targets.select("target").distinct().join(holders.select("target").distinct(), "target", "left_anti").select("target", F.lit(None).cast("string").alias("provider"), F.lit("metadata_dead_end").alias("reason"))
    return union_of([opened, dead, beyond, alone]).distinct()


def verdicts(targets: DataFrame, holders: DataFrame, found: DataFrame, gaps: DataFrame) -> DataFrame:
    """(target, holders, unions, diagnosed, risks, worst, gaps, points_to) of every target: points_to is `load` where something critical or late was found,
    `users` where only restricted rows explain it, `logic` where nothing did in layers that could all be checked, else `unknown`."""
    per = holders.groupBy("target").agg(F.countDistinct("provider").alias("holders"), F.countDistinct("part_of").alias("unions"), F.countDistinct(F.when(F.col("diagnosed"), F.col("provider"))).alias("diagnosed"))
    load = F.col("risk").isin("no_rows", "last_load_failed", "late", "no_loader", "mixed_currency")
    risks = found.groupBy("target").agg(F.count("*").alias("risks"), F.min_by("severity", decode.severity_rank(F.col("severity"))).alias("worst"), F.bool_or(load).alias("by_load"), F.bool_or(F.col("risk") == "user_specific_result").alias("by_user"))
    open_ = gaps.where("reason <> 'reader_caveat'").groupBy("target").agg(F.count("*").alias("gaps"))
    out = targets.select("target").distinct().join(per, "target", "left").join(risks, "target", "left").join(open_, "target", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    to = F.when(F.col("by_load"), "load").when(F.col("by_user"), "users").when(F.col("gaps") > 0, "unknown").otherwise("logic")
    return out.select("target", zero("holders"), zero("unions"), zero("diagnosed"), zero("risks"), "worst", zero("gaps"), to.alias("points_to"))
