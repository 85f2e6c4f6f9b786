"""Authorisations, areas and the health of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators.graph import union_of
from cairn.plans.cut import cut


def auth_shapes(values: DataFrame) -> DataFrame:
    """Per authorisation (auth, characteristic, low): characteristics, ranges, whether all are '*', and its variables."""
    kind = decode.auth_value_kind(F.col("low"))
    variables = F.array_join(F.array_sort(F.collect_set(F.when(kind == "variable", F.col("low")))), ",")
    return values.groupBy("auth").agg(F.countDistinct("characteristic").alias("characteristics"), F.count("*").alias("ranges"), F.bool_and(kind == "all").alias("all_values"), variables.alias("variables"))


def users_per_auth(values: DataFrame, users: DataFrame) -> DataFrame:
    """Per authorisation: its users; null where the assignment table has no row at all (unknown, not none)."""
    counted = users.groupBy("auth").agg(F.countDistinct("uname").alias("n"))
    readable = users.agg((F.count("*") > 0).alias("readable"))
    out = values.select("auth").distinct().join(counted, "auth", "left").crossJoin(F.broadcast(readable))
    return out.select("auth", F.when(F.col("readable"), F.coalesce("n", F.lit(0))).alias("users"))


def uncovered(relevant: DataFrame, values: DataFrame) -> DataFrame:
    """Relevant characteristics that no authorisation restricts."""
    return relevant.join(values.select("characteristic").distinct(), "characteristic", "left_anti")


def coverage(relevant: DataFrame, values: DataFrame | None) -> DataFrame:
    """(characteristic, authorisations, status) of every relevant characteristic: covered by authorisations (auth, characteristic, ...) or uncovered,
    which blocks all users without a catch-all; unknown where the authorisations can't be read (None), which is not uncovered."""
    every = relevant.select("characteristic").distinct()
    if values is None:
        return every.select("characteristic", F.lit(None).cast("long").alias("authorisations"), F.lit("unknown").alias("status"))
    held = values.groupBy("characteristic").agg(F.countDistinct("auth").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return every.join(held, "characteristic", "left").select("characteristic", n.alias("authorisations"), F.when(n > 0, "covered").otherwise("uncovered").alias("status"))


def area_rollup(areas: DataFrame, members: DataFrame) -> DataFrame:
    """(area, family, objects) of members (area, family); those without a known area are counted under ''."""
    known = areas.select(F.col("area").alias("known")).distinct()
    return members.join(known, F.col("area") == F.col("known"), "left").groupBy(F.coalesce("known", F.lit("")).alias("area"), "family").agg(F.count("*").alias("objects"))


def area_tree(areas: DataFrame, members: DataFrame, families: list[str]) -> DataFrame:
    """(area, parent, path, level, status, own_<family>..., own, below): every area with the objects assigned to it by family, and how many are
    assigned to it or to any area below it.

    areas: (area, parent), a blank parent means a root; members: (area, family). status is `placed` where the way up ends at a root, `cycle`
    where it comes back to an area (which has no path then; each area of the cycle is below every other), `dangling` where it ends at an
    area without a row, `unresolved` for areas that members name and the hierarchy doesn't hold, and `unassigned` for members without
    an area, under the blank name. Empty areas are rows with zeros. Families beyond those named count in `own` and `below`.
    """
    each = areas.where("trim(coalesce(area, '')) <> ''").groupBy(F.trim("area").alias("area")).agg(F.min(F.trim(F.coalesce("parent", F.lit("")))).alias("parent"))
    up = cut(each.select(F.col("area").alias("at"), F.col("parent").alias("up")))
    state = cut(each.select("area", F.array("area").alias("way"), F.lit("").alias("ended")))
    done = []
    while not state.isEmpty():
        step = state.join(up, F.element_at("way", -1) == F.col("at"), "left")
        ended = F.when(F.col("at").isNull(), "dangling").when(F.col("up") == "", "placed").when(F.array_contains("way", F.col("up")), "cycle").otherwise("")
        step = cut(step.select("area", "up", ended.alias("ended"), "way").withColumn("way", F.when(F.col("ended") == "", F.array_append("way", F.col("up"))).otherwise(F.col("way"))))
        done.append(step.where("ended <> ''").select("area", "way", "ended"))
        state = step.where("ended = ''").select("area", "way", "ended")
    ways = cut(union_of(done)) if done else each.select("area", F.array("area").alias("way"), F.lit("").alias("ended"))
    named = members.select(F.trim(F.coalesce("area", F.lit(""))).alias("area"), "family")
    own = cut(named.groupBy("area").agg(*[F.count_if(F.col("family") == f).alias(f"own_{f}") for f in families], F.count("*").alias("own")))
    above = ways.join(own.select("area", "own"), "area").select(F.explode(F.array_distinct("way")).alias("area"), "own").groupBy("area").agg(F.sum("own").alias("below"))
    path = F.when(F.col("ended") == "placed", F.array_join(F.reverse("way"), "/"))
    known = each.join(ways, "area").select("area", "parent", path.alias("path"), F.when(F.col("ended") == "placed", F.size("way") - 1).alias("level"), F.col("ended").alias("status"))
    other = own.join(each.select("area"), "area", "left_anti").select("area", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("level"), F.when(F.col("area") == "", "unassigned").otherwise("unresolved").alias("status"))
    out = known.unionByName(other).join(own, "area", "left").join(above, "area", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("area", "parent", "path", "level", "status", *[zero(f"own_{f}") for f in families], zero("own"), F.coalesce("below", "own", F.lit(0)).alias("below"))


def provider_health(requests: DataFrame) -> DataFrame:
    """Per provider (provider, rnr, started, status): its last request and status, its last success, and its age against the latest of all."""
    latest = requests.agg(F.max("started").alias("today"))
    order = F.struct("started", "rnr")
    success = F.when(F.col("status") == "success", order)
    per = requests.groupBy("provider").agg(F.count("*").alias("requests"), F.max_by("status", order).alias("last_status"), F.max("started").alias("last_started"), F.max(success)["started"].alias("last_success"))
    return per.crossJoin(F.broadcast(latest)).select("provider", "requests", "last_status", F.datediff("today", "last_started").alias("age_days"), F.datediff("today", "last_success").alias("days_since_success"))


def volumes(rows: DataFrame) -> DataFrame:
    """Per provider: records and memory of each role, never added over roles."""
    one = lambda role, c: F.sum(F.when(F.col("role") == role, F.col(c)))
    return rows.groupBy("provider").agg(*[one(role, c).alias(f"{role}_{c}") for role in ("active", "changelog", "inbound") for c in ("records", "memory")])


def domain_texts(values: DataFrame, texts: DataFrame, language: str) -> DataFrame:
    """(domain, position, value, text): every value of a domain, with its text in the language or null."""
    own = texts.where(F.col("langu") == language).select("domain", "position", "text")
    return values.join(own, ["domain", "position"], "left").select("domain", "position", "value", "text")


def request_statuses(requests: DataFrame) -> DataFrame:
    """(provider, status, requests) of requests (provider, ledger, code), each code decoded by its own ledger."""
    return requests.groupBy("provider", decode.request_status(F.col("ledger"), F.col("code")).alias("status")).agg(F.count("*").alias("requests"))


def key_figures(figures: DataFrame) -> DataFrame:
    """(name, exception, stock, summable) of key figures (name, aggrgen, aggrexc, ncumfl)."""
    exception = F.when(F.trim("aggrexc") != "", F.coalesce(decode.decoded(F.col("aggrexc"), decode.EXCEPTIONS), F.lit("(undocumented)")))
    stock = decode.decoded(F.col("ncumfl"), decode.STOCKS, "cumulative")
    return figures.select("name", exception.alias("exception"), stock.alias("stock"), decode.summable(F.col("aggrgen"), F.col("aggrexc"), F.col("ncumfl")).alias("summable"))


def provider_catalogue(*families: tuple[str, DataFrame]) -> DataFrame:
    """(kind, name) of every provider of all kinds (name), each once."""
    parts = [df.select(F.lit(kind).alias("kind"), "name") for kind, df in families]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("coalesce(name, '') <> ''").distinct()


def rule_profile(rules: DataFrame) -> DataFrame:
    """Per structure (structure, routine, formula, constant): rules, and how many have a routine, a formula, a constant."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return rules.groupBy("structure").agg(F.count("*").alias("rules"), filled("routine").alias("with_routine"), filled("formula").alias("with_formula"), filled("constant").alias("with_constant"))


def rule_mechanisms(rules: DataFrame) -> DataFrame:
    """(structure, mechanism, rules): by what each rule fills its field; a constant before a routine before a formula before a direct move."""
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    mechanism = F.when(set_("constant"), "constant").when(set_("routine"), "routine").when(set_("formula"), "formula").otherwise("direct")
    return rules.groupBy("structure", mechanism.alias("mechanism")).agg(F.count("*").alias("rules"))


def older_flows(sources: DataFrame, rules: DataFrame, with_start: DataFrame, modern: DataFrame, updates: DataFrame) -> DataFrame:
    """Routes of the older kind: sources (datasource, structure, infosource) whose structure has rules, with their rule profile, whether it has a
    start routine (structure), whether a modern transformation reads the datasource too (datasource), and the targets that updates
    (infosource, target) fill."""
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    targets = updates.groupBy("infosource").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))
    # Sources find their flag before the profile widens them, and go by structure once, for being distinct and for the join.
    routes = sources.join(flag(modern, "datasource", "m"), "datasource", "left").repartition("structure").distinct()
    # A rule goes there as one number, a bit for each of its three columns.
    columns = ["routine", "formula", "constant"]
    bits = [F.when(F.coalesce(F.col(c), F.lit("")) != "", 1 << k).otherwise(0) for k, c in enumerate(columns)]
    short = rules.select("structure", (bits[0] + bits[1] + bits[2]).cast("byte").alias("bits")).repartition("structure")
    profile = rule_profile(short.select("structure", *[F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, "x").alias(c) for k, c in enumerate(columns)]))
    out = routes.join(profile, "structure").join(flag(with_start, "structure", "s"), "structure", "left").join(targets, "infosource", "left")
    return out.select("datasource", "structure", "infosource", "rules", "with_routine", "with_formula", "with_constant", F.col("s").isNotNull().alias("has_start_routine"), F.col("m").isNotNull().alias("has_transformation"), F.coalesce("targets", F.lit("")).alias("targets"))


def mixed_exceptions(steps: DataFrame) -> DataFrame:
    """(element, steps, exception): of an element's calculation steps (element, exception) the one exception, or 'mixed' where they differ."""
    one = F.min("exception")
    return steps.groupBy("element").agg(F.count("*").alias("steps"), F.when(F.countDistinct("exception") > 1, "mixed").otherwise(one).alias("exception"))


def auth_details(values: DataFrame, users: DataFrame) -> DataFrame:
    """(auth, kind, ranges, users): the value ranges of each authorisation by kind, and its users."""
    kinds = values.groupBy("auth", decode.auth_value_kind(F.col("low")).alias("kind")).agg(F.count("*").alias("ranges"))
    counted = users.groupBy("auth").agg(F.countDistinct("uname").alias("users"))
    return kinds.join(counted, "auth", "left").select("auth", "kind", "ranges", F.coalesce("users", F.lit(0)).alias("users"))
