"""Names, texts and descriptions of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import decode


def best_texts(texts: DataFrame, preferred: str) -> DataFrame:
    """One text per name: in the preferred language, else English, else any (the language that sorts first)."""
    rank = F.when(F.col("langu") == preferred, 0).when(F.col("langu") == "E", 1).otherwise(2)
    first = Window.partitionBy("name").orderBy(rank, "langu", "text")
    return texts.withColumn("n", F.row_number().over(first)).where("n = 1").select("name", "text", "langu")


def search(objects: DataFrame, term: str) -> DataFrame:
    """(object_type, name, matched) of objects (object_type, name, text) whose name or description matches; a name match counts first."""
    named = objects.where(decode.name_matches(F.col("name"), term)).select("object_type", "name", F.lit("name").alias("matched"))
    described = objects.where(decode.name_matches(F.col("text"), term)).select("object_type", "name", F.lit("description").alias("matched"))
    return named.unionByName(described).groupBy("object_type", "name").agg(F.max("matched").alias("matched"))


def description_report(objects: DataFrame) -> DataFrame:
    """(quality, objects): how many objects have descriptions of each quality."""
    return objects.groupBy(decode.description_quality(F.col("name"), F.col("text")).alias("quality")).agg(F.count("*").alias("objects"))


def unused(catalogue: DataFrame, *uses: DataFrame) -> DataFrame:
    """Names of the catalogue that none of the tables of uses (name) holds."""
    for use in uses:
        catalogue = catalogue.join(use.select("name").where("name IS NOT NULL").distinct(), "name", "left_anti")
    return catalogue


def unused_with_ad_hoc(catalogue: DataFrame, ad_hoc: DataFrame, *uses: DataFrame) -> DataFrame:
    """(name, ad_hoc): the unused names, and how many ad-hoc queries (name) read each all the same."""
    counted = ad_hoc.groupBy("name").agg(F.count("*").alias("n"))
    return unused(catalogue, *uses).join(counted, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("ad_hoc"))


def subjects(names: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(subject, endpoints, first_endpoint): the stored endpoints whose head, before the first space, is just the subject."""
    heads = endpoints.select("endpoint", F.split("endpoint", " ").getItem(0).alias("head"))
    return names.join(heads, F.col("subject") == F.col("head"), "left").groupBy("subject").agg(F.count("endpoint").alias("endpoints"), F.min("endpoint").alias("first_endpoint"))


def resolved_tables(tables: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(table_name, object, kind, role, confirmed): the object that each generated table belongs to: of its readings the first that the
    catalogue (kind, name) holds, else the likeliest one; null for other tables."""
    distinct = tables.select("table_name").distinct()
    readings = distinct.select("table_name", F.posexplode_outer(decode.table_readings(F.col("table_name"))).alias("rank", "reading")).select("table_name", "rank", "reading.*")
    known = catalogue.select(F.upper("name").alias("name"), "kind", F.lit(True).alias("known")).distinct()
    ranked = readings.join(known, ["name", "kind"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    first = F.struct((~F.col("known")).alias("unknown"), "rank")
    best = ranked.groupBy("table_name").agg(F.min_by(F.struct("name", "kind", "role", "known"), first).alias("b"))
    return best.select("table_name", F.col("b.name").alias("object"), F.col("b.kind").alias("kind"), F.col("b.role").alias("role"), F.col("b.known").alias("confirmed"))


def unregistered(sources: DataFrame, registry: DataFrame) -> DataFrame:
    """(system, datasources, registered) of every system that sources (system, datasource) name or the registry (system) holds."""
    used = sources.groupBy("system").agg(F.countDistinct("datasource").alias("datasources"))
    known = registry.select("system", F.lit(True).alias("known")).distinct()
    return used.join(known, "system", "full_outer").select("system", F.coalesce("datasources", F.lit(0)).alias("datasources"), F.coalesce("known", F.lit(False)).alias("registered"))


def customer_fields(fields: DataFrame) -> DataFrame:
    """(source, customer_fields, severity): fields (source, field) in the customer's namespace, by source; many weigh more."""
    own = fields.where(F.col("field").rlike("^(Z|Y|/BIC/)")).groupBy("source").agg(F.countDistinct("field").alias("customer_fields"))
    return own.withColumn("severity", F.when(F.col("customer_fields") >= 5, "medium").otherwise("low"))


def field_collisions(streams: DataFrame) -> DataFrame:
    """(target, field, streams) where more than one stream (target, field, stream) fills a field of a target."""
    filled = streams.groupBy("target", "field").agg(F.array_sort(F.collect_set("stream")).alias("s"))
    return filled.where(F.size("s") > 1).select("target", "field", F.array_join("s", ",").alias("streams"))


def crossings(dependencies: DataFrame) -> DataFrame:
    """(direction, view, object): views that read warehouse tables, and warehouse views that read calculation views.

    dependencies: (base, base_kind, dependent, dependent_kind), kinds 'table', 'warehouse' and 'calc'; direct ones only.
    """
    reads = dependencies.where("base_kind = 'table' AND dependent_kind = 'calc'").select(F.lit("reads_warehouse").alias("direction"), F.col("dependent").alias("view"), F.col("base").alias("object"))
    feeds = dependencies.where("base_kind = 'calc' AND dependent_kind = 'warehouse'").select(F.lit("feeds_warehouse").alias("direction"), F.col("base").alias("view"), F.col("dependent").alias("object"))
    return reads.unionByName(feeds).distinct()


def endpoint_parts(endpoints: DataFrame) -> DataFrame:
    """(endpoint, datasource, system) of endpoints that hold both, apart by the first run of spaces; the rest stays whole."""
    part = lambda n: F.regexp_extract("endpoint", r"^(\S+)\s*(.*)$", n)
    return endpoints.select("endpoint", part(1).alias("datasource"), F.nullif(F.rtrim(part(2)), F.lit("")).alias("system"))


def query_usage(queries: DataFrame, stale_days: int = 365) -> DataFrame:
    """(query, idle_days, retire) of queries (query, last_used), against the latest use of all; never used counts as stale."""
    today = queries.agg(F.max("last_used").alias("today"))
    idle = F.datediff("today", "last_used")
    return queries.crossJoin(F.broadcast(today)).select("query", idle.alias("idle_days"), (F.col("last_used").isNull() | (idle > stale_days)).alias("retire"))


def origins(names: DataFrame) -> DataFrame:
    """(origin, names) of queries (name): those whose name begins with '!!' are ad hoc, all others designed."""
    return names.groupBy(F.when(F.col("name").startswith("!!"), "ad_hoc").otherwise("designed").alias("origin")).agg(F.count("*").alias("names"))


def shortest_matches(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name): for each term the shortest name that begins with it, of equals the one that sorts first; null without any.

    Names meet terms by their own beginnings, of those lengths only that terms have; the best name of each beginning is chosen before they meet.
    """
    wanted = terms.select("term").distinct()
    lengths = wanted.agg(F.collect_set(F.length("term")).alias("lengths"))
    begun = names.select("name").crossJoin(F.broadcast(lengths)).select("name", F.explode("lengths").alias("n")).where(F.length("name") >= F.col("n"))
    best = begun.groupBy(F.left("name", F.col("n")).alias("begin")).agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("name"))
    return wanted.join(best, F.col("term") == F.col("begin"), "left").select("term", "name")


def enhancement_ranking(fields: DataFrame, limit: int) -> DataFrame:
    """The `limit` sources with the most customer fields, of equals those that sort first."""
    return customer_fields(fields).orderBy(F.desc("customer_fields"), "source").limit(limit)


def owned_tables(tables: DataFrame, least: int = 3) -> DataFrame:
    """(routine, packages, tables, spans): the tables (routine, table_name, package) of each routine, and whether they span `least` packages or more."""
    return tables.groupBy("routine").agg(F.countDistinct("package").alias("packages"), F.countDistinct("table_name").alias("tables")).withColumn("spans", F.col("packages") >= least)


def descriptions(objects: DataFrame) -> DataFrame:
    """(name, description, origin): the stored text; one that says too little is followed by the kind of object; without any it is generated."""
    quality = decode.description_quality(F.col("name"), F.col("text"))
    made = F.concat(F.lower("object_type"), F.lit(" "), F.col("name"))
    text = F.when(quality == "ok", F.col("text")).when(quality == "missing", made).otherwise(F.concat("text", F.lit(" ("), F.lower("object_type"), F.lit(")")))
    origin = F.when(quality == "ok", "stored").when(quality == "missing", "generated").otherwise("stored_augmented")
    return objects.select("name", text.alias("description"), origin.alias("origin"))
