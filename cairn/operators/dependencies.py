"""Dependencies among calculation views, generated views and tables, as the database's own catalogue declares them, and the providers they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.search import resolved_tables

#: Kinds of a dependency; the package of generated views, with a namespace in lower case behind it, the suffix of those of queries, and the part of a name that marks a hierarchy's.
DIRECT, TRANSITIVE = 1, 2
PACKAGE, QUERIES, HIERARCHIES = "bw2hana", "query.", "/hier(/|$)"
#: How many providers of a view, and consumers of a provider, are listed.
MOST = 50


def generated_provider(view: Column) -> Column:
    """The provider whose generated view this is, spelled as catalogues do; null for other views, those of queries and hierarchies among them."""
    package, local = F.regexp_extract(view, "^(.*)/([^/]+)$", 1), F.regexp_extract(view, "^(.*)/([^/]+)$", 2)
    suffix = F.regexp_extract(package, PACKAGE + "[.](.+)$", 1)
    other = F.lower(suffix).startswith(QUERIES) | F.lower(view).rlike(HIERARCHIES)
    spelled = F.when(suffix != "", F.concat(F.lit("/"), F.upper(suffix), F.lit("/"), local)).otherwise(local)
    return F.when(package.contains(PACKAGE) & (local != "") & ~other, spelled)


def providers_read(dependencies: DataFrame, catalogue: DataFrame, kind: int) -> DataFrame:
    """(view, provider, provider_kind, via, confirmed) of dependencies (dependent, base, dependency_type) of one kind: a generated view counts where
    the catalogue (name, kind) knows its provider, a generated table by the reading of its name; each provider once, by the first base."""
    known = catalogue.select(F.upper("name").alias("known"), F.col("kind").alias("known_kind")).groupBy("known").agg(F.min("known_kind").alias("known_kind"))
    reads = dependencies.where((F.col("dependency_type") == kind) & (F.col("dependent") != F.col("base"))).select(F.col("dependent").alias("view"), "base").distinct()
    by_view = reads.withColumn("provider", generated_provider(F.col("base")))
    views = by_view.where("provider IS NOT NULL").join(known, F.col("provider") == F.col("known")).select("view", "provider", F.col("known_kind").alias("provider_kind"), F.col("base").alias("via"), F.lit(True).alias("confirmed"))
    tables = by_view.where("provider IS NULL").select("view", F.col("base").alias("table_name"))
    readings = resolved_tables(tables, catalogue).where("object IS NOT NULL")
    named = tables.join(readings, "table_name").select("view", F.col("object").alias("provider"), F.col("kind").alias("provider_kind"), F.col("table_name").alias("via"), "confirmed")
    first = F.min(F.struct((~F.col("confirmed")).alias("advisory"), "via", "provider_kind"))
    return views.unionByName(named).groupBy("view", "provider").agg(first.alias("f")).select("view", "provider", "f.provider_kind", "f.via", (~F.col("f.advisory")).alias("confirmed"))


def view_providers(dependencies: DataFrame, catalogue: DataFrame, most: int = MOST) -> DataFrame:
    """(view, provider, provider_kind, via, confirmed, route, providers, truncated): what each view reads, directly where that names any provider,
    else through the views below it. Bases are resolved and each provider counted once before the first `most` are listed, so `providers` is
    exact."""
    direct = providers_read(dependencies, catalogue, DIRECT).withColumn("route", F.lit("direct"))
    deep = providers_read(dependencies, catalogue, TRANSITIVE).withColumn("route", F.lit("transitive"))
    found = direct.unionByName(deep.join(direct.select("view").distinct(), "view", "left_anti"))
    return listed(found, "view", "provider", "providers", most)


def provider_consumers(dependencies: DataFrame, catalogue: DataFrame, most: int = MOST) -> DataFrame:
    """(provider, consumer, consumer_kind, consumers, truncated): which views read a provider's generated view or tables, at any distance; a view
    that is itself generated for a provider counts as that provider. Consumers are resolved and made distinct before the first `most` are
    listed; a provider is not its own consumer."""
    reads = providers_read(dependencies, catalogue, DIRECT).select("provider", "view").unionByName(providers_read(dependencies, catalogue, TRANSITIVE).select("provider", "view"))
    own = generated_provider(F.col("view"))
    found = reads.select("provider", F.coalesce(own, F.col("view")).alias("consumer"), F.when(own.isNotNull(), "provider").otherwise("calcview").alias("consumer_kind")).where("consumer <> provider").distinct()
    return listed(found, "provider", "consumer", "consumers", most)


def listed(found: DataFrame, key: str, item: str, total: str, most: int) -> DataFrame:
    """The first `most` items of each key by name, how many there are, and whether more are than listed."""
    own = Window.partitionBy(key)
    ranked = found.withColumn("n", F.row_number().over(own.orderBy(item))).withColumn(total, F.count("*").over(own)).withColumn("truncated", F.col(total) > most)
    return ranked.where(F.col("n") <= most).drop("n")


def warehouse_views(dependencies: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(view, providers): views that read at least one provider of the catalogue, directly or through others."""
    every = providers_read(dependencies, catalogue, DIRECT).unionByName(providers_read(dependencies, catalogue, TRANSITIVE))
    return every.where("confirmed").groupBy("view").agg(F.countDistinct("provider").alias("providers"))
