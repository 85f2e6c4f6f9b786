"""Providers as catalogues declare them: headers of every kind, their fields with keys, roles and InfoObjects, what loads them, and the queries on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of cubes by their type.
CUBES = {"B": "infocube", "M": "multiprovider", "V": "virtualprovider"}
#: Kinds of loaded objects by the codes of the classic request ledger and of the newer one.
CLASSIC_KINDS = {"ODSO": "dso", "CUBE": "infocube", "ADSO": "adso", "IOBJ": "infoobject", "FLEX_T": "infoobject", "FLEX_M": "infoobject"}
LEDGER_KINDS = {"ADSO": "adso", "ODSO": "dso", "CUBE": "infocube", "IOBJ": "infoobject"}
#: Namespaces that the generator puts before a column's name, and the prefix of queries made ad hoc.
COLUMN_SPACES, AD_HOC = ["/BIC/", "/BI0/"], "!!"
#: Chains that are named for a loaded object.
NAMED_CHAINS = 3


def clean(column: str) -> Column:
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.when(text != "", text)


def meaning(value: Column, meanings: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])[F.upper(F.trim(value))]


def headers(dsos: DataFrame, adsos: DataFrame, cubes: DataFrame, composites: DataFrame, infoobjects: DataFrame) -> DataFrame:
    """(name, kind, subtype, active, area, owner) of every provider: one row per kind's header (name, area, owner), cubes (name, type, status, area,
    owner) by their type. Only cubes have a status of their own; of the other kinds an active version means active."""
    one = lambda df, kind, subtype=None, active=None: df.where("trim(coalesce(name, '')) <> ''").select(
        F.trim("name").alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(None).cast("string") if subtype is None else subtype).alias("subtype"), (F.lit(True) if active is None else active).alias("active"), clean("area").alias("area"), clean("owner").alias("owner"))
    cube = one(cubes, F.coalesce(meaning(F.col("type"), CUBES), F.lit("infocube")), clean("type"), F.coalesce(F.trim("status") == "ACT", F.lit(False)))
    return reduce(DataFrame.unionByName, [one(dsos, "dso"), one(adsos, "adso"), cube, one(composites, "compositeprovider"), one(infoobjects, "infoobject")]).distinct()


def column_candidates(column: Column) -> Column:
    """The names of InfoObjects that a generated column may stand for, likeliest first: what follows a generator's namespace, and that with a
    leading zero; a name in a namespace of its own stands for itself; any other lost its leading zero, or is itself."""
    upper = F.upper(F.trim(column))
    out = F.when(upper.rlike("^/.*/"), F.array(upper)).otherwise(F.array(F.concat(F.lit("0"), upper), upper))
    for space in COLUMN_SPACES:
        rest = F.substr(upper, F.lit(len(space) + 1))
        out = F.when(upper.startswith(space), F.filter(F.array(rest, F.concat(F.lit("0"), rest)), lambda x: ~x.isin("", "0"))).otherwise(out)
    return F.when(F.coalesce(upper, F.lit("")) != "", out)


def column_infoobjects(columns: DataFrame, infoobjects: DataFrame | None) -> DataFrame:
    """(column, infoobject, resolution) of columns (column): the first candidate that the catalogue (name) holds is confirmed; without any the
    likeliest one is inferred, and all are where there is no catalogue (None)."""
    each = columns.where("trim(coalesce(column, '')) <> ''").select("column").distinct().select("column", F.posexplode(column_candidates(F.col("column"))).alias("rank", "candidate"))
    if infoobjects is None:
        return each.where("rank = 0").select("column", F.col("candidate").alias("infoobject"), F.lit("inferred").alias("resolution"))
    known = infoobjects.select(F.upper(F.trim("name")).alias("candidate"), F.lit(True).alias("known")).distinct()
    first = F.min(F.struct(F.col("known").isNull().alias("unknown"), "rank", "candidate"))
    best = each.join(known, "candidate", "left").groupBy("column").agg(first.alias("b"))
    return best.select("column", F.col("b.candidate").alias("infoobject"), F.when(F.col("b.unknown"), "inferred").otherwise("confirmed").alias("resolution"))


def provider_fields(stored: DataFrame, columns: DataFrame, keys: DataFrame, navigations: DataFrame, infoobjects: DataFrame | None) -> DataFrame:
    """(provider, field, position, is_key, role, attribute_of, attribute_name, infoobject, resolution) of every provider's fields.

    stored: fields under InfoObjects' own names (provider, field, position, key), a field that repeats counts once, at its first position, and is a
    key if any of its rows is. columns: generated columns (provider, column, position), read back to InfoObjects, with keys (provider, field)
    apart. A field named like a navigation attribute (name, characteristic, attribute) is read from that characteristic's master data.
    """
    one = stored.where("trim(coalesce(field, '')) <> ''").groupBy("provider", F.trim("field").alias("field")).agg(F.min("position").alias("position"), F.coalesce(F.bool_or(F.trim("key") == "X"), F.lit(False)).alias("is_key"))
    own = one.withColumn("infoobject", F.col("field")).withColumn("resolution", F.lit("declared"))
    keyed = keys.select("provider", F.upper(F.trim("field")).alias("keyed")).distinct()
    placed = columns.groupBy("provider", "column").agg(F.min("position").alias("position"))
    read = placed.join(column_infoobjects(columns, infoobjects), "column").join(keyed.withColumnRenamed("provider", "of"), (F.col("provider") == F.col("of")) & F.col("keyed").isin(F.upper("column"), F.col("infoobject")), "left")
    generated = read.groupBy("provider", F.col("column").alias("field"), "position", "infoobject", "resolution").agg(F.bool_or(F.col("keyed").isNotNull()).alias("is_key"))
    every = own.select("provider", "field", "position", "is_key", "infoobject", "resolution").unionByName(generated.select("provider", "field", "position", "is_key", "infoobject", "resolution"))
    nav = navigations.where("trim(coalesce(name, '')) <> ''").groupBy(F.trim("name").alias("nav")).agg(F.min(F.struct("characteristic", "attribute")).alias("n"))
    out = every.join(nav, F.col("field") == F.col("nav"), "left")
    return out.select("provider", "field", "position", "is_key", F.when(F.col("nav").isNotNull(), "navigation_attribute").otherwise("field").alias("role"), F.col("n.characteristic").alias("attribute_of"), F.col("n.attribute").alias("attribute_name"), "infoobject", "resolution")


def described(found: DataFrame, fields: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, kind, active, area, fields, keys, navigation_attributes, inferred, parts, key_names): one row per header; parts: (composite, part)."""
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("is_key"), F.struct("position", "field")))), lambda x: x["field"])
    per = fields.groupBy(F.col("provider").alias("name")).agg(F.count("*").alias("fields"), F.count_if("is_key").alias("keys"), F.count_if(F.col("role") == "navigation_attribute").alias("navigation_attributes"), F.count_if(F.col("resolution") == "inferred").alias("inferred"), F.array_join(keys, ",").alias("key_names"))
    held = parts.groupBy(F.col("composite").alias("name")).agg(F.countDistinct("part").alias("parts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.join(per, "name", "left").join(held, "name", "left").select("name", "kind", "active", "area", zero("fields"), zero("keys"), zero("navigation_attributes"), zero("inferred"), zero("parts"), F.coalesce("key_names", F.lit("")).alias("key_names"))


def inferred_kinds(classic: DataFrame, newer: DataFrame) -> DataFrame:
    """(provider, kind, ledger): the kind of every provider that a request ledger (provider, code) records: by the code that sorts first in the
    classic ledger if it has a meaning, else in the newer one; null where neither tells."""
    first = lambda df, meanings, name: df.groupBy("provider").agg(meaning(F.min(F.upper(F.trim("code"))), meanings).alias(name))
    both = first(classic, CLASSIC_KINDS, "old").join(first(newer, LEDGER_KINDS, "new"), "provider", "full_outer")
    return both.select("provider", F.coalesce("old", "new").alias("kind"), F.when(F.col("old").isNotNull(), "classic").when(F.col("new").isNotNull(), "newer").alias("ledger"))


def load_coverage(loaded: DataFrame, enumerated: DataFrame) -> DataFrame:
    """(name, status, chains, modes, cadences, named) of every object that chains load (name, chain, updmode, cadence) and every provider that
    headers enumerate (name): loaded, unloaded (enumerated, and no chain loads it) or loaded_not_enumerated, as characteristics are.
    named: the first chains, and how many more there are."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = loaded.groupBy("name").agg(F.countDistinct("chain").alias("chains"), listed("updmode").alias("modes"), listed("cadence").alias("cadences"))
    rank = Window.partitionBy("name").orderBy("chain")
    first = loaded.select("name", "chain").distinct().withColumn("n", F.row_number().over(rank)).where(F.col("n") <= NAMED_CHAINS).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("chain").cast("string").alias("chain")))), lambda x: x["chain"]).alias("first"))
    known = enumerated.select("name", F.lit(True).alias("known")).distinct()
    out = per.join(first, "name").join(known, "name", "full_outer")
    more = F.col("chains") - NAMED_CHAINS
    named = F.concat(F.array_join("first", ","), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))
    status = F.when(F.col("chains").isNull(), "unloaded").when(F.col("known").isNull(), "loaded_not_enumerated").otherwise("loaded")
    return out.select("name", status.alias("status"), F.coalesce("chains", F.lit(0)).alias("chains"), F.coalesce("modes", F.lit("")).alias("modes"), F.coalesce("cadences", F.lit("")).alias("cadences"), F.coalesce(named, F.lit("")).alias("named"))


def query_list(directory: DataFrame, roots: DataFrame, assigned: DataFrame) -> DataFrame:
    """(query, name, owner, last_used, origin, provider, providers) of the queries in a directory (query, name, owner, last_used, version, status):
    a row per version is kept there, so only active versions that are active count, and of components only the roots (query). origin is
    ad_hoc by the name's prefix; assigned: (query, provider)."""
    active = directory.where("version = 'A' AND status = 'ACT'").join(roots.select("query").distinct(), "query", "left_semi")
    per = assigned.groupBy("query").agg(F.min("provider").alias("provider"), F.countDistinct("provider").alias("providers"))
    origin = F.when(F.col("name").startswith(AD_HOC), "ad_hoc").otherwise("designed")
    return active.select("query", "name", clean("owner").alias("owner"), "last_used", origin.alias("origin")).distinct().join(per, "query", "left").select("query", "name", "owner", "last_used", "origin", "provider", F.coalesce("providers", F.lit(0)).alias("providers"))
