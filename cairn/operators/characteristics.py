"""Characteristics and their attributes, with what a reference characteristic inherits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.cut import cut, gone


def basic_characteristics(characteristics: DataFrame) -> DataFrame:
    """(characteristic, basic, status) of characteristics (name, base): the one at the end of each chain of references.

    status is `basic` where it refers to none but itself, `reference` where its chain ends at one that is there, `dangling` where it ends at a
    name without a row (which is then the basic one), `cycle` where it never ends (and it stands for itself). Every round doubles the steps
    that all chains have taken, so there are as many as the longest chain's length has binary digits.
    """
    base = F.when(F.trim(F.coalesce("base", F.lit(""))) != "", F.trim("base")).otherwise(F.col("name"))
    each = characteristics.where("coalesce(name, '') <> ''").groupBy("name").agg(F.min(base).alias("at"))
    state = cut(each)
    ends = each.where("at = name").select("name")
    left = state.count()
    while True:
        up = state.select(F.col("name").alias("of"), F.col("at").alias("up"))
        new = cut(state.join(up, F.col("at") == F.col("of"), "left").select("name", F.coalesce("up", "at").alias("at")))
        changed = new.withColumnRenamed("at", "now").join(state, "name").where("now <> at").isEmpty()
        gone(state)
        state = new
        left //= 2
        if changed or not left:
            break
    known = each.select(F.col("name").alias("known"))
    final = state.join(ends.select(F.col("name").alias("end")), F.col("at") == F.col("end"), "left").join(known, F.col("at") == F.col("known"), "left")
    status = F.when(F.col("name") == F.col("end"), "basic").when(F.col("end").isNotNull(), "reference").when(F.col("known").isNull(), "dangling").otherwise("cycle")
    return final.select(F.col("name").alias("characteristic"), F.when(status == "cycle", F.col("name")).otherwise(F.col("at")).alias("basic"), status.alias("status"))


def attributes(characteristics: DataFrame, attribute_rows: DataFrame, navigations: DataFrame | None) -> DataFrame:
    """(characteristic, attribute, kind, position, time_dependent, hidden, navigation_name, navigable, auth_relevant, text_from_characteristic,
    transitive, inherited_from, status): every attribute of every characteristic.

    Rows of attributes (characteristic, attribute, position, kind, time_dependent, hidden) are kept under the basic characteristic, and each
    that refers to it inherits them. Rows of navigations (characteristic, attribute, name, auth_relevant, text_from_characteristic,
    transitive) are kept under each characteristic itself, so the same attribute has another navigation name there, or none; without
    that table (None) nothing is said of navigation.
    """
    flag = lambda c, on: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) == on
    held = attribute_rows.where("trim(coalesce(attribute, '')) <> ''").select(
        F.col("characteristic").alias("basic"), F.trim("attribute").alias("attribute"), "position", F.when(flag("kind", "NAV"), "navigation").otherwise("display").alias("kind"), flag("time_dependent", "1").alias("time_dependent"), flag("hidden", "X").alias("hidden"))
    every = basic_characteristics(characteristics).join(held, "basic")
    out = ["characteristic", "attribute", "kind", "position", "time_dependent", "hidden", "navigation_name", "navigable", "auth_relevant", "text_from_characteristic", "transitive", "inherited_from", "status"]
    inherited = F.when(F.col("basic") != F.col("characteristic"), F.col("basic")).alias("inherited_from")
    if navigations is None:
        unknown = [F.lit(None).cast(kind).alias(c) for c, kind in zip(out[6:11], ["string", "boolean", "boolean", "boolean", "boolean"])]
        return every.select(*out[:6], *unknown, inherited, "status")
    own = navigations.groupBy("characteristic", F.trim("attribute").alias("attribute")).agg(
        F.min(F.when(F.trim("name") != "", F.trim("name"))).alias("navigation_name"), *[F.bool_or(flag(c, "X")).alias(c) for c in ("auth_relevant", "text_from_characteristic", "transitive")])
    joined = every.join(own, ["characteristic", "attribute"], "left").withColumn("navigable", F.col("navigation_name").isNotNull())
    return joined.select(*out[:8], *[F.coalesce(c, F.lit(False)).alias(c) for c in out[8:11]], inherited, "status")


def lost_navigations(found: DataFrame) -> DataFrame:
    """(characteristic, attributes, names): attributes() that are for navigation on the basic characteristic but carry no navigation name under
    the characteristic itself, so a query on it can't drill down by them."""
    lost = found.where("kind = 'navigation' AND NOT navigable")
    return lost.groupBy("characteristic").agg(F.count("*").alias("attributes"), F.array_join(F.array_sort(F.collect_set("attribute")), ",").alias("names"))
