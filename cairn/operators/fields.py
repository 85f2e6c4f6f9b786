"""Field lineage: (object, field) followed upward, one declared hop at a time, whatever kind declares it.

Of the kinds that know a field the first one counts: a transformation's rule, which also says how the field is derived; a composite's
mapping; a multiprovider's identification; a navigation attribute, which is read from the master data of its characteristic; and last
the characteristic that a reference characteristic refers to, which says nothing of the field but only where the object's data are. Each
kind's table is brought to one row a key before the walk, so a step is five look-ups and a walk a row per start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.cut import cut

KINDS = ["transformation", "composite_part", "multiprovider_part", "nav_attribute", "reference_characteristic"]
#: Kinds of parts at which a walk has arrived, and at which it goes on in another catalogue.
BOUNDARIES, VIEWS = ["datasource"], ["calcview"]


def first_of(rows: DataFrame, keys: list[str], order: list[str], others: str) -> DataFrame:
    """Of the rows of each key the first by the order, with `siblings`: how many further values of `others` the key has."""
    own = Window.partitionBy(*keys)
    counted = rows.withColumn("n", F.row_number().over(own.orderBy(*order))).withColumn("siblings", F.size(F.collect_set(others).over(own)) - 1)
    return counted.where("n = 1").drop("n")


def hop_tables(rules: DataFrame, composites: DataFrame, identifications: DataFrame, navigations: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """The five kinds' look-ups, each (its key, next_object, next_field, rule_type, advisory, boundary, view, siblings).

    rules: (object, field, source_object, source_field, rule_type, by_routine, from_datasource); composites: (object, field, part, part_kind,
    source, mapping_kind, runtime_view); identifications: (object, field, part, part_field); navigations: (field, characteristic,
    attribute); references: (object, base). Fields match whatever their case.
    """
    upper = lambda df: df.withColumn("field", F.upper("field"))
    no = F.lit(False)

    def table(rows: DataFrame, keys: list[str], to: Column, field: Column, rule: Column, advisory: Column = no, boundary: Column = no, to_view: Column = no) -> DataFrame:
        out = rows.select(*keys, to.alias("next_object"), field.alias("next_field"), rule.alias("rule_type"), advisory.alias("advisory"), boundary.alias("boundary"), to_view.alias("view"))
        return cut(first_of(out, keys, ["next_object", F.coalesce("next_field", F.lit("")), "rule_type"], "next_object"))

    held = F.col("part_kind").isin(VIEWS)
    return {
        "transformation": table(upper(rules), ["object", "field"], F.col("source_object"), F.col("source_field"), F.col("rule_type"), F.col("by_routine"), F.col("from_datasource")),
        "composite_part": table(upper(composites), ["object", "field"], F.when(held, F.coalesce("runtime_view", "part")).otherwise(F.col("part")), F.col("source"), F.when(F.col("mapping_kind") == "constant", "composite_constant").otherwise("composite_mapping"), boundary=F.col("part_kind").isin(BOUNDARIES), to_view=held),
        "multiprovider_part": table(upper(identifications), ["object", "field"], F.col("part"), F.col("part_field"), F.lit("multiprovider_identification")),
        "nav_attribute": table(upper(navigations).where("characteristic <> '' AND attribute <> ''"), ["field"], F.col("characteristic"), F.col("attribute"), F.lit("navigation_attribute")),
        "reference_characteristic": table(references.where("base <> '' AND upper(base) <> upper(object)"), ["object"], F.col("base"), F.lit(None).cast("string"), F.lit("reference_characteristic")),
    }


def field_hops(starts: DataFrame, hops: dict[str, DataFrame], depth: int = 12) -> DataFrame:
    """(start_object, start_field, level, object, field, via, next_object, next_field, rule_type, advisory, siblings, stop): every hop of the walk
    from each start (object, field); stop is null where it goes on.

    datasource: the hop arrives at a DataSource; calc_view: it arrives at a calculation view, whose lineage is kept elsewhere; no_source: the
    rule has no source field, as a constant has none; cycle: it leads to an object and field met before; too_deep: beyond `depth` hops.
    Where nothing populates the field a last row without a hop says what was looked for: not_identified (the object is a multiprovider that
    identifies other fields), no_rule at the start itself, chain_ends further up. Of several sources of a hop the first is followed.
    """
    identifying = hops["multiprovider_part"].select(F.col("object").alias("multi"), F.lit(True).alias("identifies")).distinct()
    columns = ["next_object", "next_field", "rule_type", "advisory", "boundary", "view", "siblings"]
    state = starts.select(F.col("object").alias("start_object"), F.col("field").alias("start_field"), "object", "field").where("object IS NOT NULL AND field IS NOT NULL").distinct()
    state = state.withColumn("seen", F.array(F.concat_ws("\n", F.upper("object"), F.upper("field"))))
    found = []
    for level in range(1, depth + 1):
        state = cut(state)
        if state.isEmpty():
            break
        step = state
        for kind in KINDS:
            keys = [k for k in ("object", "field") if k in hops[kind].columns]
            own = hops[kind].select(*[F.col(k).alias(f"key_{k}") for k in keys], F.struct(F.lit(kind).alias("via"), *columns).alias(kind))
            on = [(F.col("object") == F.col("key_object")) if k == "object" else (F.upper("field") == F.col("key_field")) for k in keys]
            step = step.join(own, reduce(Column.__and__, on), "left").drop(*[f"key_{k}" for k in keys])
        step = step.withColumn("hop", F.coalesce(*KINDS)).join(identifying, F.col("object") == F.col("multi"), "left")
        # A reference characteristic carries the field over as it is.
        to_field = F.when(F.col("hop.via") == "reference_characteristic", F.col("field")).otherwise(F.col("hop.next_field"))
        step = step.withColumn("to_field", to_field).withColumn("to", F.concat_ws("\n", F.upper("hop.next_object"), F.upper("to_field")))
        none = F.when(F.col("identifies") & F.lit(level == 1), "not_identified").otherwise("no_rule" if level == 1 else "chain_ends")
        stop = (
            F.when(F.col("hop").isNull(), none).when(F.col("hop.boundary"), "datasource").when(F.col("hop.view"), "calc_view").when(F.col("hop.next_object").isNull() | F.col("to_field").isNull(), "no_source")
            .when(F.array_contains("seen", F.col("to")), "cycle").when(F.lit(level == depth), "too_deep")
        )
        step = cut(step.select("start_object", "start_field", F.lit(level).alias("level"), "object", "field", "hop.via", "hop.next_object", F.col("to_field").alias("next_field"), "hop.rule_type", "hop.advisory", "hop.siblings", stop.alias("stop"), F.array_append("seen", F.col("to")).alias("seen")))
        found.append(step.drop("seen"))
        state = step.where("stop IS NULL").select("start_object", "start_field", F.col("next_object").alias("object"), F.col("next_field").alias("field"), "seen")
    return reduce(DataFrame.unionByName, found) if found else state.select("start_object", "start_field", F.lit(0).alias("level"), "object", "field", *[F.lit(None).cast("string").alias(c) for c in ("via", "next_object", "next_field", "rule_type")], F.lit(False).alias("advisory"), F.lit(0).alias("siblings"), F.lit("").alias("stop"))


def field_paths(walked: DataFrame) -> DataFrame:
    """(start_object, start_field, hops, kinds, end_object, end_field, stop, reaches_datasource, by_routine): one row per walk of field_hops()."""
    hop = F.col("via").isNotNull()
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hop, F.struct("level", "via")))), lambda x: x["via"]), ">")
    last = F.max_by(F.struct(F.when(hop, F.col("next_object")).otherwise(F.col("object")).alias("o"), F.when(hop, F.col("next_field")).otherwise(F.col("field")).alias("f"), "stop"), "level")
    per = walked.groupBy("start_object", "start_field").agg(F.count_if(hop).alias("hops"), kinds.alias("kinds"), last.alias("l"), F.coalesce(F.bool_or("advisory"), F.lit(False)).alias("by_routine"))
    return per.select("start_object", "start_field", "hops", "kinds", F.col("l.o").alias("end_object"), F.col("l.f").alias("end_field"), F.col("l.stop").alias("stop"), (F.col("l.stop") == "datasource").alias("reaches_datasource"), "by_routine")
