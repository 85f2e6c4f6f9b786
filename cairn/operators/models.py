"""Stored XML models of calculation views, and transformation rules put together from their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.cut import cut


#: What is read of a stored model.
MODEL = """dataSources struct<DataSource: array<struct<_id: string>>>, calculationViews struct<calculationView: array<struct<_id: string, `_xsi:type`: string, filter: string, _filterExpression: string,
input: array<struct<_node: string, mapping: array<struct<_source: string, _target: string>>>>, joinAttribute: array<struct<_name: string>>>>>"""


def parsed_models(models: DataFrame, most_chars: int = 4_000_000) -> DataFrame:
    """(name, model) of models (name, xml); models with a DTD or beyond the size are skipped, and what isn't XML has no parts."""
    safe = models.where(F.length("xml") <= most_chars).where(~F.upper("xml").contains("<!DOCTYPE"))
    return safe.select("name", F.from_xml("xml", MODEL, {"mode": "PERMISSIVE"}).alias("model"))


def view_nodes(models: DataFrame) -> DataFrame:
    """(name, node, kind, inputs, joins, filter) of the calculation nodes in models (name, xml)."""
    nodes = parsed_models(models).select("name", F.explode("model.calculationViews.calculationView").alias("v"))
    joined = lambda items: F.coalesce(F.array_join(F.array_sort(F.array_distinct(items)), ","), F.lit(""))
    inputs = F.transform("v.input", lambda x: F.regexp_replace(F.trim(x["_node"]), "^#", ""))
    kind = F.regexp_replace("v.`_xsi:type`", "^[A-Za-z]+:", "")
    return nodes.select("name", F.col("v._id").alias("node"), kind.alias("kind"), joined(inputs).alias("inputs"), joined(F.col("v.joinAttribute._name")).alias("joins"), F.coalesce("v._filterExpression", "v.filter", F.lit("")).alias("filter"))


def view_mappings(models: DataFrame) -> DataFrame:
    """(name, node, input, target, source): the fields that each node of models (name, xml) takes from its inputs, under their own names."""
    nodes = parsed_models(models).select("name", F.explode("model.calculationViews.calculationView").alias("v"))
    inputs = nodes.select("name", F.col("v._id").alias("node"), F.explode("v.input").alias("i"))
    fields = inputs.select("name", "node", F.regexp_replace(F.trim("i._node"), "^#", "").alias("input"), F.explode("i.mapping").alias("m"))
    return fields.select("name", "node", "input", F.col("m._target").alias("target"), F.col("m._source").alias("source"))


def view_sources(models: DataFrame) -> DataFrame:
    """(name, source) of the data sources that models (name, xml) declare."""
    return parsed_models(models).select("name", F.explode(F.array_distinct("model.dataSources.DataSource._id")).alias("source"))


def assembled_rules(rules: DataFrame, fields: DataFrame, constants: DataFrame, routines: DataFrame | None = None) -> DataFrame:
    """One row per rule (rule_id, kind): its sources and targets, sorted, and its constant if it has one; with routines, also the code that derives
    it, if any.

    fields (rule_id, role, field) tell what a rule reads (role 0) and writes (role 1); constants are (rule_id, value), routines (rule_id, codeid).
    """
    role = lambda n: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == n, F.col("field")))), ",")
    of = fields.groupBy("rule_id").agg(role(0).alias("sources"), role(1).alias("targets"))
    value = constants.groupBy("rule_id").agg(F.min("value").alias("constant"))
    out = rules.join(of, "rule_id", "left").join(value, "rule_id", "left")
    columns = ["rule_id", "kind", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("targets", F.lit("")).alias("targets"), "constant"]
    if routines is None:
        return out.select(*columns)
    code = routines.where("coalesce(codeid, '') <> ''").groupBy("rule_id").agg(F.min("codeid").alias("routine"))
    return out.join(code, "rule_id", "left").select(*columns, "routine")


def event_successors(steps: DataFrame) -> DataFrame:
    """(chain_id, src, dst, on): a step follows another that raises the event it starts on; itself excluded.

    steps: (chain_id, step, starts_on, on_green, on_red).
    """
    raised = steps.select("chain_id", F.col("step").alias("src"), F.explode(F.array(F.struct(F.lit("green").alias("on"), F.col("on_green").alias("event")), F.struct(F.lit("red").alias("on"), F.col("on_red").alias("event")))).alias("e"))
    raised = raised.select("chain_id", "src", "e.on", "e.event").where("event <> ''")
    waits = steps.select("chain_id", F.col("step").alias("dst"), F.col("starts_on").alias("event")).where("event <> ''")
    return raised.join(waits, ["chain_id", "event"]).where("src <> dst").select("chain_id", "src", "dst", "on").distinct()


def field_lineage(hops: DataFrame, starts: DataFrame | None = None, depth: int = 12) -> DataFrame:
    """(start, field, parent, kind, siblings, level): each field of starts (field; all, by default) followed upward over hops (field, parent, kind,
    priority); of several hops of a field the one with the least priority, then the parent that sorts first, is taken, and siblings
    counts the others; a field met before ends the walk."""
    best = Window.partitionBy("field")
    ranked = hops.withColumn("n", F.row_number().over(best.orderBy("priority", "parent"))).withColumn("siblings", F.count("*").over(best) - 1)
    chosen = cut(ranked.where("n = 1").select("field", "parent", "kind", "siblings"))
    first = chosen if starts is None else chosen.join(starts.select("field").distinct(), "field", "left_semi")
    frontier = cut(first.select(F.col("field").alias("start"), "field", "parent", "kind", "siblings", F.lit(1).alias("level"), F.array("field").alias("seen")))
    found = [frontier]
    for level in range(2, depth + 1):
        up = frontier.where(~F.array_contains("seen", F.col("parent"))).select("start", F.col("parent").alias("at"), F.array_append("seen", F.col("parent")).alias("trail"))
        frontier = cut(chosen.join(up, F.col("field") == F.col("at")).select("start", "field", "parent", "kind", "siblings", F.lit(level).alias("level"), F.col("trail").alias("seen")))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).drop("seen")


def dereferenced(endpoints: DataFrame, loads: DataFrame) -> DataFrame:
    """(tranid, object, dangling): endpoints (tranid, endpoint, endpoint_type) where one that names a load process (dtp, src) becomes what that loads from."""
    of = loads.groupBy("dtp").agg(F.min("src").alias("loaded"))
    by_load = F.col("endpoint_type") == "DTPA"
    return endpoints.join(of, by_load & (F.col("endpoint") == F.col("dtp")), "left").select("tranid", F.coalesce("loaded", "endpoint").alias("object"), (by_load & F.col("loaded").isNull()).alias("dangling"))


def frozen_loaders(loaders: DataFrame) -> DataFrame:
    """(target, frozen_loaders): targets (target, version) whose loaders are all inactive versions."""
    return loaders.groupBy("target").agg(F.count("*").alias("frozen_loaders"), F.bool_or(F.col("version") == "A").alias("active")).where("NOT active").drop("active")


def capability_verdicts(contract: DataFrame, present: DataFrame) -> DataFrame:
    """(capability, verdict) of a contract (capability, table_name, implemented) against the tables that exist (table_name)."""
    there = present.select("table_name", F.lit(True).alias("there")).distinct()
    per = contract.join(there, "table_name", "left").groupBy("capability").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all_there"), F.bool_and("implemented").alias("implemented"))
    return per.select("capability", F.when(~F.col("implemented"), "not_implemented").when(F.col("all_there"), "usable").otherwise("absent_on_system").alias("verdict"))
