"""Stored models of composite providers: what they read, and where each of their fields comes from through the model's own stack of nodes.

A model is XML with view nodes; an input of a node reads an object or another node of the same model, and maps that one's fields to the
node's own. A field is followed as (node, field), one input and one rename at a time, for all fields of all models at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.cut import cut

#: What is read of a stored model. The reader counts fields wrongly behind a column for malformed rows, so that one stands last.
COMPOSITE = """_defaultNode string, viewNode array<struct<_name: string, `_xsi:type`: string, input: array<struct<_alias: string, _selectAll: string, entity: array<string>,
viewNode: array<struct<_VALUE: string, _name: string>>, mapping: array<struct<_targetName: string, _sourceName: string, `_xsi:type`: string>>>>>>, _corrupt_record string"""
#: What the kind code in an input's alias means; any other code is unknown.
ALIAS_KINDS = {"ADSO": "adso", "CUBE": "infocube", "ODSO": "dso", "DSO": "dso", "IOBJ": "infoobject", "HCPR": "compositeprovider", "CALC": "calcview"}
#: Kinds of mappings, and the suffix of a reference to a calculation view.
MAPPING_KINDS = {"Type:ElementMapping": "element", "Type:ConstantElementMapping": "constant"}
CALCULATION_VIEW = "calculationview"
#: Fixed value: the largest definition that is read, in characters.
MOST_CHARS = 8 * 1024 * 1024


def tidy(text: Column) -> Column:
    """Text with single blanks, or null if nothing is left."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(out != "", out)


def unreadable(xml: Column, root_ends: str, most_chars: int) -> Column:
    """Why a stored definition isn't read: empty, too_large, document_type (never legitimate, and what entity attacks need) or other_root;
    null if it may be read."""
    root = F.regexp_extract(xml, r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--[\s\S]*?-->\s*)*<([A-Za-z0-9_:.-]+)", 1)
    return (
        F.when(F.coalesce(F.trim(xml), F.lit("")) == "", "empty").when(F.length(xml) > most_chars, "too_large")
        .when(xml.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)\b"), "document_type").when(~root.endswith(root_ends), "other_root")
    )


def parsed(models: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(name, status, model) of every row of models (name, xml): status is parsed, or why the model isn't."""
    reason = unreadable(F.col("xml"), "compositeView", most_chars)
    found = models.select("name", reason.alias("reason"), F.from_xml(F.when(reason.isNull(), F.col("xml")), COMPOSITE, {"mode": "PERMISSIVE"}).alias("model"))
    return found.select("name", F.coalesce("reason", F.when(F.col("model._corrupt_record").isNotNull(), "not_well_formed"), F.lit("parsed")).alias("status"), "model")


def statuses(models: DataFrame) -> DataFrame:
    """(name, status, nodes, inputs) of every model: one that can't be read is never one without parts."""
    ok = F.col("status") == "parsed"
    held = F.aggregate("model.viewNode", F.lit(0), lambda n, v: n + F.coalesce(F.array_size(v["input"]), F.lit(0)))
    return parsed(models).select("name", "status", F.when(ok, F.coalesce(F.array_size("model.viewNode"), F.lit(0))).alias("nodes"), F.when(ok, F.coalesce(held, F.lit(0))).alias("inputs"))


def decoded_part(entity: Column) -> tuple[Column, Column]:
    """The object that an entity reference names, as catalogues spell it, and the kind of document it is: <name>.<kind>#<path>, where a name
    in a namespace is written $NS$NAME."""
    pattern = r"^(.+)\.([A-Za-z]+)#"
    name = F.trim(F.regexp_extract(entity, pattern, 1))
    spelled = F.when(name.rlike(r"^\$[^$]+\$."), F.regexp_replace(name, r"^\$([^$]+)\$", "/$1/")).otherwise(name)
    return F.when(spelled != "", spelled), F.lower(F.regexp_extract(entity, pattern, 2))


def runtime_view(name: Column) -> Column:
    """The run-time name of a calculation view in a package: dots in the package, a slash before the view."""
    package, view = F.regexp_extract(name, "^(.*)/[^/]*$", 1), F.regexp_extract(name, "/([^/]*)$", 1)
    return F.when((package != "") & (view != ""), F.concat(F.translate(package, "/", "."), F.lit("/"), view))


def inputs(models: DataFrame) -> DataFrame:
    """(name, top, node, node_type, alias, part, part_kind, alias_kind, internal, runtime_view, mappings) of every input of every readable
    model: `part` is the object that it reads, `internal` the node of the same model if it reads one; `top` is the node that consumers read."""
    ok = parsed(models).where("status = 'parsed'")
    default = F.element_at(F.split("model._defaultNode", "/"), -1)
    names = F.filter(F.transform("model.viewNode", lambda v: tidy(v["_name"])), lambda n: n.isNotNull())
    top = F.when(F.array_contains(names, default), default).otherwise(F.get(names, F.lit(0)))
    nodes = ok.select("name", top.alias("top"), F.explode("model.viewNode").alias("v")).select("name", "top", tidy(F.col("v._name")).alias("node"), tidy(F.col("v.`_xsi:type`")).alias("node_type"), F.explode("v.input").alias("i")).where("node IS NOT NULL")
    alias = F.coalesce(tidy(F.col("i._alias")), F.lit(""))
    pieces = F.split(alias, r"\.")
    code = F.when((F.size(pieces) >= 3) & (F.trim(F.get(pieces, F.lit(1))) != ""), F.upper(F.trim(F.get(pieces, F.lit(1)))))
    part, kind = decoded_part(tidy(F.get("i.entity", F.lit(0))))
    known = F.create_map(*[F.lit(x) for pair in ALIAS_KINDS.items() for x in pair])
    part_kind = F.when(part.isNotNull() & (kind == CALCULATION_VIEW), "calcview").otherwise(F.coalesce(known[code], F.lit("unknown")))
    internal = tidy(F.element_at(F.split(F.get("i.viewNode", F.lit(0))["_VALUE"], "/"), -1))
    out = nodes.select("name", "top", "node", "node_type", alias.alias("alias"), part.alias("part"), part_kind.alias("part_kind"), code.alias("alias_kind"), F.when(part.isNull(), internal).alias("internal"), "i.mapping")
    mapped = F.filter(F.transform("mapping", lambda m: F.struct(tidy(m["_targetName"]).alias("target"), tidy(m["_sourceName"]).alias("source"), tidy(m["_xsi:type"]).alias("type"))), lambda m: m["target"].isNotNull())
    return out.select(*out.columns[:-1], F.when(F.col("part_kind") == "calcview", runtime_view(F.col("part"))).alias("runtime_view"), F.coalesce(mapped, F.expr("array()")).alias("mappings"))


def parts(models: DataFrame) -> DataFrame:
    """(name, part, part_kind, alias_kind, runtime_view) of the objects outside that models read; references among a model's own nodes are no parts."""
    return inputs(models).where("part IS NOT NULL").select("name", "part", "part_kind", "alias_kind", "runtime_view").distinct()


def mappings(models: DataFrame) -> DataFrame:
    """(name, top, node, alias, part, part_kind, internal, runtime_view, target, source, mapping_kind): one row per mapping; a constant has no source."""
    each = inputs(models).withColumn("m", F.explode("mappings"))
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in MAPPING_KINDS.items() for x in pair])[F.col("m.type")], F.lit("unknown"))
    return each.select("name", "top", "node", "alias", "part", "part_kind", "internal", "runtime_view", "m.target", F.when(kind != "constant", F.col("m.source")).alias("source"), kind.alias("mapping_kind"))


def resolved_fields(models: DataFrame, depth: int = 32) -> DataFrame:
    """(name, field, stop, part, part_kind, source, mapping_kind, runtime_view, node, asked, via, hops): where each field of each model's top node
    comes from, through the whole stack.

    stop is `object` where an object supplies it under the name `source`, `constant` where a value is fixed in the model, `no_mapping` where
    a node (node) supplies no field of the name asked there (asked), `unreadable_part` where an input names no object that can be read,
    `loop` where the model comes back to a node and field, `too_deep` beyond `depth` nodes. Field names match whatever their case. An
    object and source reached on several ways count once, by the way of the fewest hops, then the one whose aliases sort first.
    """
    maps = cut(mappings(models).withColumn("key", F.upper("target")))
    fields = maps.where("node = top").groupBy("name", "node", "key").agg(F.min("target").alias("field"))
    state = fields.select("name", "field", "node", F.col("key").alias("asked"), F.array().cast("array<string>").alias("way"), F.array(F.concat_ws("\n", "node", "key")).alias("seen"))
    ends = []
    for level in range(depth + 1):
        state = cut(state)
        if state.isEmpty():
            break
        own = maps.select(F.col("name").alias("of"), F.col("node").alias("at"), "key", "alias", "part", "part_kind", "internal", "runtime_view", "source", "mapping_kind", F.lit(True).alias("mapped"))
        step = state.join(own, (F.col("name") == F.col("of")) & (F.col("node") == F.col("at")) & (F.col("asked") == F.col("key")), "left").withColumn("to", F.concat_ws("\n", "internal", F.upper("source")))
        on = F.col("internal").isNotNull() & F.col("source").isNotNull()
        stop = (
            F.when(F.col("mapped").isNull(), "no_mapping").when(on & F.array_contains("seen", F.col("to")), "loop").when(on & F.lit(level == depth), "too_deep").when(on, None)
            .when(F.col("mapping_kind") == "constant", "constant").when(F.col("part").isNull(), "unreadable_part").otherwise("object")
        )
        step = step.withColumn("stop", stop).withColumn("way", F.when(F.col("mapped"), F.array_append("way", F.coalesce("alias", F.lit("")))).otherwise(F.col("way")))
        ends.append(cut(step.where("stop IS NOT NULL").select("name", "field", "stop", "part", F.when(F.col("part").isNotNull(), F.col("part_kind")).alias("part_kind"), "source", "mapping_kind", "runtime_view", "node", "asked", F.array_join("way", ">").alias("via"), F.size("way").alias("hops"))))
        state = step.where("stop IS NULL").select("name", "field", F.col("internal").alias("node"), F.upper("source").alias("asked"), "way", F.array_append("seen", F.col("to")).alias("seen"))
    if not ends:
        ends = [maps.limit(0).select("name", F.col("target").alias("field"), F.lit("").alias("stop"), "part", "part_kind", "source", "mapping_kind", "runtime_view", "node", F.col("key").alias("asked"), F.col("alias").alias("via"), F.lit(0).alias("hops"))]
    found = reduce(DataFrame.unionByName, ends)
    supplied = F.col("stop").isin("object", "constant")
    same = Window.partitionBy("name", "field", "stop", "part", F.upper(F.coalesce("source", F.lit(""))), F.when(~supplied, F.concat_ws("\n", "node", "asked")))
    return found.withColumn("n", F.row_number().over(same.orderBy("hops", "via"))).where("n = 1").drop("n")
