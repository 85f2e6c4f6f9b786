"""Definitions of queries: the tree of elements below each query, what the elements are, where they stand, and what they are restricted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import graph

#: How deep and how far a definition is followed.
MOST_DEPTH, MOST_ELEMENTS = 10, 500
#: Kinds of elements by their code; a selection's by its subcode, else by what it selects on.
ELEMENTS = {
    "REP": "query", "SEL": "selection", "CKF": "calculated_key_figure", "FML": "formula", "VAR": "variable", "STR": "structure", "SOB": "filter", "SHT": "query_sheet", "CEL": "cell", "ATR": "attribute", "NIL": "none",
}
SELECTIONS = {"CON": "condition", "EXC": "exception", "CHA": "characteristic", "RKF": "restricted_key_figure"}
KEY_FIGURES = "1KYFNM"
#: Where a child stands, by its parent's code and the code of the edge; NIL is referenced, not placed, under any parent.
AXES = {
    ("SHT", "ROW"): "rows", ("SHT", "COL"): "columns", ("SHT", "AGG"): "free_characteristics", ("SHT", "FLT"): "structure_member", ("SHT", "ATR"): "attribute_order", ("SOB", "AGG"): "filter", ("SOB", "COL"): "reference",
    ("SOB", "ROW"): "reference", ("REP", "VAR"): "variable_sequence", ("REP", "SHT"): "structural", ("REP", "SOB"): "structural",
}
UNPLACED = "NIL"
#: The role that an edge's code declares.
ROLES = {
    "ROW": "rows", "COL": "columns", "FIX": "filter", "FLT": "free", "VAR": "variable", "CEL": "cell", "MBR": "structure_member", "NAV": "navigation", "AGG": "aggregated", "NIL": "unplaced", "SHT": "query_sheet",
    "SOB": "selection_object", "ATR": "attribute_order", "QVR": "query_variable_sequence", "OPD": "operand", "RNG": "area", "REP": "internal",
}
#: The flag of a bound that names a variable, and what a threshold holds by its flag.
VARIABLE = "3"
HOLDS = {"0": "unknown", "1": "literal", "2": "element_uid", "3": "variable_name", "4": "infoobject", "5": "constant", "6": "variable_name"}
#: Dimensions under which conditions and exceptions are stored, and the facets of their rows.
CONDITIONS, MEASURE, VALUE = ["1CONDITION", "1EXCEPTION"], "1STRUC", "1VALUE"
#: Operators that the dictionary declares, and the one whose meaning is only observed.
OPERATORS = {
    "EQ": "Equal: Single Value", "NE": "Not Equal: Everything Apart from the Specified Single Value", "BT": "Between: Range of Values", "NB": "Not Between: Everything Outside the Range", "LE": "Less or Equal: Everything <= Value in Field LOW",
    "GT": "Greater Than: Everything > Value in Field LOW", "GE": "Greater or Equal: Everything >= Value in Field LOW", "LT": "Less Than: Everything < Value in Field LOW", "CP": "Contains Pattern: Masked Input: Find Pattern",
    "NP": "Not Contains Pattern: Masked Input: Reject Pattern",
}
OBSERVED = {"TC": "Top N (count)"}
#: Fixed value: the alert level that stands for none.
NO_LEVEL = "00"


def code(column: str) -> Column:
    return F.upper(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def meaning(value: Column, meanings: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])[value]


def element_tree(queries: DataFrame, xref: DataFrame, depth: int = MOST_DEPTH, most: int = MOST_ELEMENTS) -> DataFrame:
    """(query, element, level, place, elements, capped, cut): what each query (query) reaches over the edges xref (parent, child), itself on level 0,
    every element once, on its least level; of an answer the first `most` by level, then id. `elements` counts them all; capped tells that
    there are more than `most`, cut that some on the last level have children."""
    edges = graph.edges_of(xref, "parent", "child")
    roots = queries.select(F.col("query").alias("root")).distinct()
    below = graph.reachability(edges, depth, roots).where("node <> root").select(F.col("root").alias("query"), F.col("node").alias("element"), F.col("hops").alias("level"))
    tree = roots.select(F.col("root").alias("query"), F.col("root").alias("element"), F.lit(0).alias("level")).unionByName(below)
    parents = edges.select(F.col("src").alias("element"), F.lit(True).alias("has_children")).distinct()
    tree = tree.join(parents, "element", "left")
    own = Window.partitionBy("query")
    tree = tree.withColumn("place", F.row_number().over(own.orderBy("level", "element"))).withColumn("elements", F.count("*").over(own))
    tree = tree.withColumn("capped", F.col("elements") > most).withColumn("cut", F.max(F.coalesce("has_children", F.lit(False)) & (F.col("level") == depth)).over(own))
    return tree.where(F.col("place") <= most).select("query", "element", "level", "place", "elements", "capped", "cut")


def element_types(directory: DataFrame, selects: DataFrame) -> DataFrame:
    """(element, deftp, type, infoobject) of elements (element, deftp, subdeftp), by their codes and what they select on (element, infoobject): a
    selection on the dimension of key figures is a restricted key figure, on anything else it places that characteristic."""
    picked = selects.where("coalesce(trim(infoobject), '') <> ''").groupBy("element").agg(
        F.bool_or(code("infoobject") == KEY_FIGURES).alias("figures"), F.min(F.when(code("infoobject") != KEY_FIGURES, F.trim("infoobject"))).alias("other"))
    kind, sub = code("deftp"), code("subdeftp")
    selected = F.when(F.col("figures").isNull(), "selection").when(F.col("figures"), "restricted_key_figure").otherwise("characteristic")
    typed = F.when(kind == "SEL", F.coalesce(meaning(sub, SELECTIONS), selected)).otherwise(F.coalesce(meaning(kind, ELEMENTS), F.lit("unknown")))
    out = directory.join(picked, "element", "left").withColumn("type", typed)
    return out.select("element", kind.alias("deftp"), "type", F.when(F.col("type") == "characteristic", F.col("other")).alias("infoobject"))


def restrictions(ranges: DataFrame) -> DataFrame:
    """(element, infoobject, sign, operator, low, high, low_is_variable, high_is_variable) of stored ranges; each once per element."""
    clean = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.trim(c))
    variable = lambda c: F.coalesce(F.trim(c) == VARIABLE, F.lit(False))
    out = ranges.select("element", clean("infoobject").alias("infoobject"), clean("sign").alias("sign"), clean("opt").alias("operator"), clean("low").alias("low"), clean("high").alias("high"), variable("lowflag").alias("low_is_variable"), variable("highflag").alias("high_is_variable"))
    return out.where("infoobject IS NOT NULL").distinct()


def rolled_restrictions(tree: DataFrame, xref: DataFrame, types: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query, element, own, infoobject, sign, operator, low, high, low_is_variable, high_is_variable): what each element of a definition is
    restricted to. A filter node stores nothing itself, so it gets its children's restrictions too (own is false), each once; the children
    keep theirs."""
    stored = restrictions(ranges)
    facts = [c for c in stored.columns if c != "element"]
    elements = tree.select("query", "element")
    own = elements.join(stored, "element").withColumn("own", F.lit(True))
    filters = elements.join(types.where("type = 'filter'").select("element"), "element", "left_semi")
    children = graph.edges_of(xref, "parent", "child").select(F.col("src").alias("element"), F.col("dst").alias("child"))
    below = filters.join(children, "element").join(stored.withColumnRenamed("element", "child"), "child").select("query", "element", F.lit(False).alias("own"), *facts)
    every = own.select("query", "element", "own", *facts).unionByName(below)
    return every.groupBy("query", "element", *facts).agg(F.bool_or("own").alias("own")).select("query", "element", "own", *facts)


def placed_edges(tree: DataFrame, xref: DataFrame, types: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(query, parent, child, position, role, axis) of the edges xref (parent, child, laytp, position) within each definition: the role by the
    edge's own code, the axis by its parent's kind and that code together; a pair without a known meaning stands on an unknown axis."""
    parents = tree.where(F.col("level") < depth).select("query", F.col("element").alias("parent"))
    kept = tree.select("query", F.col("element").alias("child"))
    edges = xref.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child", "position", code("laytp").alias("laytp"))
    inside = parents.join(edges, "parent").join(kept, ["query", "child"]).join(types.select(F.col("element").alias("parent"), "deftp"), "parent", "left")
    pairs = meaning(F.concat_ws("/", F.coalesce("deftp", F.lit("?")), "laytp"), {f"{a}/{b}": axis for (a, b), axis in AXES.items()})
    axis = F.when(F.col("laytp") == UNPLACED, "unplaced").otherwise(F.coalesce(pairs, F.lit("unknown")))
    return inside.select("query", "parent", "child", "position", F.coalesce(meaning(F.col("laytp"), ROLES), F.lit("other")).alias("role"), axis.alias("axis"))


def definition(tree: DataFrame, types: DataFrame, rolled: DataFrame) -> DataFrame:
    """(query, element, level, place, type, infoobject, restrictions, variables, capped, cut): every element of every definition with the number of
    its restrictions and the variables that they name."""
    names = F.array_compact(F.array(F.when(F.col("low_is_variable"), F.col("low")), F.when(F.col("high_is_variable"), F.col("high"))))
    per = rolled.groupBy("query", "element").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))), ",").alias("v"))
    out = tree.join(types, "element", "left").join(per, ["query", "element"], "left")
    return out.select("query", "element", "level", "place", F.coalesce("type", F.lit("unknown")).alias("type"), "infoobject", F.coalesce("n", F.lit(0)).alias("restrictions"), F.coalesce("v", F.lit("")).alias("variables"), "capped", "cut")


def conditions(tree: DataFrame, types: DataFrame, ranges: DataFrame, state: DataFrame) -> DataFrame:
    """(query, element, kind, active, operator, operator_label, confidence, threshold, threshold_holds, measure, levels, drilldown) of the
    conditions and exceptions within each definition.

    Their definition is rows of ranges (element, infoobject, facet, opt, low, lowflag, level) under a dimension of their own: of facet 1STRUC the
    element that is tested, of facet 1VALUE operator and threshold; any other facet is a characteristic that an exception is evaluated at.
    A condition has one threshold, an exception has alert levels instead. An operator that the dictionary doesn't declare is advisory, with
    a label only where one was observed. state: (element, infoobject, active).
    """
    kinds = types.where("type IN ('condition', 'exception')").select("element", F.col("type").alias("kind"))
    own = ranges.where(F.col("infoobject").isin(CONDITIONS))
    value = F.col("facet") == VALUE
    least = lambda when, c: F.min(F.when(when, F.col(c)))
    first = F.min(F.when(value & (F.coalesce("level", F.lit(NO_LEVEL)) == NO_LEVEL), F.struct(F.upper(F.trim("opt")).alias("opt"), "low", "lowflag")))
    drill = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("facet").isin(MEASURE, VALUE), F.col("facet")))), ",")
    levels = F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce("level", F.lit(NO_LEVEL)) != NO_LEVEL, F.col("level")))), ",")
    per = own.groupBy("element").agg(least(F.col("facet") == MEASURE, "low").alias("measure"), first.alias("v"), drill.alias("drilldown"), levels.alias("levels"))
    switched = state.where(F.col("infoobject").isin(CONDITIONS)).groupBy("element").agg(F.bool_or(code("active") == "X").alias("active"))
    out = tree.select("query", "element").join(kinds, "element").join(per, "element", "left").join(switched, "element", "left")
    single = F.col("kind") == "condition"
    operator = F.when(single, F.col("v.opt"))
    label = F.coalesce(meaning(operator, OPERATORS), meaning(operator, OBSERVED))
    return out.select(
        "query", "element", "kind", F.coalesce("active", F.lit(False)).alias("active"), operator.alias("operator"), label.alias("operator_label"), F.when(operator.isNotNull(), F.when(operator.isin(list(OPERATORS)), "dictionary").otherwise("advisory")).alias("confidence"),
        F.when(single, F.col("v.low")).alias("threshold"), F.when(single, F.coalesce(meaning(F.trim("v.lowflag"), HOLDS), F.lit("unknown"))).alias("threshold_holds"), "measure", F.when(~single, F.coalesce("levels", F.lit(""))).alias("levels"), F.coalesce("drilldown", F.lit("")).alias("drilldown"),
    )
