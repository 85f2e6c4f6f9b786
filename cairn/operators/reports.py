"""Reports about a system itself: what a contract of capabilities finds there, which grants are missing, which tools can run, which kinds of objects
it uses; and answers cut to a size that a reader can take in, with exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many items of each kind an answer shows at most.
MOST_FIELDS, MOST_NODES, MOST_EDGES, MOST_NAMED = 40, 60, 90, 25
#: Variants of objects and the table, or group of found tables, that shows them.
VARIANTS = {"classic_dso": "dso_header", "adso": "adso", "composite_provider": "composite_provider", "multiprovider": "multiprovider_part"}


def verdict(implemented: Column, present: Column) -> Column:
    """usable, absent_on_system, not_implemented or not_applicable; where presence is unknown (null) only the implementation decides."""
    return F.when(implemented & F.coalesce(present, F.lit(True)), "usable").when(implemented, "absent_on_system").when(F.coalesce(present, F.lit(True)), "not_implemented").otherwise("not_applicable")


def capability_report(contract: DataFrame, probes: DataFrame) -> DataFrame:
    """(capability, object, state, validation, present, row_estimate, verdict) of all that the contract (capability, object, state, validation,
    implemented) declares or the probes (capability, object, present, row_estimate) found.

    What was found but isn't declared is PLANNED and not implemented; what was declared but not probed has no presence.
    """
    declared = contract.groupBy("capability").agg(F.min(F.struct("object", "state", "validation", "implemented")).alias("c"))
    found = probes.groupBy("capability").agg(F.max(F.struct("present", "object", "row_estimate")).alias("p"))
    both = declared.join(found, "capability", "full_outer")
    done = F.coalesce("c.implemented", F.lit(False))
    return both.select(
        "capability", F.coalesce("c.object", "p.object").alias("object"), F.coalesce("c.state", F.lit("PLANNED")).alias("state"), F.coalesce("c.validation", F.lit("not_validated")).alias("validation"),
        F.col("p.present").alias("present"), F.col("p.row_estimate").alias("row_estimate"), verdict(done, F.col("p.present")).alias("verdict"))


def capability_totals(report: DataFrame) -> DataFrame:
    """(total, value, capabilities): how many capabilities have each verdict and state, how well the usable ones are validated, and, as caveats, how
    many were not probed (untracked) and how many usable ones nobody proved on a real system (unproven)."""
    usable = F.col("verdict") == "usable"
    unproven = usable & F.col("validation").isin("not_validated", "unit_tested")
    pairs = F.array_compact(F.array(
        *[F.when(when, F.struct(F.lit(total).alias("total"), value.alias("value"))) for total, value, when in [
            ("verdict", F.col("verdict"), F.lit(True)), ("state", F.col("state"), F.lit(True)), ("validation", F.col("validation"), usable), ("caveat", F.lit("untracked"), F.col("present").isNull()), ("caveat", F.lit("unproven"), unproven)]]))
    return report.select(F.explode(pairs).alias("t")).groupBy("t.total", "t.value").agg(F.count("*").alias("capabilities"))


def grant_groups(groups: DataFrame, probes: DataFrame) -> DataFrame:
    """(grp, state, tracked, denied, undetermined) of groups of grants (grp, capability) against probes (capability, probe, present).

    A group is `denied` where a probe was refused and nothing answered, `partial` where some did, `undetermined` where no probe came to an end or none
    belongs to it, `granted` where something is there, else `absent`, which is a matter of the release and no refusal.
    """
    each = groups.select("grp", "capability").distinct().join(probes.groupBy("capability").agg(F.min("probe").alias("probe"), F.bool_or("present").alias("present")), "capability", "left")
    refused, unsure = F.col("probe") == "denied", F.col("probe").isin("failed", "not_probed")
    answered = F.col("probe").isNotNull() & ~refused & ~unsure
    per = each.groupBy("grp").agg(F.count("probe").alias("tracked"), F.count_if(refused).alias("denied"), F.count_if(unsure).alias("undetermined"), F.count_if(answered & F.col("present")).alias("there"), F.count_if(answered).alias("answered"))
    state = F.when((F.col("denied") > 0) & (F.col("answered") > 0), "partial").when(F.col("denied") > 0, "denied").when(F.col("answered") == 0, "undetermined").when(F.col("there") > 0, "granted").otherwise("absent")
    return per.select("grp", state.alias("state"), "tracked", "denied", "undetermined")


def access_mode(states: DataFrame) -> DataFrame:
    """(mode, voting) in one row, of groups' states (grp, state, tracked): least_privilege where anything is refused, unknown where a group is undetermined
    or none votes, else technical_read. Groups without a tracked capability don't vote."""
    per = states.where("tracked > 0").agg(F.count("*").alias("voting"), F.count_if(F.col("state").isin("denied", "partial")).alias("refused"), F.count_if(F.col("state") == "undetermined").alias("unsure"))
    return per.select(F.when(F.col("refused") > 0, "least_privilege").when((F.col("voting") == 0) | (F.col("unsure") > 0), "unknown").otherwise("technical_read").alias("mode"), "voting")


def tool_support(requires: DataFrame, report: DataFrame) -> DataFrame:
    """(tool, requires, missing, first_missing, runs) of tools (tool, capability): how many of the capabilities that a tool reads are not present on the system
    (an unknown presence counts as missing), the first of them by name, and whether it can run."""
    there = report.where("present").select("capability", F.lit(True).alias("there"))
    each = requires.select("tool", "capability").distinct().join(there, "capability", "left")
    gone = F.col("there").isNull()
    per = each.groupBy("tool").agg(F.count("*").alias("requires"), F.count_if(gone).alias("missing"), F.min(F.when(gone, F.col("capability"))).alias("first_missing"))
    return per.withColumn("runs", F.col("missing") == 0)


def object_models(probes: DataFrame) -> DataFrame:
    """(variant, present, inconclusive) of every variant of objects: present where one of its tables (capability, present, unreadable) is; inconclusive where
    none is but one of them could not be read, so that a false says nothing."""
    known = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(v), F.lit(t)) for v, t in VARIANTS.items()]))).alias("variant", "capability")
    variants = probes.sparkSession.range(1).select(known)
    per = probes.groupBy("capability").agg(F.bool_or("present").alias("p"), F.bool_or("unreadable").alias("u"))
    no = F.lit(False)
    return variants.join(per, "capability", "left").select("variant", F.coalesce("p", no).alias("present"), (~F.coalesce("p", no) & F.coalesce("u", no)).alias("inconclusive"))


def ranked(items: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """items with shown_as: of each key's items the first `most` by `order`, which has to tell them apart.

    The rank is cut before rows are sent, so of a key with many items only `most` leave each task.
    """
    return items.withColumn("shown_as", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("shown_as") <= most)


def shaped_fields(fields: DataFrame, most: int = MOST_FIELDS) -> DataFrame:
    """Fields (provider, field, is_key, ...) with (total, summarised): all of a provider with up to `most`, else the keys alone."""
    totals = fields.groupBy("provider").agg(F.count("*").alias("total"))
    out = fields.join(totals, "provider").withColumn("summarised", F.col("total") > most)
    return out.where("NOT summarised OR is_key")


def shaped_graphs(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> DataFrame:
    """(root, src, dst, node_count, edge_count, nodes_shown, summarised) of each root's graph: nodes (root, node, level) and edges (root, src, dst).

    The nodes nearest the root stay, then the first edges both of whose ends stay, so no edge dangles and a graph within both bounds is whole; the
    counts are of the whole. A graph of which no edge is left is one row with null ends.
    """
    n = nodes.groupBy("root", "node").agg(F.min("level").alias("level"))
    e = edges.select("root", "src", "dst").distinct()
    sizes = n.groupBy("root").agg(F.count("*").alias("node_count")).join(e.groupBy("root").agg(F.count("*").alias("edge_count")), "root", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    near = ranked(n, "root", ["level", "node"], most_nodes).select("root", "node")
    both = e.join(near.withColumnRenamed("node", "src"), ["root", "src"], "left_semi").join(near.withColumnRenamed("node", "dst"), ["root", "dst"], "left_semi")
    out = sizes.join(ranked(both, "root", ["src", "dst"], most_edges), "root", "left")
    summarised = (F.col("node_count") > most_nodes) | (F.col("edge_count") > most_edges)
    return out.select("root", "src", "dst", "node_count", "edge_count", F.least("node_count", F.lit(most_nodes)).alias("nodes_shown"), summarised.alias("summarised"))


def named_boundary(reached: DataFrame, most: int = MOST_NAMED) -> DataFrame:
    """(root, node, total) of the boundary of each root (root, node): its first `most` objects by name, and how many there are."""
    every = reached.select("root", "node").distinct()
    return ranked(every, "root", ["node"], most).join(every.groupBy("root").agg(F.count("*").alias("total")), "root").select("root", "node", "total")
