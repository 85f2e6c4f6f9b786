"""Routines of transformations: where each one is attached, what the registry says of it, and its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.query_definitions import meaning
from cairn.plans.cut import cut

#: The columns of a transformation's header that name routines, in order, with the kind of routine; kinds of routines of rule steps
#: (any other is a field's); kinds of the registry; what a registered routine uses of the source structure (blank: indeterminate).
SLOTS = [("startroutine", "start"), ("endroutine", "end"), ("expert", "expert"), ("glbcode", "global"), ("glbcode2", "global")]
STEPS = {"NORMAL": "field", "FORMULA": "formula", "UNIT": "unit"}
KINDS = {"UR": "update_rule", "TC": "time_conversion", "TR": "transfer_rule", "IC": "infoobject_conversion", "GR": "global_routine", "S1": "deletion_routine_sdl", "TF": "transformation"}
USES = {"": "indeterminate", "0": "uses no source-structure field", "1": "uses selected source-structure fields", "2": "uses the whole source structure"}


def clean(name: str):
    """A text column without the blanks around it; null where nothing is left."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def routine_refs(headers: DataFrame, steps: DataFrame | None) -> DataFrame:
    """(tranid, codeid, kind, rule_id, place): every routine of every transformation once, at the first place that names it.

    headers: (tranid, startroutine, endroutine, expert, glbcode, glbcode2), active versions; the slots come first, in this order, then the steps of
    rules (tranid, rule_id, step_id, codeid, kind) by rule and step; None where a release has no such table. place numbers a transformation's
    routines from 1. A header that stands twice counts once.
    """
    slots = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.lit(0).cast("long").alias("step_id"), F.lit(kind).alias("kind"), clean(c).alias("codeid"), F.lit(None).cast("long").alias("rule_id")) for k, (c, kind) in enumerate(SLOTS)]))
    named = [headers.select("tranid", slots.alias("r")).select("tranid", "r.*")]
    if steps is not None:
        of = F.coalesce(meaning(F.trim("kind"), STEPS), F.lit("field"))
        named.append(steps.join(headers.select("tranid").distinct(), "tranid", "left_semi").select("tranid", F.lit(len(SLOTS)).alias("slot"), F.col("step_id").cast("long").alias("step_id"), of.alias("kind"), clean("codeid").alias("codeid"), F.col("rule_id").cast("long").alias("rule_id")))
    every = reduce(DataFrame.unionByName, named).where("codeid IS NOT NULL")
    first = every.groupBy("tranid", "codeid").agg(F.min(F.struct("slot", "rule_id", "step_id", "kind")).alias("f"))
    place = F.row_number().over(Window.partitionBy("tranid").orderBy("f.slot", "f.rule_id", "f.step_id", "codeid"))
    return first.select("tranid", "codeid", "f.kind", "f.rule_id", place.alias("place"))


#: Lines of a routine from which its transformations are counted, and rows that a task makes of one routine, about.
LONG, ROWS = 64, 1 << 22


def routine_source(refs: DataFrame, lines: DataFrame, long: int = LONG, rows: int = ROWS) -> DataFrame:
    """(tranid, codeid, kind, rule_id, place, line_no, line): the source of each routine, line by line; a routine without source has one row of nulls.

    Lines stay rows, so a routine of any length, and one that many transformations share, is never held as one value. Where many share a routine of
    `long` lines or more, they are dealt into groups of some `rows` result rows, and each group meets the lines by itself.
    """
    refs, lines = cut(refs), lines.select("codeid", "line_no", "line")
    size = lines.groupBy("codeid").agg(F.count("*").alias("lines")).where(F.col("lines") >= long)
    used = refs.join(cut(size), "codeid").groupBy("codeid", "lines").agg(F.count("*").alias("refs"))
    groups = cut(used.select("codeid", F.ceil(F.col("refs") * F.col("lines") / rows).alias("groups")).where("groups > 1"))
    n = F.coalesce("groups", F.lit(1))
    dealt = refs.join(groups, "codeid", "left").withColumn("g", F.pmod(F.xxhash64("tranid"), n)).drop("groups")
    each = lines.join(groups, "codeid", "left").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("groups")
    return dealt.join(each, ["codeid", "g"], "left").select("tranid", "codeid", "kind", "rule_id", "place", "line_no", "line")


def routine_registry(wanted: DataFrame, registry: DataFrame, texts: DataFrame, lines: DataFrame, language: str = "E") -> DataFrame:
    """(codeid, kind_code, kind, description, owner, active, uses, line_count, source_available) of wanted routines (codeid) that the registry
    (codeid, codetp, owner, objstat, activfl, dependency) knows; others are left out, not made up.

    A routine is active where both its status and its flag say so. Its description (codeid, langu, text) is the one of `language`, else the one of the
    least other language. Lines (codeid, line_no, line) are counted before they are joined.
    """
    key = F.trim("codeid").alias("codeid")
    known = registry.select(key, clean("codetp").alias("kind_code"), clean("owner").alias("owner"), (F.col("objstat") == "ACT").alias("act"), (F.col("activfl") == "X").alias("flag"), F.coalesce(clean("dependency"), F.lit("")).alias("dependency"))
    known = known.where("codeid <> ''").join(wanted.select(key).distinct(), "codeid", "left_semi").groupBy("codeid").agg(F.min(F.struct("kind_code", "owner", "act", "flag", "dependency")).alias("r")).select("codeid", "r.*")
    said = texts.where("trim(coalesce(text, '')) <> ''").groupBy(key).agg(F.min_by(F.trim("text"), F.struct(F.col("langu") != language, F.col("langu"), F.col("text"))).alias("description"))
    size = lines.groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    no = F.lit(False)
    return known.join(said, "codeid", "left").join(size, "codeid", "left").select(
        "codeid", "kind_code", F.coalesce(meaning(F.col("kind_code"), KINDS), F.lit("unknown")).alias("kind"), "description", "owner", (F.coalesce("act", no) & F.coalesce("flag", no)).alias("active"), meaning(F.col("dependency"), USES).alias("uses"), n.alias("line_count"), (n > 0).alias("source_available"))


def extracts(endpoints: DataFrame, datasources: DataFrame) -> DataFrame:
    """(datasource, system, structure, type, delta) of endpoints (datasource, system): what the DataSource's row (datasource, system, structure, type,
    delta) of that system says; where no system is named, the row that sorts first by structure and type over all systems. Nulls where no row is."""
    row = F.struct(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("structure", "type", "delta")])
    rows = datasources.select("datasource", F.trim(F.coalesce("system", F.lit(""))).alias("at"), row.alias("r"))
    each = rows.where("at <> ''").groupBy("datasource", "at").agg(F.min("r").alias("r")).unionByName(rows.groupBy("datasource").agg(F.min("r").alias("r")).withColumn("at", F.lit("")))
    wanted = endpoints.select("datasource", F.trim(F.coalesce("system", F.lit(""))).alias("at")).distinct()
    return wanted.join(each, ["datasource", "at"], "left").select("datasource", F.nullif("at", F.lit("")).alias("system"), "r.structure", "r.type", "r.delta")


def mentions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(codeid, name): names (name) that a routine's lines (codeid, line) hold as whole words, in any case; comments count, as they may be code put aside.

    Words are joined with names by equality, so no line meets every name.
    """
    words = lines.select("codeid", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("line"), F.lit("([A-Z0-9_/]+)"), 1))).alias("word")).distinct()
    known = names.where("trim(coalesce(name, '')) <> ''").select("name", F.upper(F.trim("name")).alias("word")).distinct()
    return words.join(known, "word").select("codeid", "name").distinct()


def code_consumers(found: DataFrame, refs: DataFrame, headers: DataFrame) -> DataFrame:
    """(name, consumer, transformations): the targets of transformations (tranid, dst) one of whose routines (routine_refs()) mentions the name; a target that
    mentions itself is none."""
    by = refs.select("tranid", "codeid").join(headers.select("tranid", F.col("dst").alias("consumer")).distinct(), "tranid")
    return found.join(by, "codeid").where("consumer <> name AND trim(consumer) <> ''").groupBy("name", "consumer").agg(F.countDistinct("tranid").alias("transformations"))


def impact_with_code(reached: DataFrame, consumers: DataFrame) -> DataFrame:
    """(root, affected, hops, by_code) of what a change of each root affects: what it reaches (root, node, hops), and what code reads it (code_consumers()),
    which no declared hop shows; hops is null for what only code leads to. The root itself isn't affected."""
    declared = reached.where("root <> node").groupBy("root", F.col("node").alias("affected")).agg(F.min("hops").alias("hops"))
    coded = consumers.select(F.col("name").alias("root"), F.col("consumer").alias("affected"), F.lit(True).alias("code")).distinct()
    return declared.join(coded, ["root", "affected"], "full_outer").select("root", "affected", "hops", F.coalesce("code", F.lit(False)).alias("by_code"))


def transformation_facts(headers: DataFrame) -> DataFrame:
    """(family, name, source, target, has_start_routine, has_end_routine, has_expert_routine, has_global_routine) for a snapshot of transformations (tranid, src,
    dst, startroutine, endroutine, expert, glbcode, glbcode2), keyed by id, as two may connect the same ends.

    Routines count by presence: their ids change with every activation, even where the code doesn't. Rows without an id are left out.
    """
    has = lambda name, *columns: F.initcap(F.coalesce(*[clean(c) for c in columns]).isNotNull().cast("string")).alias(name)
    end = lambda c: F.coalesce(clean(c), F.lit("")).alias({"src": "source", "dst": "target"}[c])
    keyed = headers.where("trim(coalesce(cast(tranid AS string), '')) <> ''")
    return keyed.select(
        F.lit("transformation").alias("family"), F.trim(F.col("tranid").cast("string")).alias("name"), end("src"), end("dst"),
        has("has_start_routine", "startroutine"), has("has_end_routine", "endroutine"), has("has_expert_routine", "expert"), has("has_global_routine", "glbcode", "glbcode2"))
