"""Extractor exits: which DataSources their code handles, the lines of each one's own branch, and the programs that they dispatch to.

Code comes as lines (codeid, line_no, line). Blocks are matched by running counts of their opening and closing statements; a level of
nesting is a partition of its own, so the marker that a line belongs to is the last one of its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.code import has, literal, name, named, places, tokenised, upto, word

#: What the beginning of a customer's program name looks like, a namespace before a name, and how long a program's name may be.
PREFIX = "^(Z|Y|/[A-Z0-9_]+/)[A-Z0-9_]*$"
IN_NAMESPACE = "^/[A-Z0-9_]+/(.+)$"
MOST_PROGRAM_CHARS = 40


def inner(text: Column) -> Column:
    """What a literal token holds, in upper case and without blanks around."""
    return F.upper(F.trim(F.substring(text, F.lit(2), F.length(text) - 2)))


def branch_names(t: Column) -> Column:
    """The names that a WHEN line dispatches on; none of WHEN OTHERS."""
    found = F.filter(F.transform(F.filter(t, literal), inner), lambda x: x != "")
    return F.when(F.coalesce(F.get(t, F.lit(1)) == "OTHERS", F.lit(False)), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def branches(lines: DataFrame, nested: bool = True) -> DataFrame:
    """(codeid, name, line_no, line): the lines of each name's own branch, from its WHEN to the next WHEN or the ENDCASE of the same block, or to
    the end of the code where that is missing. WHEN 'A' OR 'B' gives both names its lines; comments belong to none.

    nested: a branch holds the whole blocks within it, and the branches of those hold their part again. Otherwise any WHEN or ENDCASE ends a
    branch, however deep, so one that contains a block ends where that begins to branch.
    """
    first = F.coalesce(F.get("t", F.lit(0)), F.lit(""))
    code = tokenised(lines.withColumn("raw", F.col("line"))).withColumn("first", first)
    step = (F.col("first") == "CASE").cast("int") - (F.col("first") == "ENDCASE").cast("int")
    code = code.withColumn("total", F.sum(step).over(upto()))
    code = code.withColumn("depth", F.col("total") - F.least(F.lit(0), F.min("total").over(upto())))
    code = code.withColumn("before", F.coalesce(F.lag("depth").over(Window.partitionBy("codeid").orderBy("line_no")), F.lit(0)))
    one, depth, was = F.lit(1), F.col("depth").cast("int"), F.col("before").cast("int")
    marks = F.col("first").isin("WHEN", "CASE", "ENDCASE") if nested else F.col("first").isin("WHEN", "ENDCASE")
    level = F.when(F.col("first") == "ENDCASE", F.greatest(was, one)).otherwise(F.greatest(depth, one)) if nested else one
    inside = F.when(marks, level - 1).otherwise(F.greatest(depth, one)) if nested else F.when(marks, 0).otherwise(1)
    code = code.select("codeid", "line_no", "raw", marks.alias("marks"), level.alias("level"), inside.alias("inside"), F.when(F.col("first") == "WHEN", branch_names(F.col("t"))).otherwise(F.array().cast("array<string>")).alias("names"))
    opened = code.where("marks").select("codeid", "level", "line_no", F.lit(None).cast("string").alias("raw"), F.col("names"))
    held = code.where("inside > 0").select("codeid", F.explode(F.sequence(F.lit(1), "inside")).alias("level"), "line_no", "raw", F.lit(None).cast("array<string>").alias("names"))
    order = Window.partitionBy("codeid", "level").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = opened.unionByName(held).withColumn("of", F.last("names", ignorenulls=True).over(order))
    return last.where("raw IS NOT NULL").select("codeid", F.explode("of").alias("name"), "line_no", F.col("raw").alias("line"))


def handled(lines: DataFrame) -> DataFrame:
    """(codeid, name, place): the DataSources that code names, in a WHEN or in a comparison with I_DATASOURCE, in the order of their first appearance."""
    t = F.col("t")
    compared = F.transform(named(t, 2, word("I_DATASOURCE"), word("="), literal), inner)
    listed = F.concat(F.when(F.coalesce(F.get(t, F.lit(0)) == "WHEN", F.lit(False)), branch_names(t)).otherwise(F.array().cast("array<string>")), F.filter(compared, lambda x: x != ""))
    found = tokenised(lines).select("codeid", "line_no", F.posexplode(listed).alias("at", "name")).groupBy("codeid", "name").agg(F.min(F.struct("line_no", "at")).alias("first"))
    return found.select("codeid", "name", F.row_number().over(Window.partitionBy("codeid").orderBy("first")).alias("place"))


def dispatches(lines: DataFrame) -> DataFrame:
    """(codeid, dynamic, prefixes): whether code performs a form of a program named at run time, and the beginnings of names that it pastes
    I_DATASOURCE onto, sorted; only such that may begin a customer's name."""
    t = F.col("t")
    program = [word("IN"), word("PROGRAM"), word("(")]
    far = F.concat(places(t, *program, name, word(")")), places(t, *program, name, word("-"), name, word(")")))
    calling = F.exists(far, lambda i: F.exists(places(t, word("PERFORM")), lambda p: (p < i) & ~F.array_contains(F.slice(t, p + 1, i - p), ".")))
    pasted = has(t, word("I_DATASOURCE")) & (F.coalesce(F.get(t, F.lit(0)) == "CONCATENATE", F.lit(False)) | has(t, word("&"), word("&")) | has(t, word("|")))
    pieces = F.concat(F.transform(F.filter(t, literal), inner), named(t, 1, word("|"), name, word("{")))
    prefixes = F.when(pasted, F.filter(pieces, lambda x: x.rlike(PREFIX))).otherwise(F.array().cast("array<string>"))
    per = tokenised(lines).select("codeid", calling.alias("dynamic"), prefixes.alias("p")).groupBy("codeid").agg(F.bool_or("dynamic").alias("dynamic"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("p")))).alias("prefixes"))
    return lines.select("codeid").distinct().join(per, "codeid", "left").select("codeid", F.coalesce("dynamic", F.lit(False)).alias("dynamic"), F.coalesce("prefixes", F.array().cast("array<string>")).alias("prefixes"))


def satellites(dispatch: DataFrame, datasources: DataFrame, programs: DataFrame) -> DataFrame:
    """(codeid, datasource, prefix, program, status) of every prefix of dispatches() with every DataSource (codeid, datasource) of the same code:
    the program <prefix><DataSource>, the latter without its namespace. status is `available` or `absent` by the programs (program) that
    there are, or `no_name` where no program can have that name: it would hold a slash or blank, or be longer than 40 characters."""
    wanted = datasources.select("codeid", F.upper(F.trim("datasource")).alias("datasource")).where("datasource <> ''").distinct()
    pairs = dispatch.select("codeid", F.explode("prefixes").alias("prefix")).join(wanted, "codeid")
    space = F.regexp_extract("datasource", IN_NAMESPACE, 1)
    body = F.when(space != "", space).otherwise(F.col("datasource"))
    named_so = F.concat("prefix", body)
    possible = ~body.contains("/") & ~named_so.contains(" ") & (F.length(named_so) <= MOST_PROGRAM_CHARS)
    known = programs.select(F.upper("program").alias("known")).distinct()
    out = pairs.withColumn("program", F.when(possible, named_so)).join(known, F.col("program") == F.col("known"), "left")
    return out.select("codeid", "datasource", "prefix", "program", F.when(F.col("program").isNull(), "no_name").when(F.col("known").isNull(), "absent").otherwise("available").alias("status"))


def exit_only(handled_sources: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, exits): DataSources that exits handle (codeid, name) and that are not among the declared ones (name)."""
    known = declared.select(F.upper("name").alias("name")).distinct()
    return handled_sources.join(known, "name", "left_anti").groupBy("name").agg(F.countDistinct("codeid").alias("exits"))
