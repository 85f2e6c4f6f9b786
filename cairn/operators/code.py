"""Transformation code, one row per line (codeid, line_no, line).

Windows run over one routine's lines in order and keep a running count; only single statements and single forms are put together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A line's tokens: literals in single quotes, names, the two arrows before a method, and any other character by itself. Java and RE2 read it alike.
TOKEN = r"'[^']*'|[A-Za-z0-9_/<>]+|=>|->|[^\sA-Za-z0-9_/<>]"
#: Tables that the framework fills before it calls a routine, so reading for all their entries needs no guard.
FILLED = ["C_T_DATA", "I_T_DATA", "I_DATA", "SOURCE_PACKAGE", "RESULT_PACKAGE", "<SOURCE_FIELDS>", "<RESULT_FIELDS>"]
#: Namespaces of generated tables.
GENERATED = ["/BIC/", "/BI0/"]

Rule = Callable[[Column], Column]


def word(*words: str) -> Rule:
    """A token that is one of the words."""

    def rule(t: Column) -> Column:
        return t.isin(*words)

    rule.words = words
    return rule


def name(t: Column) -> Column:
    """A token that names something, a field symbol in angle brackets too."""
    return t.rlike("^[A-Z0-9_/<>]+$")


def plain_name(t: Column) -> Column:
    return t.rlike("^[A-Z0-9_/]+$")


def literal(t: Column) -> Column:
    return t.rlike("^'.*'$") & (F.length(t) > 1)


def generated_table(t: Column) -> Column:
    return (t.startswith(GENERATED[0]) | t.startswith(GENERATED[1])) & (F.length(t) > len(GENERATED[0]))


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def places(t: Column, *rules: Rule) -> Column:
    """The places (from 0) of the array t from which on its tokens obey the rules, one after another. Only arrays that hold a word of every
    rule that names words are looked through."""

    def obeys(i: Column) -> Column:
        out = F.lit(True)
        for k, rule in enumerate(rules):
            out = out & F.coalesce(rule(F.get(t, i + k)), F.lit(False))
        return out

    found = F.filter(F.sequence(F.lit(0), F.size(t) - 1), obeys)
    keywords = [F.arrays_overlap(t, F.array(*[F.lit(w) for w in rule.words])) for rule in rules if hasattr(rule, "words")]
    return F.when(reduce(Column.__and__, keywords), found).otherwise(F.array().cast("array<int>")) if keywords else found


def has(t: Column, *rules: Rule) -> Column:
    return F.size(places(t, *rules)) > 0


def named(t: Column, at: int, *rules: Rule) -> Column:
    """The tokens that stand `at` places behind each place which obeys the rules."""
    return F.transform(places(t, *rules), lambda i: F.get(t, i + at))


def opens(t: Column) -> Column:
    return has(t, word("LOOP"), word("AT")) | has(t, word("DO", "WHILE"))


def closes(t: Column) -> Column:
    return has(t, word("ENDLOOP", "ENDDO", "ENDWHILE"))


def selects(t: Column) -> Column:
    return has(t, word("SELECT"))


def reads(t: Column) -> Column:
    """What follows FROM or JOIN."""
    return named(t, 1, word("FROM", "JOIN"), plain_name)


def writes(t: Column) -> Column:
    """Whether a generated table is changed."""
    verb = word("INSERT", "UPDATE", "MODIFY", "DELETE")
    return has(t, verb, generated_table) | has(t, verb, word("FROM"), generated_table)


def deletes(t: Column) -> Column:
    """Whether rows of an internal table are deleted."""
    return has(t, word("DELETE"), word("ADJACENT"), word("DUPLICATES")) | has(t, word("DELETE"), name, word("WHERE", "INDEX", "FROM"))


def fixed_value(t: Column) -> Column:
    """Whether a condition holds a literal or compares with a number."""
    return has(t, word("WHERE")) & (has(t, literal) | has(t, word("="), lambda x: x.rlike("^[0-9]")))


def driver(t: Column) -> Column:
    """The table for all whose entries a line reads."""
    for_all = [word("FOR"), word("ALL"), word("ENTRIES"), word("IN")]
    found = F.concat(named(t, 4, *for_all, name), named(t, 5, *for_all, word("@", "("), name), named(t, 6, *for_all, word("@"), word("("), name))
    return F.get(found, F.lit(0))


def guarded(t: Column) -> Column:
    """The tables that a line tests for being empty, or whose lines it counts."""
    tests = [named(t, 0, name, *brackets, word("IS"), *negation, word("INITIAL")) for brackets in ([], [word("["), word("]")]) for negation in ([], [word("NOT")])]
    return F.concat(*tests, named(t, 2, word("LINES"), word("("), name), named(t, 2, word("DESCRIBE"), word("TABLE"), name))


def stripped(lines: DataFrame) -> DataFrame:
    """Lines without comments, in upper case: whole lines that begin with '*', and what follows a double quote."""
    return lines.where(~F.ltrim("line").startswith("*")).withColumn("line", F.upper(F.substring_index("line", '"', 1)))


def tokenised(lines: DataFrame) -> DataFrame:
    """Lines without comments, with their tokens t in upper case. A keyword within a literal is no keyword."""
    return stripped(lines).withColumn("t", tokens("line"))


def upto(first: int = 0) -> Column:
    return Window.partitionBy("codeid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, first)


def loop_depths(lines: DataFrame) -> DataFrame:
    """Lines with the loop depth after them; a close without an open stays at depth 0."""
    t = F.col("t")
    marked = tokenised(lines).withColumn("opens", opens(t)).withColumn("closes", closes(t))
    total = marked.withColumn("total", F.sum(F.col("opens").cast("int") - F.col("closes").cast("int")).over(upto()))
    depth = F.col("total") - F.least(F.lit(0), F.min("total").over(upto()))
    return total.withColumn("depth", depth).select("codeid", "line_no", "line", "depth", "t", "opens", "closes")


def statements(lines: DataFrame) -> DataFrame:
    """(codeid, statement, first_line, text): code without comments, cut at every full stop; numbered within a routine."""
    parts = stripped(lines).withColumn("parts", F.split("line", r"\."))
    before = F.coalesce(F.sum(F.size("parts") - 1).over(upto(-1)), F.lit(0))
    pieces = parts.withColumn("before", before).select("codeid", "line_no", "before", F.posexplode("parts").alias("at", "piece"))
    pieces = pieces.withColumn("statement", F.col("before") + F.col("at")).where("piece <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "at", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("codeid", "statement").agg(F.min("line_no").alias("first_line"), F.array_join(ordered, " ").alias("text"))


def table_reads(lines: DataFrame) -> DataFrame:
    """(codeid, table_name, first_line): tables that statements with a SELECT read, wherever the statement breaks its lines."""
    split = statements(lines).withColumn("t", tokens("text"))
    found = split.where(selects(F.col("t"))).select("codeid", "first_line", F.explode(reads(F.col("t"))).alias("table_name")).where("table_name <> 'TABLE'")
    return found.groupBy("codeid", "table_name").agg(F.min("first_line").alias("first_line"))


def unguarded(lines: DataFrame) -> DataFrame:
    """(codeid, line_no): reads FOR ALL ENTRIES of a table that the routine never tests for being empty."""
    code = tokenised(lines)
    guards = code.select("codeid", F.explode(guarded(F.col("t"))).alias("guarded")).distinct()
    found = code.select("codeid", "line_no", driver(F.col("t")).alias("guarded")).where(F.col("guarded").isNotNull() & ~F.col("guarded").isin(FILLED))
    return found.join(guards, ["codeid", "guarded"], "left_anti").select("codeid", "line_no")


def patterns(lines: DataFrame) -> DataFrame:
    """(codeid, pattern, occurrences): selects inside loops, loops within loops, fixed values in conditions, changes to generated tables,
    deletions from internal tables, and reads for all entries of a table never tested for being empty."""
    deep, t = loop_depths(lines), F.col("t")
    opened = F.col("depth") + F.col("closes").cast("int")
    hits = F.array(
        F.when(F.col("opens") & (opened >= 2), "nested_loop"), F.when(selects(t) & (F.col("depth") > 0), "select_in_loop"), F.when(writes(t), "database_modification").when(deletes(t), "recordset_delete"), F.when(fixed_value(t), "hardcoded_value"),
    )
    found = deep.select("codeid", F.explode(F.array_compact(hits)).alias("pattern"))
    found = found.unionByName(unguarded(lines).select("codeid", F.lit("missing_for_all_entries").alias("pattern")))
    return found.groupBy("codeid", "pattern").agg(F.count("*").alias("occurrences"))


def calls(lines: DataFrame) -> DataFrame:
    """(codeid, call_kind, name, calls): function modules, functions by a variable's name, methods and forms that code calls; of each kind the
    first of a line."""
    t, code = F.col("t"), tokenised(lines)
    called = lambda kind, of: F.when(of.isNotNull(), F.struct(F.lit(kind).alias("call_kind"), of.alias("name")))
    first = lambda found: F.get(found, F.lit(0))
    fixed = first(named(t, 2, word("CALL"), word("FUNCTION"), literal))
    variable = first(named(t, 2, word("CALL"), word("FUNCTION"), name))
    function = F.coalesce(called("function_module", F.substring(fixed, F.lit(2), F.length(fixed) - 2)), called("dynamic", F.when(variable.isNotNull(), "(dynamic)")))
    method = first(F.transform(places(t, plain_name, word("=>", "->"), plain_name, word("(")), lambda i: F.concat(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2))))
    found = F.explode(F.array_compact(F.array(function, called("class_method", method), called("form", first(named(t, 1, word("PERFORM"), name)))))).alias("c")
    return code.select("codeid", found).groupBy("codeid", "c.call_kind", "c.name").agg(F.count("*").alias("calls"))


def analysis(lines: DataFrame) -> DataFrame:
    """Per routine: lines, loops, deepest nesting, selects, calls, tables read and patterns found."""
    deep = loop_depths(lines)
    sizes = lines.groupBy("codeid").agg(F.count("*").alias("lines"))
    opened = F.when(F.col("opens"), F.col("depth") + F.col("closes").cast("int"))
    shape = deep.groupBy("codeid").agg(F.count_if("opens").alias("loops"), F.max(opened).alias("nesting"), F.count_if(selects(F.col("t"))).alias("selects"))
    counted = [(calls(lines), F.sum("calls").alias("calls")), (table_reads(lines), F.count("*").alias("tables")), (patterns(lines), F.sum("occurrences").alias("patterns"))]
    out = sizes.join(shape, "codeid", "left")
    for df, total in counted:
        out = out.join(df.groupBy("codeid").agg(total), "codeid", "left")
    return out.select("codeid", "lines", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("loops", "nesting", "selects", "calls", "tables", "patterns")])


def register(lines: DataFrame, limit: int, budget: int = 100) -> DataFrame:
    """The `limit` routines (codeid, lines, patterns, analysed) with the most patterns, then lines, then the smallest id; only the `budget`
    largest routines are analysed, of the others patterns are not known."""
    sizes = lines.groupBy("codeid").agg(F.count("*").alias("lines"))
    largest = sizes.orderBy(F.desc("lines"), "codeid").limit(budget).select("codeid", F.lit(True).alias("analysed"))
    found = patterns(lines.join(largest.select("codeid"), "codeid", "left_semi")).groupBy("codeid").agg(F.sum("occurrences").alias("patterns"))
    out = sizes.join(largest, "codeid", "left").join(found, "codeid", "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))
    out = out.select("codeid", "lines", F.when(F.col("analysed"), F.coalesce("patterns", F.lit(0))).alias("patterns"), "analysed")
    return out.orderBy(F.desc_nulls_last("patterns"), F.desc("lines"), "codeid").limit(limit)


def portfolio(lines: DataFrame) -> DataFrame:
    """(measure, value): routines, lines, and occurrences of each pattern over all code."""
    sizes = lines.agg(F.countDistinct("codeid").alias("routines"), F.count("*").alias("lines"))
    totals = sizes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("routines", "lines")])).alias("m")).select("m.*")
    return totals.unionByName(patterns(lines).groupBy(F.col("pattern").alias("measure")).agg(F.sum("occurrences").alias("value")))


def form_lines(lines: DataFrame) -> DataFrame:
    """(codeid, form, line_no, line): the lines between FORM and ENDFORM, of a name's first body in a routine; one without end has none."""
    raw = lines.withColumn("t", tokens(F.upper("line"))).withColumn("ends", F.coalesce(F.get("t", F.lit(0)) == "ENDFORM", F.lit(False)))
    raw = raw.withColumn("part", F.coalesce(F.sum(F.col("ends").cast("int")).over(upto(-1)), F.lit(0)))
    form = F.when(F.array_contains(places(F.col("t"), word("FORM"), name), 0), F.struct("line_no", F.get("t", F.lit(1)).alias("form")))
    parts = raw.groupBy("codeid", "part").agg(F.min(form).alias("o"), F.bool_or("ends").alias("closed")).where("closed AND o IS NOT NULL").select("codeid", "part", "o.form", F.col("o.line_no").alias("opened"))
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("codeid", "form").orderBy("part"))).where("n = 1").drop("n")
    return raw.join(first, ["codeid", "part"]).where("line_no > opened AND NOT ends").select("codeid", "form", "line_no", "line")


def performed(lines: DataFrame) -> DataFrame:
    """(codeid, form, place): local forms that statements perform, in the order of their first appearance; those of other programs don't count."""
    split, t = statements(lines).withColumn("t", tokens("text")), F.col("t")
    found = split.where(~has(t, word("IN"), word("PROGRAM"))).select("codeid", "statement", F.posexplode(named(t, 1, word("PERFORM"), name)).alias("at", "form"))
    first = found.groupBy("codeid", "form").agg(F.min(F.struct("statement", "at")).alias("first"))
    return first.select("codeid", "form", F.row_number().over(Window.partitionBy("codeid").orderBy("first")).alias("place"))


def followed_forms(lines: DataFrame) -> DataFrame:
    """(codeid, form, defined, lines): every form a routine performs, whether it is defined there, and the lines of its body."""
    bodies = form_lines(lines).groupBy("codeid", "form").agg(F.count("*").alias("lines"))
    out = performed(lines).join(bodies, ["codeid", "form"], "left")
    return out.select("codeid", "form", F.col("lines").isNotNull().alias("defined"), F.coalesce("lines", F.lit(0)).alias("lines"))
