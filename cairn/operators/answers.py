"""Composed answers about every object and every query: sections with statuses, risks, and how far the answer can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators.evidence import confidence
from cairn.operators.query_definitions import meaning

#: What marks a caveat's reason, the first group that matches.
CAVEATS = [
    ("metadata_dead_end", ["customer-exit", "customer exit", "dead end", "resolve at runtime"]), ("heuristic_lower_bound", ["advisory", "heuristic", "lower bound", "lower-bound", "parsed from"]),
    ("truncated", ["truncated", "summarised", "row cap", "capped", "showing"]),
]


def caveat_reason(text: Column) -> Column:
    """Why a caveat limits an answer, by the words that it holds; reader_caveat where none is known."""
    out = F.lit("reader_caveat")
    for reason, markers in reversed(CAVEATS):
        out = F.when(reduce(Column.__or__, [F.lower(text).contains(m) for m in markers]), reason).otherwise(out)
    return out


def sections(subjects: DataFrame, parts: dict[str, DataFrame | None]) -> DataFrame:
    """(answer, section, status, count) of subjects (answer): complete where a part (answer, ...) has rows of it, empty where it has none,
    unsupported where the part itself is missing (None)."""
    out = []
    for name, part in parts.items():
        if part is None:
            out.append(subjects.select("answer", F.lit(name).alias("section"), F.lit("unsupported").alias("status"), F.lit(None).cast("long").alias("count")))
        else:
            counted = subjects.join(part.groupBy("answer").agg(F.count("*").alias("n")), "answer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            out.append(counted.select("answer", F.lit(name).alias("section"), F.when(F.col("n") > 0, "complete").otherwise("empty").alias("status"), F.col("n").alias("count")))
    return reduce(DataFrame.unionByName, out)


def risk(df: DataFrame, name: str, severity: Column | str, metric: Column | None = None) -> DataFrame:
    return df.select("answer", F.lit(name).alias("risk"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit("") if metric is None else metric.cast("string")).alias("metric"))


def object_risks(objects: DataFrame, loads: DataFrame, frozen: DataFrame, volumes: DataFrame, consumers: DataFrame) -> DataFrame:
    """(answer, risk, severity, metric) of objects (answer, active): not active high; loaded by no chain (answer, chain, cadence) medium, which an
    inactive loader (answer) qualifies; loaded on several cadences medium; more than three times as many changelog as active records
    (answer, active_records, changelog_records) medium; without a consumer (answer) low."""
    every = objects.select("answer").distinct()
    loaded = loads.select("answer").distinct()
    unloaded = every.join(loaded, "answer", "left_anti").join(frozen.select("answer", F.lit(True).alias("frozen")).distinct(), "answer", "left")
    cadences = loads.groupBy("answer").agg(F.sort_array(F.collect_set("cadence")).alias("c")).where(F.size("c") > 1)
    grown = volumes.where(F.col("changelog_records") > 3 * F.greatest("active_records", F.lit(1)))
    return reduce(DataFrame.unionByName, [
        risk(objects.where("NOT active"), "not_active", "high"), risk(unloaded, "no_loader", "medium", F.when(F.col("frozen"), "inactive_loader").otherwise("")),
        risk(cadences.join(every, "answer", "left_semi"), "mixed_cadences", "medium", F.array_join("c", ",")), risk(grown.join(every, "answer", "left_semi"), "changelog_outgrows_active", "medium"),
        risk(every.join(consumers.select("answer").distinct(), "answer", "left_anti"), "no_consumer", "low"),
    ])


def query_risks(queries: DataFrame, providers: DataFrame, relevant: DataFrame, idle: DataFrame, exits: DataFrame, conditions: DataFrame) -> DataFrame:
    """(answer, risk, severity, metric) of queries (answer): no provider (answer, provider) medium; not used for long (answer, idle_days) low;
    authorisation-relevant characteristics (answer, characteristic, covered) medium, as users see different rows, and uncovered ones high;
    variables that customer code fills (answer, variable) info; active conditions (answer, kind, active) medium, as they take rows
    away without a sign in the figures, active exceptions info, inactive ones of both info."""
    every = queries.select("answer").distinct()
    per = lambda df, item: df.join(every, "answer", "left_semi").groupBy("answer").agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("m"))
    count = lambda df: df.join(every, "answer", "left_semi").groupBy("answer").agg(F.count("*").alias("m"))
    m = F.col("m")
    return reduce(DataFrame.unionByName, [
        risk(every.join(providers.select("answer").distinct(), "answer", "left_anti"), "no_provider", "medium"), risk(idle.join(every, "answer", "left_semi"), "decommission_candidate", "low", F.col("idle_days")),
        risk(per(relevant, "characteristic"), "user_specific_result", "medium", m), risk(per(relevant.where("NOT covered"), "characteristic"), "uncovered_characteristics", "high", m), risk(per(exits, "variable"), "customer_exit_variables", "info", m),
        risk(count(conditions.where("active AND kind = 'condition'")), "active_conditions", "medium", m), risk(count(conditions.where("active AND kind = 'exception'")), "active_exceptions", "info", m),
        risk(count(conditions.where("NOT active")), "inactive_conditions", "info", m),
    ])


def answers(subjects: DataFrame, found: DataFrame, risks: DataFrame, relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, level, worst_section, sections, complete, risks, worst_risk, advisory): one row per subject (answer), of its sections, its risks, its
    relationships (answer, advisory) and its facts (answer, basis, method)."""
    sure = confidence(found, relationships, facts).select("answer", "level", F.col("worst").alias("worst_section"), "sections", "complete", "advisory")
    rank = decode.severity_rank(F.col("severity"))
    per = risks.groupBy("answer").agg(F.count("*").alias("risks"), F.min_by("severity", rank).alias("worst_risk"))
    out = subjects.select("answer").distinct().join(sure, "answer", "left").join(per, "answer", "left")
    return out.select("answer", "level", "worst_section", "sections", "complete", F.coalesce("risks", F.lit(0)).alias("risks"), "worst_risk", "advisory")


def scenario_statuses(scenarios: DataFrame, missing: DataFrame, candidates: DataFrame, connectors: DataFrame) -> DataFrame:
    """(scenario, status, candidates) of scenarios (scenario): unsupported where a table that it needs is missing (scenario), connector_required
    where it needs a system outside (scenario), nothing_to_assess where it ran over no candidates (scenario, candidates), else assessed."""
    flag = lambda df, name: df.select("scenario", F.lit(True).alias(name)).distinct()
    out = scenarios.join(flag(missing, "gone"), "scenario", "left").join(flag(connectors, "outside"), "scenario", "left").join(candidates.groupBy("scenario").agg(F.sum("candidates").alias("candidates")), "scenario", "left")
    n = F.coalesce("candidates", F.lit(0))
    return out.select("scenario", F.when(F.col("gone"), "unsupported").when(F.col("outside"), "connector_required").when(n == 0, "nothing_to_assess").otherwise("assessed").alias("status"), n.alias("candidates"))


#: Local aggregations of a structure's member, how totals are suppressed, how an element is shown; 00 and blank are none.
LOCAL = {
    "01": "Summation", "02": "Maximum", "03": "Minimum", "04": "Counting all values", "05": "Count all values <> 0", "06": "Average of all values", "07": "Average of all values <> 0", "08": "Standard deviation", "09": "Variance",
    "10": "Suppress result", "11": "First value", "12": "Last value", "13": "Summation of rounded values",
}
SUPPRESSED, HIDDEN, RUNTIME = ["U", "C"], ["X", "Y"], ["3", "6"]


def element_properties(rows: DataFrame) -> DataFrame:
    """(element, local_aggregation, total_suppressed, hidden, runtime, changes): what an element's settings (element, currency, currency_flag,
    translation, unit, unit_flag, aggregation, sign, cumulative, constant, key_date_flag, hierarchy_flag, totals, display) do to its value.

    changes names all that makes the shown figure another than the sum of what lies below it, in a fixed order; runtime tells that some of it is
    only known when the query runs. Merely cosmetic settings change nothing.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    is_set = lambda c: ~text(c).isin("", "0")
    at_run = lambda c: text(c).isin(RUNTIME)
    local = text("aggregation")
    aggregates = ~local.isin("", "00")
    changes = F.array_compact(F.array(
        F.when(is_set("currency_flag") | (text("currency") != "") | (text("translation") != ""), "currency_translation"), F.when(is_set("unit_flag") | (text("unit") != ""), "unit_conversion"), F.when(aggregates & (local != "01"), "local_aggregation"),
        F.when(text("sign") == "X", "sign_inverted"), F.when(text("cumulative") == "X", "cumulative"), F.when(text("constant") == "X", "constant_selection"), F.when(is_set("key_date_flag"), "own_key_date"), F.when(at_run("hierarchy_flag"), "hierarchy_by_variable"),
    ))
    runtime = reduce(Column.__or__, [at_run(c) for c in ("currency_flag", "unit_flag", "key_date_flag", "hierarchy_flag")])
    return rows.select(
        "element", F.when(aggregates, F.coalesce(meaning(local, LOCAL), local)).alias("local_aggregation"), text("totals").isin(SUPPRESSED).alias("total_suppressed"), text("display").isin(HIDDEN).alias("hidden"), runtime.alias("runtime"), F.array_join(changes, ",").alias("changes"))
