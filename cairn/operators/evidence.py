"""How firmly an answer is known: its sections' statuses, its facts' bases, and the confidence that follows from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases of facts, the strongest first.
BASES = ["observed", "derived", "inferred", "unknown"]
#: Statuses of sections, the worst first; what was read to its end and found empty is as good as complete.
STATUSES = ["failed", "unsupported", "skipped_budget", "empty", "complete", "not_applicable"]
GAPS = ["failed", "unsupported", "skipped_budget"]


def evidence_summary(facts: DataFrame) -> DataFrame:
    """(answer, observed, derived, inferred, unknown, advisory, methods) of facts (answer, basis, method): how many rest on each basis, and by
    which methods; a basis without a meaning is unknown. Inferred and unknown ones are advisory."""
    basis = F.when(F.col("basis").isin(BASES), F.col("basis")).otherwise("unknown")
    counts = [F.count_if(basis == b).alias(b) for b in BASES]
    per = facts.groupBy("answer").agg(*counts, F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    return per.select("answer", *BASES, (F.col("inferred") + F.col("unknown")).alias("advisory"), "methods")


def confidence(sections: DataFrame, relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """(answer, level, worst, sections, complete, unsupported, failed, skipped, advisory, observed, derived, inferred, unknown) of every answer with
    sections (answer, section, status).

    Coverage decides: no gap among the sections that apply is high, gaps in half of them or more low, others medium. Relationships (answer,
    advisory) that were derived rather than declared cap it at medium: the declared ones remain declared. worst is the worst status of all
    sections: one that failed tells less than one that is absent on the system.
    """
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status"))
    per = sections.groupBy("answer").agg(
        F.count_if(F.col("status") != "not_applicable").alias("sections"), n("complete", "empty").alias("complete"), n("unsupported").alias("unsupported"), n("failed").alias("failed"), n("skipped_budget").alias("skipped"), n(*GAPS).alias("gaps"), F.min_by("status", rank).alias("worst"))
    derived = relationships.groupBy("answer").agg(F.count_if("advisory").alias("advisory"))
    out = per.join(derived, "answer", "left").join(evidence_summary(facts).drop("advisory", "methods"), "answer", "left")
    out = out.withColumn("advisory", F.coalesce("advisory", F.lit(0)))
    level = F.when(F.col("gaps") == 0, F.when(F.col("advisory") > 0, "medium").otherwise("high")).when(F.col("gaps") * 2 >= F.greatest("sections", F.lit(1)), "low").otherwise("medium")
    return out.select("answer", level.alias("level"), "worst", "sections", "complete", "unsupported", "failed", "skipped", "advisory", *[F.coalesce(b, F.lit(0)).alias(b) for b in BASES])


def reasons(found: DataFrame) -> DataFrame:
    """(answer, reason, count): why confidence() is what it is; one row that says so where nothing limits it."""
    each = [("sections_unavailable_on_release", "unsupported"), ("sections_not_readable", "failed"), ("sections_not_read_for_budget", "skipped"), ("relationships_derived_not_declared", "advisory")]
    listed = F.array(*[F.struct(F.lit(reason).alias("reason"), F.col(c).cast("long").alias("count")) for reason, c in each])
    kept = F.filter(listed, lambda r: r["count"] > 0)
    nothing = F.array(F.struct(F.lit("everything_read_and_declared").alias("reason"), F.lit(0).cast("long").alias("count")))
    return found.select("answer", F.explode(F.when(F.size(kept) > 0, kept).otherwise(nothing)).alias("r")).select("answer", "r.*")
