"""The run log as a stream: the same questions, kept current while rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_counts(log: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Runs and failed runs per chain and window of a log (chain_id, started, status); rows later than `late` are dropped."""
    failed = F.sum((F.col("status") == "R").cast("long"))
    return log.withWatermark("started", late).groupBy(F.window("started", window).alias("w"), "chain_id").agg(F.count("*").alias("runs"), failed.alias("failed")).select("chain_id", F.col("w.start").alias("window_start"), "runs", "failed")


def busy_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Stretches in which a chain's starts follow each other within `gap`, with their number of starts."""
    return log.withWatermark("started", late).groupBy(F.session_window("started", gap).alias("w"), "chain_id").agg(F.count("*").alias("starts")).select("chain_id", F.col("w.start").alias("first_start"), F.col("w.end").alias("session_end"), "starts")
