"""Load chains as time series: cadence, durations, failures, overlaps and contention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import decode
from cairn.operators import graph
from cairn.plans.cut import cut

MICROS = 1_000_000
HOUR = 3600 * MICROS


def run_days(runs: DataFrame) -> DataFrame:
    """Per chain: runs, run_days, first and last day of runs (chain_id, log_id, run_day)."""
    return runs.groupBy("chain_id").agg(F.countDistinct("log_id").alias("runs"), F.countDistinct("run_day").alias("run_days"), F.min("run_day").alias("first_day"), F.max("run_day").alias("last_day"))


def median_gaps(runs: DataFrame) -> DataFrame:
    """Per chain: the median number of days between its run days."""
    days = runs.select("chain_id", "run_day").distinct()
    before = F.lag("run_day").over(Window.partitionBy("chain_id").orderBy("run_day"))
    gaps = days.withColumn("gap", F.datediff("run_day", before))
    return gaps.groupBy("chain_id").agg(F.median("gap").alias("median_gap"))


def cadences(runs: DataFrame) -> DataFrame:
    """Per chain: its cadence, how sure it is, and whether it is live as of the latest run of all."""
    today = runs.agg(F.max("run_day").alias("today"))
    out = run_days(runs).join(median_gaps(runs), "chain_id", "left").crossJoin(F.broadcast(today))
    out = out.withColumn("cadence", decode.cadence(F.col("run_days"), F.col("runs"), F.col("median_gap"))).withColumn("idle_days", F.datediff("today", "last_day"))
    sure = F.when(F.col("runs") >= 3, "high").otherwise("low")
    return out.select("chain_id", "runs", "run_days", "median_gap", "cadence", sure.alias("confidence"), "idle_days", decode.is_live(F.col("cadence"), F.col("idle_days")).alias("live"))


def frequencies(runs: DataFrame) -> DataFrame:
    """Per chain: runs a day between its first and last day, and the class of that."""
    spread = F.datediff("last_day", "first_day") + 1
    return run_days(runs).withColumn("runs_per_day", F.col("runs") / spread).select("chain_id", "runs", "runs_per_day", decode.frequency(F.col("runs_per_day"), F.col("runs")).alias("frequency"))


def run_windows(steps: DataFrame) -> DataFrame:
    """Per chain and log: from the first step's start to the last one's end; steps without both times don't count."""
    return steps.where("start_us IS NOT NULL AND end_us IS NOT NULL").groupBy("chain_id", "log_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def durations(steps: DataFrame) -> DataFrame:
    """Per chain: number of runs and min, median, mean, 95th percentile and max of their seconds."""
    d = (F.col("end_us") - F.col("start_us")) / MICROS
    runs = run_windows(steps).select("chain_id", d.alias("d"))
    return runs.groupBy("chain_id").agg(F.count("*").alias("runs"), F.min("d").alias("min_s"), F.median("d").alias("median_s"), F.avg("d").alias("mean_s"), F.percentile("d", 0.95).alias("p95_s"), F.max("d").alias("max_s"))


def failed_steps(steps: DataFrame) -> DataFrame:
    """Per kind of failed step: occurrences, longest and shortest seconds, and of the log that sorts first its state; most frequent first."""
    failed = steps.where(decode.state_class(F.col("state")) == "failed").withColumn("d", (F.col("end_us") - F.col("start_us")) / MICROS)
    first = F.struct("log_id", "start_us", "state")
    return failed.groupBy("step_type", "variant").agg(F.count("*").alias("occurrences"), F.max("d").alias("longest_s"), F.min("d").alias("shortest_s"), F.min("log_id").alias("sample_log"), F.min(first)["state"].alias("first_state"))


def top_failed_steps(steps: DataFrame, limit: int = 5) -> DataFrame:
    """The kinds of failed step with the most occurrences, then the longest."""
    return failed_steps(steps).orderBy(F.desc("occurrences"), F.desc_nulls_last("longest_s"), "step_type", "variant").limit(limit)


def longest_steps(steps: DataFrame, limit: int = 5) -> DataFrame:
    """Per chain, the `limit` longest ended steps."""
    d = ((F.col("end_us") - F.col("start_us")) / MICROS).alias("seconds")
    ended = steps.where("start_us IS NOT NULL AND end_us IS NOT NULL").select("chain_id", "log_id", "step_type", "variant", "start_us", d)
    first = Window.partitionBy("chain_id").orderBy(F.desc("seconds"), "start_us", "step_type", "variant")
    return ended.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)


def recent_runs(runs: DataFrame, days: int) -> DataFrame:
    """Per chain: runs, first and last day within the last `days` days before the latest run of all."""
    today = runs.agg(F.max("run_day").alias("today"))
    recent = runs.crossJoin(F.broadcast(today)).where(F.datediff("today", "run_day") < days)
    return recent.groupBy("chain_id").agg(F.count("*").alias("runs"), F.min("run_day").alias("first_day"), F.max("run_day").alias("last_day"))


def newest_run_steps(windows: DataFrame, steps: DataFrame, newest: int = 1000) -> DataFrame:
    """Per chain: its `newest` newest runs and the steps they hold."""
    order = Window.partitionBy("chain_id").orderBy(F.desc("start_us"), "log_id")
    kept = windows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= newest).select("chain_id", "log_id")
    return kept.join(steps, ["chain_id", "log_id"]).groupBy("chain_id").agg(F.countDistinct("log_id").alias("runs"), F.count("*").alias("steps"))


def chain_list(chains: DataFrame, runs: DataFrame) -> DataFrame:
    """Every chain (chain_id, text) with its cadence; without runs it is unknown."""
    return chains.join(cadences(runs).select("chain_id", "cadence", "runs"), "chain_id", "left").select("chain_id", "text", F.coalesce("cadence", F.lit("unknown")).alias("cadence"), F.coalesce("runs", F.lit(0)).alias("runs"))


def success_rates(runs: DataFrame) -> DataFrame:
    return runs.groupBy("chain_id").agg(F.count("*").alias("runs"), F.avg((F.col("status") == "G").cast("double")).alias("success_rate"))


def median_starts(runs: DataFrame) -> DataFrame:
    """Per chain: the median minute of day at which it starts, seconds dropped, and the same as a clock."""
    minute = F.floor(F.pmod(F.col("start_us"), F.lit(24 * HOUR)) / (60 * MICROS))
    out = runs.groupBy("chain_id").agg(F.floor(F.median(minute)).cast("int").alias("start_minute"))
    return out.select("chain_id", "start_minute", decode.clock(F.col("start_minute")).alias("start_clock"))


def self_overlaps(windows: DataFrame) -> DataFrame:
    """Runs that start before an earlier run of the same chain has ended."""
    before = Window.partitionBy("chain_id").orderBy("start_us", "log_id").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("busy_until", F.max("end_us").over(before)).where("start_us < busy_until").select("chain_id", "log_id", "start_us", "busy_until")


def counts_before(times: DataFrame, keys: list[str], units: list[int]) -> DataFrame:
    """times (keys, at, n; one row per keys and at) with `before`: the sum of n over the keys' earlier rows.

    Sums run within blocks of the first unit of time, the blocks' totals within blocks of the next one, and so on; so no task holds more than
    a block's rows, or one row per block of the last unit.
    """
    earlier = lambda *more: Window.partitionBy(*keys, *more, *([] if keys or more else [F.lit(0)])).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    if not units:
        return times.withColumn("before", F.coalesce(F.sum("n").over(earlier()), F.lit(0)))
    unit, *rest = units
    parts = times.withColumn("block", F.floor(F.col("at") / unit))
    totals = parts.groupBy(*keys, F.col("block").alias("at")).agg(F.sum("n").alias("n"))
    above = counts_before(totals, keys, [u // unit for u in rest]).select(*keys, F.col("at").alias("block"), F.col("before").alias("above"))
    within = parts.withColumn("within", F.coalesce(F.sum("n").over(earlier("block")), F.lit(0)))
    return within.join(above, [*keys, "block"]).select(*keys, "at", "n", (F.col("within") + F.col("above")).alias("before"))


def disturbances(windows: DataFrame) -> DataFrame:
    """Per chain: how many starts of other chains fall into its runs, and how many of its runs see any; chains that see none are left out.

    A sweep: the starts before a run's end less those before its start, its own chain's taken off. It sorts, and never pairs runs with starts.
    """
    windows = windows.where("chain_id IS NOT NULL")
    runs = windows.where("start_us < end_us").select("chain_id", "log_id", "start_us", "end_us")
    ends = runs.select("chain_id", F.explode(F.array("start_us", "end_us")).alias("at"), F.lit(0).alias("n"))
    own = ends.union(windows.select("chain_id", "start_us", F.lit(1))).groupBy("chain_id", "at").agg(F.sum("n").alias("n"))
    every = counts_before(own.groupBy("at").agg(F.sum("n").alias("n")), [], [MICROS, HOUR, 24 * HOUR]).select("at", F.col("before").alias("all_before"))
    others = counts_before(own, ["chain_id"], [24 * HOUR]).join(every, "at").select("chain_id", "at", (F.col("all_before") - F.col("before")).alias("others"))
    upto = lambda end: others.select("chain_id", F.col("at").alias(end), F.col("others").alias(f"{end}_others"))
    inside = runs.join(upto("start_us"), ["chain_id", "start_us"]).join(upto("end_us"), ["chain_id", "end_us"]).withColumn("n", F.col("end_us_others") - F.col("start_us_others"))
    return inside.where("n > 0").groupBy("chain_id").agg(F.sum("n").alias("starts_inside"), F.count("*").alias("runs_disturbed"))


#: Of a tile: chains whose starts it holds, one bit each; starts that it holds, and slices into which it cuts their time.
OTHERS, STARTS, SLICES = 1 << 16, 1 << 22, 1 << 10


def met_in_tile(key: tuple, runs: pa.Table, starts: pa.Table) -> pa.Table:
    """(chain_id, met) of a tile's runs (chain_id, start_us, end_us) and starts (other, at): how many others start within a chain's runs.

    The starts in order of time are cut into slices, each of which is a row of bits, one for each other chain; so are 2, 4, 8 and more slices in
    a row. A run takes the two rows that cover its whole slices, and the starts before and after these one by one.
    """
    at = np.asarray(starts.column("at"))
    order = np.argsort(at, kind="stable")
    at, names = at[order], starts.column("other").combine_chunks().dictionary_encode()
    other = np.asarray(names.indices)[order]
    size, wide = -(-len(at) // SLICES) or 1, -(-len(names.dictionary) // 64) * 64
    bits = np.zeros((len(at) // size, wide // 8), np.uint8)
    for k, row in enumerate(bits):
        hit = np.zeros(wide, bool)
        hit[other[k * size : (k + 1) * size]] = True
        row[:] = np.packbits(hit)
    rows = [bits.view(np.uint64)]
    while 2 << len(rows) - 1 <= len(bits):
        rows.append(rows[-1][: -(1 << len(rows) - 1)] | rows[-1][1 << len(rows) - 1 :])
    chains = runs.column("chain_id").combine_chunks().dictionary_encode()
    first = np.searchsorted(at, np.asarray(runs.column("start_us")))
    last = np.searchsorted(at, np.asarray(runs.column("end_us")))
    whole, end = -(-first // size), last // size
    by_chain = np.argsort(np.asarray(chains.indices), kind="stable")
    upto = np.cumsum(np.bincount(np.asarray(chains.indices), minlength=len(chains.dictionary)))
    met = []
    for mine in np.split(by_chain, upto)[:-1]:
        hit, covered = np.zeros(wide, bool), np.zeros(wide // 64, np.uint64)
        for f, w, e, l in zip(first[mine].tolist(), whole[mine].tolist(), end[mine].tolist(), last[mine].tolist()):
            if w < e:
                level = (e - w).bit_length() - 1
                covered |= rows[level][w]
                covered |= rows[level][e - (1 << level)]
                hit[other[f : w * size]] = True
                hit[other[e * size : l]] = True
            else:
                hit[other[f:l]] = True
        met.append(int(np.bitwise_count(np.packbits(hit).view(np.uint64) | covered).sum()))
    return pa.table({"chain_id": chains.dictionary, "met": pa.array(met, pa.int64())})


def chains_met(windows: DataFrame, others: int = OTHERS) -> DataFrame:
    """Per chain with runs: how many other chains start within them. Nearly all chains may meet nearly all, so pairs are counted as bits in tiles of
    two groups of chains, never listed: the work grows with the square of the chains, what is held and sent doesn't."""
    windows = windows.where("chain_id IS NOT NULL")
    chains, starts = windows.agg(F.approx_count_distinct("chain_id"), F.count("*")).first()
    g, h = max(-(-2 * chains // others), min(16, -(-16 * chains // others)), 1), max(-(-chains // others), -(-starts // STARTS), 1)
    group = lambda n: F.pmod(F.xxhash64("chain_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = windows.where("start_us < end_us").select("chain_id", "start_us", "end_us", group(g).alias("g"), every(h).alias("h"))
    right = windows.select(F.col("chain_id").alias("other"), F.col("start_us").alias("at"), every(g).alias("g"), group(h).alias("h"))
    kind = windows.schema["chain_id"].dataType.simpleString()
    tiles = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(met_in_tile, f"chain_id {kind}, met long")
    # A chain's own starts are within its own runs.
    return tiles.groupBy("chain_id").agg((F.sum("met") - 1).alias("other_chains"))


def contention(windows: DataFrame) -> DataFrame:
    """Per chain: how many starts of other chains fall into its runs, how many of its runs see any, and how many other chains these are."""
    windows = cut(windows.select("chain_id", "log_id", "start_us", "end_us"))
    return disturbances(windows).join(chains_met(windows), "chain_id").select("chain_id", "starts_inside", "runs_disturbed", "other_chains")


def schedule_matrix(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per chain: cadence, median start and the minute of day by which 95 % of its runs are done."""
    p95 = durations(steps).select("chain_id", "p95_s")
    out = cadences(runs).select("chain_id", "cadence", "live").join(median_starts(runs), "chain_id").join(p95, "chain_id", "left")
    return out.withColumn("done_minute", F.col("start_minute") + F.col("p95_s") / 60)


def step_categories(steps: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Per chain and category of step: how many."""
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return steps.groupBy("chain_id", F.coalesce(known[F.col("step_type")], F.lit("other")).alias("category")).agg(F.count("*").alias("steps"))


def report_margins(reports: DataFrame, matrix: DataFrame) -> DataFrame:
    """Reports (report, chain_id, start_min) against the time by which their chain is done; those without such a time aren't judged."""
    done = matrix.where("done_minute IS NOT NULL").select("chain_id", "done_minute")
    out = reports.join(done, "chain_id").withColumn("margin", F.col("start_min") - F.col("done_minute"))
    return out.select("report", "chain_id", "margin", decode.margin_severity(F.col("margin")).alias("severity"))


def unjudged_reports(reports: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: how many reports there are, and of how many no chain tells when it is done."""
    done = matrix.where("done_minute IS NOT NULL").select("chain_id", F.lit(True).alias("known"))
    return reports.join(done, "chain_id", "left").agg(F.count("*").alias("reports"), F.count_if(F.col("known").isNull()).alias("unmatched"))


def load_closure(loads: DataFrame, calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Per provider: the chains that load it, directly or through chains that call them, and the one among them that runs most often a day.

    loads: (chain_id, provider); calls: (src, dst), chain src calls dst; runs: the run log.
    """
    above = graph.reachability(graph.turned(calls)).select(F.col("root").alias("chain_id"), F.col("node").alias("above"))
    chains = loads.select("chain_id", "provider").union(loads.join(above, "chain_id").select("above", "provider")).distinct()
    rate = frequencies(runs).select(F.col("chain_id").alias("counted"), "runs_per_day", "runs")
    order = F.struct(F.coalesce("runs_per_day", F.lit(0.0)), F.coalesce("runs", F.lit(0)), "chain_id")
    return chains.join(rate, F.col("chain_id").cast("string") == F.col("counted"), "left").groupBy("provider").agg(F.countDistinct("chain_id").alias("chains"), F.max_by("chain_id", order).alias("governing_chain"))


#: Kinds of steps that run a load process.
LOAD_STEPS = ["DTP_LOAD", "LOADING"]


def step_targets(steps: DataFrame, loads: DataFrame) -> DataFrame:
    """(chain_id, target, dtp, updmode, steps, unresolved) of each chain: what its load steps (chain_id, step_no, step_type, variant) load, by the
    load processes (dtp, tgt, updmode) that they run. A target counts once, by its first step; a step whose process isn't there (deleted, or
    not active) has no target, and unresolved tells how many of a chain there are."""
    own = steps.where(F.col("step_type").isin(LOAD_STEPS) & F.col("variant").isNotNull()).select("chain_id", "step_no", F.col("variant").cast("string").alias("dtp"))
    known = loads.groupBy(F.col("dtp").cast("string").alias("dtp")).agg(F.min(F.struct("tgt", "updmode")).alias("load"))
    found = own.join(known, "dtp", "left").withColumn("target", F.col("load.tgt"))
    missing = found.groupBy("chain_id").agg(F.count_if(F.col("target").isNull()).alias("unresolved"))
    first = F.min(F.struct("step_no", "dtp", F.col("load.updmode").alias("updmode")))
    per = found.where("target IS NOT NULL").groupBy("chain_id", "target").agg(first.alias("f"), F.count("*").alias("steps"))
    return per.join(missing, "chain_id").select("chain_id", "target", "f.dtp", "f.updmode", "steps", "unresolved")
