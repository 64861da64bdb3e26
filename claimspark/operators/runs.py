"""Source runs: observations, baselines, reports, run state, failures and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.operators.asof import as_of
from claimspark.operators.reconcile import best_per_key


def is_future(date: Column, run_date: Column) -> Column:
    """No date counts as still to come."""
    return F.nullif(date, F.lit("")).isNull() | (date >= run_date)


def observations(events: DataFrame, runs: DataFrame) -> DataFrame:
    """One observation for each run (run_id, source_id, observed_at, body, complete, run_date): capture_hash, item_count, future_item_count.

    ``events`` (run_id, date); a run without events has counts of 0.
    """
    dates = runs.select("run_id", "run_date")
    counts = events.join(dates, "run_id").groupBy("run_id").agg(F.count("*").alias("_n"), F.count_if(is_future(F.col("date").cast("string"), F.col("run_date"))).alias("_future"))
    out = runs.join(counts, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("run_id", "source_id", "observed_at", "complete", F.sha2("body", 256).alias("capture_hash"), zero("_n").alias("item_count"), zero("_future").alias("future_item_count"))


def baselines(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (source_id, mode, semantics, complete, started_at) with baseline: the run it is compared with.

    A complete capture of a delta source of complete snapshots needs the last complete run before it; all others the last run.
    ``runs`` (source_id, run_id, started_at, complete) are successful ones.
    """
    found = as_of(asked, runs.select("source_id", "started_at", "run_id", F.col("complete").alias("whole")), "source_id", "started_at", {"_any": "true", "_complete": "whole"}, ["run_id"])
    needs = F.col("complete") & (F.col("mode") == "delta") & (F.col("semantics") == "complete")
    return found.withColumn("baseline", F.when(F.coalesce(needs, F.lit(False)), F.col("_complete.run_id")).otherwise(F.col("_any.run_id"))).drop("_any", "_complete")


def report(diff: DataFrame, claims: DataFrame, parked: DataFrame, items: DataFrame, by: str = "source_id") -> DataFrame:
    """One row for each source: raw_items, valid_events, parked, claims, added, updated, withdrawn, unchanged, projection_work_items.

    ``diff`` (source, action), ``claims``, ``parked`` and ``items`` (source) are summed before they are joined.
    """
    n = lambda action: F.count_if(F.col("action") == action).alias(action)
    out = diff.groupBy(by).agg(*map(n, ("added", "updated", "withdrawn", "unchanged")), F.count_if(F.col("action").isin("added", "updated", "unchanged")).alias("valid_events"))
    for name, rows in (("claims", claims), ("parked", parked), ("projection_work_items", items)):
        out = out.join(rows.groupBy(by).agg(F.count("*").alias(name)), by, "full_outer")
    out = out.na.fill(0)
    return out.withColumn("raw_items", F.col("valid_events") + F.col("parked"))


def run_state(state: DataFrame, runs: DataFrame) -> DataFrame:
    """``state`` after the newest run of each source: last and last complete observation, baselines, times and failures in a row.

    ``state`` (source_id, last_observation, last_complete_observation, last_normalised, last_complete_normalised, last_run_at,
    last_success_at, last_failure_at, consecutive_failures); ``runs`` (source_id, started_at, ok, complete, observation,
    normalised), one a source. A failure moves no observation and no baseline; an incomplete capture moves no complete one.
    """
    new = runs.select("source_id", F.col("started_at").alias("_at"), "ok", F.col("complete").alias("_whole"), "observation", "normalised")
    both = state.join(new, "source_id", "full_outer")
    ran, ok = F.col("_at").isNotNull(), F.coalesce("ok", F.lit(False))
    whole = ok & F.coalesce("_whole", F.lit(False))
    moved = lambda when, value, old: F.when(when, F.col(value)).otherwise(F.col(old)).alias(old)
    fails = F.when(~ran, F.col("consecutive_failures")).when(ok, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    return both.select(
        "source_id", moved(ok, "observation", "last_observation"), moved(whole, "observation", "last_complete_observation"), moved(ok, "normalised", "last_normalised"),
        moved(whole, "normalised", "last_complete_normalised"), moved(ran, "_at", "last_run_at"), moved(ok, "_at", "last_success_at"), moved(ran & ~ok, "_at", "last_failure_at"),
        fails.cast("long").alias("consecutive_failures"),
    )


def folded(state: DataFrame, runs: DataFrame) -> DataFrame:
    """``state`` after all ``runs``, many a source: what :func:`run_state` gives for one after the other, in the order of their times.

    The last run of each kind, and the failures after the last success, are aggregates that combine before they meet, so one
    pass does for any number of runs. Equal times go by success, completeness, observation and baseline, nulls first;
    equal rows count once.
    """
    order = F.struct(F.col("started_at").alias("_at"), F.col("ok"), F.col("complete"), F.col("observation"), F.col("normalised"))
    rows = runs.select("source_id", order.alias("_run")).distinct().withColumn("_ok", F.coalesce("_run.ok", F.lit(False)))
    whole = F.col("_ok") & F.coalesce(F.col("_run.complete"), F.lit(False))
    last = rows.groupBy("source_id").agg(F.max("_run").alias("_last"), F.max(F.when(F.col("_ok"), F.col("_run"))).alias("_good"), F.max(F.when(whole, F.col("_run"))).alias("_whole"), F.max(F.when(~F.col("_ok"), F.col("_run"))).alias("_bad"))
    after = rows.join(last.select("source_id", "_good"), "source_id").where("_good is null or _run > _good").groupBy("source_id").agg(F.count("*").alias("_fails"))
    both = state.join(last.join(after, "source_id", "left"), "source_id", "full_outer")
    moved = lambda kind, field, old: F.when(F.col(kind).isNotNull(), F.col(f"{kind}.{field}")).otherwise(F.col(old)).alias(old)
    fails = F.coalesce("_fails", F.lit(0)) + F.when(F.col("_good").isNull(), F.coalesce("consecutive_failures", F.lit(0))).otherwise(0)
    return both.select(
        "source_id", moved("_good", "observation", "last_observation"), moved("_whole", "observation", "last_complete_observation"), moved("_good", "normalised", "last_normalised"),
        moved("_whole", "normalised", "last_complete_normalised"), moved("_last", "_at", "last_run_at"), moved("_good", "_at", "last_success_at"), moved("_bad", "_at", "last_failure_at"), fails.cast("long").alias("consecutive_failures"),
    )


def failures_in_a_row(runs: DataFrame, source: str, at: str, ok: Column, tie: str) -> DataFrame:
    """(source, consecutive_failures): failed runs after the last successful one.

    Two aggregates, no window: the last success of each source, and the count of what comes after.
    """
    rows = runs.select(source, F.struct(at, tie).alias("_at"), ok.alias("_ok"))
    last = rows.groupBy(source).agg(F.max(F.when(F.col("_ok"), F.col("_at"))).alias("_last"))
    after = rows.join(last, source).where("_last is null or _at > _last").groupBy(source).agg(F.count("*").alias("_n"))
    return last.join(after, source, "left").select(source, F.coalesce("_n", F.lit(0)).alias("consecutive_failures"))


def dispatch(sources: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """(source_id, queue, reason, expected, next_scan) of the due sources, at most ``most``, the longest due first.

    ``sources`` (source_id, enabled, cadence, runtime, next_scan_at, next_scan): disabled and manual ones aren't due. Each is
    sent to its runtime's queue, and its schedule moves from expected to next_scan by compare and swap.
    """
    due = sources.where(F.col("enabled") & (F.col("next_scan_at") <= now) & F.col("next_scan").isNotNull()).orderBy("next_scan_at", "source_id").limit(most)
    return due.select("source_id", queue_of(F.col("runtime")).alias("queue"), F.lit("scheduled").alias("reason"), F.col("next_scan_at").alias("expected"), "next_scan")


def queue_of(runtime: Column) -> Column:
    return F.when(runtime == "browser", "browser").otherwise("standard")


def dispatch_manual(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """(source_id, queue, reason) of asked sources, disabled ones too; the schedule doesn't move. Unknown ones are left out."""
    return sources.join(asked.select("source_id").distinct(), "source_id", "left_semi").select("source_id", queue_of(F.col("runtime")).alias("queue"), F.lit("manual").alias("reason"))


def advance(sources: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with their schedules moved, (source_id, outcome)): enqueued where next_scan_at still is what was expected, else stale."""
    hit = sources.join(moves.select("source_id", "expected", F.col("next_scan").alias("_next")), "source_id", "left")
    won = F.coalesce(F.col("enabled") & F.col("next_scan_at").eqNullSafe(F.col("expected")), F.lit(False))
    hit = hit.withColumn("_won", won)
    outcome = moves.select("source_id").join(hit.select("source_id", "_won"), "source_id", "left").select("source_id", F.when(F.col("_won"), "enqueued").otherwise("stale").alias("outcome"))
    return hit.withColumn("next_scan_at", F.when(F.col("_won"), F.col("_next")).otherwise(F.col("next_scan_at"))).select(*sources.columns), outcome


def outcome_counts(rows: DataFrame, outcomes: tuple[str, ...], column: str = "outcome") -> DataFrame:
    """One row with the number of each outcome and of all."""
    return rows.agg(F.count("*").alias("discovered"), *(F.count_if(F.col(column) == o).alias(o) for o in outcomes))


def islands(runs: DataFrame, source: str, at: str, ok: Column) -> DataFrame:
    """Runs with failures: how many runs up to each one failed since the last success, for a report of all runs of a source."""
    order = Window.partitionBy(source).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("_run", F.sum(F.when(ok, 1).otherwise(0)).over(order))
    within = Window.partitionBy(source, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(F.when(ok, 0).otherwise(1)).over(within)).drop("_run")


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source (source_id, started_at, observation, ...), of equal times the greatest observation's."""
    return best_per_key(runs, ["source_id"], F.struct("started_at", "observation"), F.col("observation"))


def drift(counts: DataFrame, source: str, period: str, n: str, width: int = 6, least: float = 3.0) -> DataFrame:
    """(source, period, n, ratio, z, changed) of each period: how its level compares with what came before.

    ``counts`` are summed to one row for each source and period (a day, say), so that a source's series is no longer than the
    calendar. ratio is n over the mean of up to ``width`` periods before; z compares the means of the logarithms of n + 1 over
    ``width`` periods from this one on and before it, in standard errors. A change is a full pair of windows beyond ``least``.
    """
    rows = counts.groupBy(source, period).agg(F.sum(n).alias("n")).where(F.col(source).isNotNull() & F.col(period).isNotNull())
    order = Window.partitionBy(source).orderBy(period)
    before, after = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    level = F.log(F.col("n") + 1.0)
    mean = lambda w: F.avg(level).over(w)
    spread = lambda w: F.greatest(F.lit(0.0), F.avg(level * level).over(w) - mean(w) * mean(w))
    error = F.sqrt((spread(before) + spread(after)) / width + 1e-6)
    full = (F.count("*").over(before) == width) & (F.count("*").over(after) == width)
    out = rows.select(source, period, "n", F.round(F.col("n") / F.avg("n").over(before), 6).alias("ratio"), F.when(full, F.round((mean(after) - mean(before)) / error, 4)).alias("z"))
    return out.withColumn("changed", F.coalesce(F.abs("z") >= least, F.lit(False)))


def health(drifted: DataFrame, source: str, period: str) -> DataFrame:
    """(source, last_period, last_ratio, changes, strongest) of :func:`drift`: the newest period, how many changes, and the first of the largest."""
    best = F.max(F.when(F.col("changed"), F.abs("z")))
    top = drifted.groupBy(source).agg(F.max(period).alias("last_period"), F.max_by("ratio", period).alias("last_ratio"), F.count_if("changed").alias("changes"), best.alias("_top"))
    at = drifted.join(top.select(source, "_top"), source).where(F.col("changed") & (F.abs("z") == F.col("_top"))).groupBy(source).agg(F.min(period).alias("strongest"))
    return top.drop("_top").join(at, source, "left")
