"""Snapshots: first-wins keys, content fingerprints, the classified difference, and the work that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import identity, trimmed


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in a total order (last-wins: give it descending)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def best_per_key(df: DataFrame, keys: list[str], most: Column, tie: Column) -> DataFrame:
    """One row of each key: that of the greatest ``most``, of equal ones the least ``tie``.

    Every task leaves one row of each key before the shuffle (a limit of ranked groups), so that no key, however common, is
    one task, and rows are dealt once.
    """
    order = Window.partitionBy(*keys).orderBy(most.desc(), tie.asc_nulls_last())
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def fingerprint(*columns: str) -> Column:
    """SHA-256 over named values in the order of their names; null differs from empty."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\x00")), F.lit("\x1f")) for c in sorted(columns)]
    return F.sha2(F.concat(*parts), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, run_date: Column, complete: bool, mode: str = "delta", semantics: str = "complete") -> DataFrame:
    """(key, action, date) of the full outer join of two snapshots (key, print, date), keys unique in each.

    added, updated and unchanged come from the later snapshot. Absence counts only if that is complete and the source is a
    delta of complete snapshots: then what is gone is pastDropped if its date has passed, and withdrawn otherwise (without
    a date it counts as still to come). In all other cases it is an ignoredAbsence.
    """
    b = before.select("key", F.col("print").alias("print_b"), F.col("date").alias("date_b"), F.lit(True).alias("in_b"))
    a = after.select("key", F.col("print").alias("print_a"), F.col("date").alias("date_a"), F.lit(True).alias("in_a"))
    counts = complete and mode == "delta" and semantics == "complete"
    gone = F.when(F.col("date_b") < run_date, "pastDropped").otherwise("withdrawn") if counts else F.lit("ignoredAbsence")
    action = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), gone).when(F.col("print_a").eqNullSafe(F.col("print_b")), "unchanged").otherwise("updated")
    return b.join(a, "key", "full_outer").select("key", action.alias("action"), F.coalesce("date_a", "date_b").alias("date"))


#: Statuses that say outright that an event is off.
CANCELLED = ("cancelled", "canceled", "cancelled_event")
ABSENT = "absent-from-complete-snapshot"


def is_cancelled(status: Column) -> Column:
    return F.coalesce(F.lower(trimmed(status)).isin(*CANCELLED), F.lit(False))


def work_items(diff: DataFrame, source: str, observation: str, cancelled: Column) -> DataFrame:
    """Work of a diff: create, update, cancel or withdraw, with ids and idempotency keys."""
    what = F.when(F.col("action").isin("added", "updated") & cancelled, "cancel").when(F.col("action") == "added", "create").when(F.col("action") == "updated", "update").when(F.col("action") == "withdrawn", "withdraw")
    items = diff.withColumn("work", what).where("work is not null").withColumn("candidate", F.concat(F.lit(f"event:{source}:"), F.col("key").cast("string")))
    return items.select("candidate", "work", identity("projection-", F.lit(source), F.lit(observation), F.col("candidate"), F.col("work")).alias("id"), F.concat_ws(":", F.lit(source), F.lit(observation), "candidate", "work").alias("idempotency_key"))


def withdrawal_claims(items: DataFrame, source: str, observation: str, observed_at: str) -> DataFrame:
    """The claim that stands for the absence behind each item of work ``withdraw``."""
    gone = items.where("work = 'withdraw'").select(F.col("candidate").alias("subject"), F.lit("hasStatus").alias("predicate"), F.lit(ABSENT).alias("value"))
    key = identity("claim-", F.lit(observation), F.col("subject"), F.col("predicate"), F.lit(f'"{ABSENT}"'))
    return gone.select(key.alias("claim_id"), F.lit(observation).alias("observation_id"), F.lit(source).alias("source_id"), "subject", "predicate", "value", F.lit(observed_at).alias("observed_at"), F.lit("active").alias("status"))


def with_claims(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Items with claim_ids, those of their candidate (claims: subject, claim_id) in order; none gives an empty list."""
    ids = claims.groupBy(F.col("subject").alias("candidate")).agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"))
    return items.join(ids, "candidate", "left").withColumn("claim_ids", F.coalesce("claim_ids", F.array().cast("array<string>")))


def numbered(items: DataFrame, order: str = "idempotency_key", parts: int = 64) -> DataFrame:
    """Items with run_ordinal, from 1 on in that order, and run_item_count.

    Counted in two steps: rows within ranges of the order, and the ranges' sizes, so that the run isn't one task.
    """
    spark = items.sparkSession
    # The ranges' edges are numbers of rows at most as many as parts.
    edges = items.select(F.xxhash64(order).alias("h"), order).where(F.pmod("h", F.lit(max(1, items.count() // (parts * 16)))) == 0).select(order).orderBy(order).collect()
    cuts = [edges[k * len(edges) // parts][0] for k in range(1, parts)] if edges else []
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    rows = items.withColumn("_part", at)
    sizes = [tuple(r) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()]
    first = spark.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "_part int, _first long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    out = rows.withColumn("_place", place).join(F.broadcast(first), "_part")
    return out.withColumns({"run_ordinal": F.col("_first") + F.col("_place"), "run_item_count": F.lit(sum(n for _, n in sizes))}).drop("_part", "_place", "_first")


def pending(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items that the ledger (idempotency_key, status) doesn't hold as done."""
    return items.join(ledger.where(F.col("status").isin("success", "shadow")), "idempotency_key", "left_anti")


def run_rollup(rows: DataFrame, run: str, item: list[str], counters: list[str], *newest: Column) -> DataFrame:
    """Sums over the newest row of each item of a run: a retry replaces what it repeats."""
    latest = first_per_key(rows, [run, *item], *newest)
    return latest.groupBy(run).agg(F.count("*").alias("items"), *(F.sum(c).alias(c) for c in counters))


#: Counters of a run, besides items_seen.
COUNTERS = ("claims", "artists_created", "artists_matched", "venues_created", "venues_matched", "events_created", "events_updated", "events_cancelled", "projection_failures")


def run_summary(rows: DataFrame) -> DataFrame:
    """One row for each observation_id: items_seen, the sums of COUNTERS, status, errors, completed_at.

    ``rows`` (observation_id, idempotency_key, completed_at, expected_items, error, COUNTERS): the newest row of an item counts.
    A run is done when it has seen the expected items; it succeeds if it's done without failures and else is partial.
    completed_at is the last item's time, of a run that is done. Errors are in the order of their items.
    """
    latest = best_per_key(rows, ["observation_id", "idempotency_key"], F.struct("completed_at"), F.struct(*(F.col(c) for c in rows.columns)))
    failed = F.when(F.col("error").isNotNull(), 1).otherwise(F.coalesce("projection_failures", F.lit(0)))
    latest = latest.withColumn("projection_failures", failed)
    sums = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS]
    errors = F.transform(F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("idempotency_key", "error")))), lambda e: e["error"])
    out = latest.groupBy("observation_id").agg(F.count("*").alias("items_seen"), F.max("expected_items").alias("_expected"), F.max("completed_at").alias("_last"), errors.alias("errors"), *sums)
    done = F.col("items_seen") >= F.coalesce("_expected", F.lit(1))
    out = out.withColumn("status", F.when(done & (F.col("projection_failures") == 0), "success").otherwise("partial")).withColumn("completed_at", F.when(done, F.col("_last")))
    return out.drop("_expected", "_last")
