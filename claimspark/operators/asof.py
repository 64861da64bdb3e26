"""As-of joins: for each request the last earlier row of its key, in one ordered pass over both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.sources.shared import kept


def as_of(asked: DataFrame, rows: DataFrame, key: str, at: str, kinds: dict[str, str], ties: list[str]) -> DataFrame:
    """``asked`` (key, at, ...) with one struct column for each of ``kinds`` (name: condition): the last of ``rows`` before ``at`` that fits.

    ``rows`` (key, at, ...) of equal times count in the order of ``ties``; rows at the very time aren't before it. Both sides are
    dealt to ranges of (key, at), so that a key of any size is many tasks; values are carried within a range, and from range to
    range by the last one of each. Linear in both sides: no pair of them is formed. Null keys and times find nothing.
    """
    found = [c for c in rows.columns if c != key]
    fits = {name: F.when(F.expr(condition), F.struct(*found)) for name, condition in kinds.items()}
    past = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_late"), F.struct(*ties).alias("_tie"), *(v.alias(f"_{n}") for n, v in fits.items()))
    mine = asked.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_late"), F.struct(*asked.columns).alias("_asked"))
    both = past.unionByName(mine, allowMissingColumns=True)
    # Written, so that the ranges are the same for both readers.
    both = kept(both.repartitionByRange("_k", "_t", "_late").withColumn("_range", F.spark_partition_id()), "asof")
    order = [F.col("_t"), F.col("_late"), F.col("_tie")]
    within = Window.partitionBy("_range", "_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A row for each range of a key.
    place = F.struct("_t", "_late", "_tie")
    ends = both.groupBy("_k", "_range").agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in kinds))
    before = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select("_k", "_range", *(F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_ahead_{n}") for n in kinds))
    carried = both.withColumns({f"_last_{n}": F.last(f"_{n}", ignorenulls=True).over(within) for n in kinds}).where("_asked is not null")
    out = carried.join(ahead, carried["_k"].eqNullSafe(ahead["_k"]) & (carried["_range"] == ahead["_range"]), "left")
    return out.select("_asked.*", *(F.coalesce(f"_last_{n}", f"_ahead_{n}").alias(n) for n in kinds))
