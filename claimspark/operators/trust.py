"""Conflicts of claims: trust in sources and confidence in values, each from the other; and places of a shared footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.sources.shared import kept

#: Rounds of the fixed point, digits that are kept, and the trust in a source of unknown class.
ROUNDS, DIGITS, UNKNOWN = 5, 9, 0.35


def trust_scores(claims: DataFrame, sources: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((source, trust), (subject, predicate, value, confidence, authority, n_sources)) after a number of rounds.

    ``claims`` (source, subject, predicate, value) count once each; ``sources`` (source, score) gives the first trust, a
    hundredth of a source's authority. A value's confidence is the trust in those who assert it, as a share of that in all
    who assert anything about the subject's predicate; the trust in a source is the mean confidence of what it asserts.
    Numbers are rounded, so that the order of sums changes nothing. Claims without a subject, predicate or value don't count.
    """
    rows = claims.select("source", "subject", "predicate", "value").where("subject is not null and predicate is not null and value is not null").distinct()
    known = sources.groupBy("source").agg(F.max("score").alias("score"))
    rows = kept(rows.join(known, "source", "left").withColumn("authority", F.coalesce(F.col("score") / 100.0, F.lit(UNKNOWN))).drop("score"), "trust")
    trust = rows.groupBy("source").agg(F.round(F.max("authority"), DIGITS).alias("trust"))
    value = ["subject", "predicate", "value"]
    held = None
    for _ in range(rounds):
        said = rows.join(trust, "source")
        one = said.groupBy(*value).agg(F.sum("trust").alias("_own"), F.max("authority").alias("authority"), F.count("*").alias("n_sources"))
        every = one.groupBy("subject", "predicate").agg(F.sum("_own").alias("_all"))
        held = kept(one.join(every, ["subject", "predicate"]).select(*value, F.round(F.when(F.col("_all") > 0, F.col("_own") / F.col("_all")).otherwise(0.0), DIGITS).alias("confidence"), "authority", "n_sources"), "trust")
        trust = kept(rows.join(held.select(*value, "confidence"), value).groupBy("source").agg(F.round(F.avg("confidence"), DIGITS).alias("trust")), "trust")
    return trust, held


def resolved(held: DataFrame) -> DataFrame:
    """(subject, predicate, value, confidence, contested) of each subject's predicate: by authority, then agreement (confidence), then the least value.

    contested says whether there is any other value.
    """
    top = held.groupBy("subject", "predicate").agg(F.max(F.struct("authority", "confidence")).alias("_top"), F.count("*").alias("_n"))
    rows = held.join(top, ["subject", "predicate"]).where(F.struct("authority", "confidence") == F.col("_top"))
    return rows.groupBy("subject", "predicate").agg(F.min("value").alias("value"), F.first("confidence").alias("confidence"), (F.first("_n") > 1).alias("contested"))


def footprint_pairs(items: DataFrame, percent: int = 60) -> DataFrame:
    """(a, b, common, size_a, size_b) of entities a < b whose footprints have a Jaccard similarity of ``percent`` or more.

    ``items`` (entity, token): an entity's footprint is its distinct tokens, such as the performers and days that two places share.
    Tokens are in one order, the rarest first; two such sets share one of their first n - ceil(percent n / 100) + 1, so only
    these meet, and the whole sets of the pairs that remain are compared. Nulls don't count.
    """
    rows = items.select("entity", "token").where("entity is not null and token is not null").distinct()
    often = rows.groupBy("token").agg(F.count("*").alias("_often"))
    sets = rows.join(often, "token").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("_often", "token"))).alias("_s"))
    # One footprint is one entity's own tokens.
    sets = kept(sets.select("entity", F.transform("_s", lambda x: x["token"]).alias("tokens"), F.size("_s").alias("n")), "footprints")
    first = sets.select("entity", "n", F.posexplode(F.slice("tokens", 1, F.expr(f"int(n - (n * {percent} + 99) div 100 + 1)"))).alias("pos", "token"))
    x, y = (first.select(F.col("entity").alias(e), F.col("n").alias(f"size_{e}"), F.col("pos").alias(f"pos_{e}"), "token") for e in "ab")
    able = F.expr(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) and {100 + percent} * least(size_a - pos_a, size_b - pos_b) >= {percent} * (size_a + size_b)")
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & able).select("a", "b", "size_a", "size_b").distinct()
    lists = [sets.select(F.col("entity").alias(e), F.col("tokens").alias(f"_{e}")) for e in "ab"]
    both = pairs.join(lists[0], "a").join(lists[1], "b").withColumn("common", F.size(F.array_intersect("_a", "_b")))
    return both.where(F.expr(f"100 * common >= {percent} * (size_a + size_b - common)")).select("a", "b", "common", "size_a", "size_b")
