"""Access paths of the stores: by key, by subject, newest or due first. Filters reach the scan; limits are top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim_by_id(claims: DataFrame, claim_id: str) -> DataFrame:
    return claims.where(F.col("claim_id") == claim_id)


def claims_of_observation(claims: DataFrame, observation_id: str, most: int = 1000) -> DataFrame:
    """The oldest claims of an observation."""
    return claims.where(F.col("observation_id") == observation_id).orderBy("observed_at", "claim_id").limit(most)


def claims_of_subject(claims: DataFrame, subject: str, most: int | None = None) -> DataFrame:
    """Claims of a subject, the oldest first; all of them unless ``most`` is given."""
    rows = claims.where(F.col("subject") == subject).orderBy("observed_at", "claim_id")
    return rows.limit(most) if most else rows


def support_claims(links: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Ids of the claims that support an entity."""
    return links.where((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)).select("claim_id").distinct()


def newest(rows: DataFrame, by: str, at: str, tie: str, most: int = 20) -> DataFrame:
    """The newest ``most`` rows of each group. Groups are cut to that before they meet, so that none is one task."""
    order = Window.partitionBy(by).orderBy(F.col(at).desc(), tie)
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def due(sources: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Enabled sources whose next_scan has come, the longest due first."""
    return sources.where(F.col("enabled") & (F.col("next_scan") <= now)).orderBy("next_scan", "source_id").limit(most)


def by_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns (those of ``keys``) are asked for: tombstones, batches of entities, configurations, states."""
    return rows.join(keys.distinct(), keys.columns, "left_semi")


def with_looked_up(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``known`` (keys unique in it), null where there is none: eligibility, mappings, states."""
    return rows.join(known, keys, "left")


def run_items(rows: DataFrame, observation_id: str) -> DataFrame:
    """All items of an observation's run, in the order of their keys."""
    return rows.where(F.col("observation_id") == observation_id).orderBy("idempotency_key")


def by_external_id(events: DataFrame, source: str, external_id: str) -> DataFrame:
    """The event that carries the external id: of several the one of least id."""
    has = F.exists("external_ids", lambda x: (x["source"] == source) & (x["id"] == external_id))
    return events.where(has).orderBy("id").limit(1)
