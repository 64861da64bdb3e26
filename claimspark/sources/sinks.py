"""Sinks: evidence and run artifacts in dated folders, queues, exceptions, and the tables that a projection changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text, times
from claimspark.operators import projection
from claimspark.sources import formats
from claimspark.sources.shared import kept
from claimspark.sources.store import Store

ARTIFACTS = ("normalised", "diff", "parity", "run-report")


def evidence_key(source: Column, at: Column, observation: Column, kind: Column) -> Column:
    """``source-observations/<source>/<yyyy>/<mm>/<dd>/<observation>/raw.<extension>``."""
    parts = (F.lit("source-observations"), text.safe_segment(source), times.path_date(at), text.safe_segment(observation), F.concat(F.lit("raw."), text.extension_of(kind)))
    return F.concat_ws("/", *parts)


def evidence_rows(observations: DataFrame) -> DataFrame:
    """``observations`` (observation_id, source_id, observed_at, content_type, body) with evidence_key and day."""
    return observations.withColumns({"evidence_key": evidence_key(F.col("source_id"), F.col("observed_at"), F.col("observation_id"), text.content_kind(F.col("content_type"))), "day": F.to_date("observed_at")})


def put_evidence(store: Store, observations: DataFrame) -> DataFrame:
    """Add observations once each; those that are there already are returned.

    Bodies are rows of the store's parts, not one object each, so that a run of many sources writes few files.
    """
    rows = evidence_rows(observations)
    return store.put_once("source_observation", rows, ["observation_id"], ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def write_artifacts(rows: DataFrame, root: str, kind: str) -> None:
    """A run's artifacts as JSON lines, by source and run; an artifact that is there is never written over."""
    if kind not in ARTIFACTS:
        raise ValueError(f"unknown artifact {kind}")
    safe = rows.withColumns({c: text.safe_segment(F.col(c)) for c in ("source_id", "run_id")})
    safe.write.mode("errorifexists").partitionBy("source_id", "run_id").json(f"{root.rstrip('/')}/{kind}")


def publish(items: DataFrame, queue: str, required: list[str], batch: str | None = None) -> DataFrame:
    """Send the complete items to a queue as one batch; the incomplete ones are returned.

    All of a batch is seen at once or not at all, and a batch of a name that is there already sends nothing, so that a
    sending may be repeated. Without a name each sending is a batch of its own.
    """
    whole = F.lit(True)
    for c in required:
        whole = whole & F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    out = items.where(whole).write.format("queue").option("path", queue).mode("append")
    formats.register(items.sparkSession)
    (out.option("batch", batch) if batch else out).save()
    return items.where(~whole)


NOTE = "id string, capture_id string, note string, at string"


def capture_status(store: Store, captures: DataFrame, schema: str) -> None:
    """Set the status of captures (id, new_status, and note and at, if they have any) and add their notes, in one commit.

    A note that is added again is the same one.
    """
    captures = kept(captures, "captures")
    with store.transaction() as change:
        now = change.read("capture", schema)
        new = captures.select("id", F.col("new_status").alias("_status"))
        change.upsert("capture", now.join(new, "id").withColumn("status", F.col("_status")).select(now.columns), ["id"], schema)
        if "note" in captures.columns:
            notes = captures.where("note <> ''").select(F.col("id").alias("capture_id"), "note", "at").withColumn("id", text.identity("note-", F.col("capture_id"), F.col("at"), F.col("note")))
            change.put_once("capture_note", notes, ["id"], NOTE)


def persist_knowledge(store: Store, observations: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence and its claims in one commit; (observation_id, evidence_key, claim_records) of each observation.

    ``observations`` as for :func:`put_evidence`, ``claims`` (claim_id, observation_id, ...). What is there already stays as it is and counts.
    """
    rows, claims = kept(evidence_rows(observations), "evidence"), kept(claims, "claims")
    types = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    with store.transaction() as change:
        change.put_once("source_observation", rows, ["observation_id"], types(rows))
        change.put_once("claim", claims, ["claim_id"], types(claims))
    n = claims.groupBy("observation_id").agg(F.count_distinct("claim_id").alias("claim_records"))
    return rows.select("observation_id", "evidence_key").distinct().join(n, "observation_id", "left").na.fill(0, ["claim_records"])


def write_projection(store: Store, outcomes: DataFrame, found: DataFrame | None, candidates: DataFrame, world: projection.World, at: str, batch: tuple[str, int] | None = None) -> bool:
    """All changes of a projection in one commit: canonical artists, venues and events, links, mappings, tombstones, withdrawals, exceptions, enrichment items and the ledger.

    ``candidates`` are those of :func:`projection.event_candidates` with claim_id, the claim that each item puts forward. ``found`` are
    the items' claims; without them the candidates are those of :func:`projection.item_candidates`, and claims are looked for where
    links or withdrawals need them. Outcomes meet their candidates once, for all tables. Readers see
    the run whole or not at all, and a run that is repeated changes nothing more. With ``batch``, a writer's name and a growing number,
    a batch that is committed already is left out; the result is whether this one was written.
    """
    types = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    outcomes = kept(outcomes, "outcomes")
    told = kept(outcomes.where("status = 'success'").join(projection.dealt(candidates.drop("n_claims", "status").withColumn("has_candidate", F.lit(True))), "idempotency_key", "left"), "told")
    if found is None:
        needing = told.where("action not in ('cancel', 'withdraw') or event_hidden")
        found = projection.item_claims(needing.where("has_candidate"), world.claims)
    found = kept(found.select("idempotency_key", "claim_id", "predicate", "claim_source", "observed_at"), "found")
    with_candidate = told.where("has_candidate")
    with store.transaction() as change:
        if batch and not change.once(*batch):
            change.writer = None
            return False
        for kind in ("artist", "venue"):
            rows = projection.new_entities(with_candidate, None, kind)
            change.put_once(kind, rows, ["id"], types(rows))
        events = projection.changed_events(told, None, world.events)
        change.upsert("event", events, ["id"], types(events))
        links = projection.support_links(told, found)
        change.put_once("support_link", links, links.columns, types(links))
        mappings = projection.changed_mappings(world.mappings, outcomes)
        change.upsert("projection_mapping", mappings, ["source_id", "candidate_key"], types(mappings))
        graves = projection.tombstone_rows(with_candidate, None, world, at)
        later = {c: F.lit(None).cast("string") for c in ("superseded_at", "superseded_by_claim_id")}
        graves = graves.withColumns(later)
        change.put_once("tombstone", graves, ["id"], types(graves))
        change.upsert("tombstone", _brought_back(change.read("tombstone", types(graves)), projection.reinstated(world.tombstones, with_candidate, None, at, changed=True)), ["id"], types(graves))
        sources = with_candidate.where("event_hidden").select("idempotency_key", "source_id", F.col("claim_id").alias("proposed_claim_id"))
        gone = projection.withdrawals(told, projection.prior_claims(found, sources), at)
        change.put_once("source_withdrawal", gone, ["id"], types(gone))
        failed = projection.exceptions(outcomes, at)
        change.put_once("projection_exception", failed, ["id"], types(failed))
        more = projection.enrichment_items(told)
        change.put_once("entity_enrichment", more, ["id"], types(more))
        done = projection.ledger_rows(outcomes)
        change.upsert("projection_item", done, ["idempotency_key"], types(done))
    return True


def _brought_back(now: DataFrame, back: DataFrame) -> DataFrame:
    """Reinstated tombstones as whole rows of the store: as they are there, or with their key alone if they came from elsewhere."""
    mark = F.concat_ws("|", "artist_id", "venue_id", "date")
    new = back.withColumns({"id": text.identity("tombstone-", mark), "event_fingerprint": mark})
    old = now.select("id", *(F.col(c).alias(f"_{c}") for c in now.columns if c != "id"))
    both = new.join(projection.dealt(old), "id", "left")
    return both.select(*(F.col(c) if c == "id" else F.coalesce(c, f"_{c}").alias(c) if c in new.columns else F.col(f"_{c}").alias(c) for c in now.columns))


def put_discoveries(store: Store, results: DataFrame) -> None:
    """Discovery results by entity, time and run, and the eligibility that follows from them by entity, in one commit."""
    types = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    results = kept(results, "discoveries")
    newest = results.groupBy("type", "id").agg(F.max_by(F.struct("class", "suppressed", "suppressed_until", "retrieved_at"), F.struct("retrieved_at", "run_id")).alias("_e")).select("type", "id", "_e.*")
    with store.transaction() as change:
        change.upsert("discovery_result", results, ["type", "id", "retrieved_at", "run_id"], types(results))
        change.upsert("eligibility", newest, ["type", "id"], types(newest))
