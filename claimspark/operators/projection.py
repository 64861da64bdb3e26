"""Projection of work items onto canonical artists, venues and events, as staged tables.

Each gate decides the items that it stops; the rest go on to the next one. Nothing is written here: the outcome of every
item is one row, and the tables of changes (new entities, updates, tombstones, links, mappings, ledger rows) are derived
from it, so that a run can be repeated, and written by upserts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.text import identity, match_key, present, without_prefix
from claimspark.operators.claims import EVENT, base_scores, decide, strongest
from claimspark.operators.reconcile import best_per_key
from claimspark.sources.shared import kept

#: A candidate's required fields, in the order in which missing ones are named.
REQUIRED = {"artist_name": "artistName", "venue_name": "venueName", "venue_location": "venueLocation", "date": "date", "start_time": "startTime"}
TEXTS = {
    "occursOn": "date", "startsAt": "start_time", "endsAt": "end_time", "hasTitle": "title", "hasEventUrl": "event_url", "hasTicketUrl": "ticket_url",
    "hasAdmissionStatus": "admission_status", "hasPrice": "price", "hasStatus": "status",
}


#: A candidate's columns that gates read.
GATED = ("idempotency_key", "artist_name", "venue_name", "date", "missing", "n_claims", "proposed_claim_id")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals both sides by the key. Tables that grow with the items are never sent to every task:
    their files are far smaller than their rows, so that Spark's estimate would send millions of them through the driver."""
    return df.hint("merge")


class World(NamedTuple):
    """What a projection reads.

    sources (source_id, authority, shadow, writer); claims (claim_id, source_id, subject, predicate, value, observed_at,
    status; values of performers and places are JSON objects); mappings (source_id, candidate_key, artist_id, venue_id,
    event_id); artists and venues (id, name); events (id, artist_id, artist_ids, venue_id, date, cancelled, is_public,
    membership_id, verified_by_artist, external_ids array<struct<source,id>>); tombstones (artist_id, venue_id, date, status);
    links (entity_type, entity_id, claim_id); ledger (idempotency_key, status).
    """

    sources: DataFrame
    claims: DataFrame
    mappings: DataFrame
    artists: DataFrame
    venues: DataFrame
    events: DataFrame
    tombstones: DataFrame
    links: DataFrame
    ledger: DataFrame


def item_claims(items: DataFrame, claims: DataFrame) -> DataFrame:
    """(idempotency_key, the claim's columns, named) of each item: its candidate's claims, or if there are none those that its claim_ids name.

    named tells whether the item's claim_ids hold the claim. If ``items`` have looked_up, it tells which of them have claims by name only.
    """
    columns = ["idempotency_key", *(c for c in claims.columns if c != "source_id"), "claim_source", "named"]
    mine = items.select("idempotency_key", "candidate_key", "claim_ids", *(["looked_up"] if "looked_up" in items.columns else []))
    if "looked_up" in items.columns:
        own, bare = mine.where("not looked_up"), mine.where("looked_up")
    else:
        own, bare = mine, mine.join(dealt(claims.select("subject").distinct()), F.col("candidate_key") == F.col("subject"), "left_anti")
    by_subject = own.join(_of_candidates(claims), F.col("candidate_key") == F.col("subject")).withColumn("named", _named())
    if "looked_up" in items.columns and bare.isEmpty():
        return by_subject.select(*columns)
    return by_subject.select(*columns).unionByName(_looked_up(bare, claims).select(*columns))


def _named() -> Column:
    """Whether the item's claim_ids hold the claim."""
    return F.coalesce(F.array_contains("claim_ids", F.col("claim_id")), F.lit(False))


def _of_candidates(claims: DataFrame) -> DataFrame:
    """Claims as a side of a join with items, whose source_id is another one."""
    return dealt(claims.withColumn("claim_source", F.col("source_id")).drop("source_id"))


def _looked_up(bare: DataFrame, claims: DataFrame) -> DataFrame:
    """The claims that items name, each once an item."""
    named = bare.select("idempotency_key", F.explode("claim_ids").alias("claim_id")).distinct()
    return named.join(_of_candidates(claims), "claim_id").withColumn("named", F.lit(True))


def item_candidates(items: DataFrame, claims: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept, columns: tuple[str, ...] = ()) -> DataFrame:
    """:func:`event_candidates` of :func:`item_claims`, with the item's claim_ids and looked_up (its claims were found by name, not by its candidate).

    Claims are dealt by their subject, and once more by their id only if some item's candidate has none; they are never dealt by item.
    With ``columns`` (n_claims is one) no others of the candidate are kept.
    """
    mine = items.select("idempotency_key", "candidate_key", "claim_ids")
    found = mine.join(_of_candidates(claims), F.col("candidate_key") == F.col("subject"), "left").withColumn("named", _named())
    only = lambda df: df.select(*columns, "claim_ids") if columns else df
    every = keep(only(event_candidates(found, ["candidate_key", "idempotency_key"])))
    own, bare = every.where("n_claims > 0").withColumn("looked_up", F.lit(False)), every.where("n_claims = 0").select("idempotency_key", "claim_ids")
    if bare.isEmpty():
        return own
    named = only(event_candidates(_looked_up(bare, claims)).join(dealt(bare), "idempotency_key")).withColumn("looked_up", F.lit(True))
    return own.unionByName(keep(named))


def event_candidates(found: DataFrame, dealt_by: list[str] | None = None) -> DataFrame:
    """One row an item: the fields of its latest active claims, missing (names, comma-joined), observed_at, n_claims.

    A performer's or place's object comes before its name's claim; texts are trimmed, blank ones are missing. observed_at is the
    greatest of all claims, active or not. If ``found`` has named, proposed_claim_id is the first of the claims that the item names.
    With ``dealt_by`` (candidate_key and the item's key) ``found`` is dealt by candidate already, may hold items without claims, and
    its claim_ids are returned too.
    """
    by, also = dealt_by or ["idempotency_key"], [F.any_value("claim_ids").alias("claim_ids")] if dealt_by else []
    rows = found.withColumns({"_active": F.coalesce(F.col("status") == "active", F.lit(False)), "_there": F.col("subject").isNotNull() if dealt_by else F.lit(True)})
    # Claims are dealt by item once; what follows finds them where they are.
    rows = rows if dealt_by else rows.repartition("idempotency_key")
    order = Window.partitionBy(*by, "predicate", "_active").orderBy(F.col("observed_at").desc(), F.col("claim_id").asc_nulls_last())
    rows = rows.withColumn("_latest", F.col("_active") & (F.row_number().over(order) == 1))
    value = lambda p: F.max(F.when(F.col("_latest") & (F.col("predicate") == p), F.col("value")))
    each = {p: value(p) for p in ("hasPerformer", "hasPerformerName", "occursAt", "hasVenueName", *TEXTS)}
    first = {"proposed_claim_id": F.min_by(F.when(F.col("named"), F.col("claim_id")), F.when(F.col("named"), F.struct("observed_at", "claim_id")))} if "named" in found.columns else {}
    n_claims = F.count_if("_there").alias("n_claims")
    wide = rows.groupBy(*by).agg(F.max("observed_at").alias("last_observed"), n_claims, *also, *(v.alias(c) for c, v in {**each, **first}.items()))
    part = lambda p, key: present(F.get_json_object(p, f"$.{key}"))
    out = wide.select(
        "idempotency_key", "last_observed", "n_claims", F.coalesce(part("hasPerformer", "name"), present(F.col("hasPerformerName"))).alias("artist_name"), part("hasPerformer", "sourceNativeId").alias("artist_external_id"),
        part("hasPerformer", "location").alias("artist_location"), F.coalesce(part("occursAt", "name"), present(F.col("hasVenueName"))).alias("venue_name"),
        part("occursAt", "sourceNativeId").alias("venue_external_id"), part("occursAt", "location").alias("venue_location"), part("occursAt", "address").alias("venue_address"),
        *(present(F.col(p)).alias(c) for p, c in TEXTS.items()), *first, *(["claim_ids"] if dealt_by else []),
    )
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(shown)) for c, shown in REQUIRED.items()))), ", ")
    return out.withColumn("missing", missing)


def owner_managed(membership_id: str = "membership_id", verified: str = "verified_by_artist") -> Column:
    return (F.nullif(F.col(membership_id).cast("string"), F.lit("")).isNotNull()) | F.coalesce(F.col(verified), F.lit(False))


def find_by_external_id(keys: DataFrame, events: DataFrame) -> DataFrame:
    """(source_id, source_event_key, found_id): the event that carries the external id; of several the least id."""
    return keys.select("source_id", "source_event_key").distinct().join(dealt(_external_ids(events)), ["source_id", "source_event_key"])


def _external_ids(events: DataFrame) -> DataFrame:
    ids = events.select(F.col("id").alias("found_id"), F.explode("external_ids").alias("x"))
    return ids.groupBy(F.col("x.source").alias("source_id"), F.col("x.id").alias("source_event_key")).agg(F.min("found_id").alias("found_id"))


def _keyed(known: DataFrame) -> DataFrame:
    """(key, id) of known entities: of several of one key the least id."""
    return known.select(match_key(F.col("name")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))


def _of_keys(events: DataFrame) -> DataFrame:
    """(artist_id, venue_id, date, same): the event of these, of several the least id."""
    return events.groupBy("artist_id", "venue_id", "date").agg(F.min("id").alias("same"))


def resolve(names: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """(name, id, created) of each distinct name: the known entity of the same key (of several the least id), or a new one whose id the key gives."""
    asked = names.select("name").distinct().withColumn("key", match_key(F.col("name")))
    out = asked.join(dealt(_keyed(known)), "key", "left")
    return out.select("name", F.coalesce("id", identity(f"{kind}-", F.col("key"))).alias("id"), F.col("id").isNull().alias("created"))


def blocked_by_tombstone(candidates: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Candidates (artist_id, venue_id, date, authority) with tombstone (its status, or null) and blocked: an active one stops all but the strongest classes."""
    keys = ["artist_id", "venue_id", "date"]
    out = candidates.join(dealt(tombstones.select(*keys, F.col("status").alias("tombstone"))), keys, "left")
    gate = decide(out.withColumns({"owner_managed": F.lit(False), "tombstoned": F.coalesce(F.col("tombstone") == "active", F.lit(False)), "destructive": F.lit(False), "mutation": F.lit(True), "support": F.lit(None).cast("int"), "proposed": F.lit(0)}))
    return gate.withColumn("blocked", F.col("decision") == "tombstone").select(*candidates.columns, "tombstone", "blocked")


def ensure_events(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """(artist_id, venue_id, date, ensured_id, event_created): the event of the same artist, venue and date, or a new one whose id these give."""
    keys = ["artist_id", "venue_id", "date"]
    out = wanted.select(*keys).distinct().join(dealt(_of_keys(events)), keys, "left")
    return out.select(*keys, F.coalesce("same", identity("event-", *map(F.col, keys))).alias("ensured_id"), F.col("same").isNull().alias("event_created"))


def status_score(authority: Column) -> Column:
    """The score of a class for ``hasStatus``, by which projections are weighed."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in EVENT[1].items() for x in kv])[authority], base_scores()[authority])


def strongest_support(event_ids: DataFrame, world: World, now: Column) -> DataFrame:
    """(idempotency_key, support, support_authority): the strongest fresh active claim linked to the event, besides the proposed one.

    ``event_ids`` (idempotency_key, event_id, proposed_claim_id). Links to claims that aren't there are left out; a claim of an
    unknown source counts as a capture.
    """
    links = world.links.where("entity_type = 'event'").select(F.col("entity_id").alias("event_id"), "claim_id").distinct()
    claims = world.claims.select("claim_id", "source_id", "observed_at", "status")
    found = event_ids.join(dealt(links), "event_id").join(dealt(claims), "claim_id").join(world.sources.select("source_id", "authority"), "source_id", "left")
    found = found.withColumn("authority", F.coalesce("authority", F.lit("capture"))).withColumn("score", status_score(F.col("authority")))
    best = strongest(found.select("idempotency_key", "claim_id", "proposed_claim_id", "observed_at", "status", "authority", "score"), ["idempotency_key"], now)
    return best.select("idempotency_key", F.col("score").alias("support"), F.col("authority").alias("support_authority"))


OUTCOME = "idempotency_key source_id observation_id candidate_key action status message artist_id venue_id event_id artist_created venue_created event_created event_updated event_cancelled event_hidden reinstated protected n_claims".split()
_EMPTY = {
    "message": "string", "artist_id": "string", "venue_id": "string", "event_id": "string", "artist_created": "boolean", "venue_created": "boolean", "event_created": "boolean",
    "event_updated": "boolean", "event_cancelled": "boolean", "event_hidden": "boolean", "reinstated": "boolean", "protected": "boolean", "n_claims": "long",
}


def _outcome(df: DataFrame, status: str | Column, **columns: Column) -> DataFrame:
    """Rows of OUTCOME; what isn't given is false, 0 or null."""
    blank = {"boolean": F.lit(False), "long": F.lit(0).cast("long")}
    out = df.withColumns({"status": F.lit(status) if isinstance(status, str) else status, **columns})
    for name, kind in _EMPTY.items():
        if name not in columns:
            keep = name == "n_claims" and name in df.columns
            out = out if keep else out.withColumn(name, blank.get(kind, F.lit(None).cast(kind)))
    return out.select(*OUTCOME)


def project(items: DataFrame, world: World, now: Column, keep: Callable[[DataFrame], DataFrame] = kept, candidates: DataFrame | None = None) -> DataFrame:
    """One row of OUTCOME for each item (idempotency_key, source_id, observation_id, candidate_key, action, claim_ids).

    status is idempotent, exception, shadow or success. Items of one batch that need the same new artist, venue or event
    share its id; the least idempotency_key among them counts as its creator. ``keep`` stores a stage that several
    later ones read, in the folder that driver and executors share unless it is told otherwise. ``candidates`` are the items' ones
    (:func:`item_candidates`), if they are there already.
    """
    mapped = world.mappings.select("source_id", "candidate_key", F.col("artist_id").alias("was_artist"), F.col("venue_id").alias("was_venue"), F.col("event_id").alias("was_event"))
    done = world.ledger.where(F.col("status").isin("success", "shadow")).select("idempotency_key").distinct().withColumn("done", F.lit(True))
    # Mappings meet the items while these are narrow; ledger and candidates are both dealt by item.
    staged = items.join(dealt(mapped), ["source_id", "candidate_key"], "left").join(dealt(done), "idempotency_key", "left").join(world.sources, "source_id", "left")
    if candidates is None:
        staged = keep(staged)
        candidates = item_candidates(staged.where("done is null"), world.claims, keep, GATED)
    # What only the candidate's own tables need isn't carried through the gates, and of the claims' names only their number.
    staged = staged.withColumn("n_named", F.size("claim_ids").cast("long")).drop("claim_ids").join(dealt(candidates.select(*GATED)), "idempotency_key", "left")
    # A stop holds whatever its message names.
    stop = (
        F.when(F.col("authority").isNull(), F.concat(F.lit("Unknown source "), F.coalesce("source_id", F.lit("null")))).when(F.col("n_claims").isNull(), "Projection item has no readable Claims")
        .when(F.col("missing") != "", F.concat(F.lit("Projection candidate "), F.coalesce("candidate_key", F.lit("null")), F.lit(" missing "), F.col("missing")))
    )
    shadow = F.when(F.col("shadow"), "source is in shadow mode").when(~F.col("writer").eqNullSafe("aws"), F.concat(F.lit("writerAuthority="), F.coalesce("writer", F.lit("null"))))
    staged = keep(staged.withColumns({"stop": stop, "shadowed": shadow}).drop("missing", "shadow", "writer"))
    out, todo = _outcome(staged.where("done"), "idempotent", n_claims=F.lit(0).cast("long")), staged.where("done is null")
    out = out.unionByName(_outcome(todo.where("stop is not null"), "exception", message=F.col("stop"), n_claims=F.col("n_named")))
    out = out.unionByName(_outcome(todo.where("stop is null and shadowed is not null"), "shadow", message=F.col("shadowed"), artist_id=F.col("was_artist"), venue_id=F.col("was_venue"), event_id=F.col("was_event")))
    live = todo.where("stop is null and shadowed is null").drop("done", "stop", "shadowed")
    out = out.unionByName(_taken_back(live.where("action in ('cancel', 'withdraw')").drop("artist_name", "venue_name", "date"), world, now, keep))
    return out.unionByName(_put_forward(live.where("action not in ('cancel', 'withdraw')").drop("proposed_claim_id"), world, keep))


def _taken_back(items: DataFrame, world: World, now: Column, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cancellations and withdrawals: the event is found by mapping or external id, and its support weighed."""
    keyed = items.withColumn("source_event_key", without_prefix(F.col("candidate_key"), F.concat(F.lit("event:"), F.col("source_id"), F.lit(":"))))
    found = keyed.join(dealt(_external_ids(world.events)), ["source_id", "source_event_key"], "left").drop("source_event_key")
    found = found.withColumn("event_id", F.coalesce("was_event", "found_id")).drop("was_event", "found_id")
    event = world.events.select(F.col("id").alias("event_id"), F.lit(True).alias("there"), F.coalesce(F.nullif(F.col("artist_id"), F.lit("")), F.try_element_at("artist_ids", F.lit(1))).alias("its_artist"), F.col("venue_id").alias("its_venue"), owner_managed().alias("owner_managed"))
    found = found.join(dealt(event), "event_id", "left")
    found = keep(found)
    support = strongest_support(found.select("idempotency_key", "event_id", "proposed_claim_id"), world, now)
    found = found.join(dealt(support), "idempotency_key", "left").withColumns({"proposed": status_score(F.col("authority")), "tombstoned": F.lit(False), "destructive": F.lit(True), "mutation": F.lit(False), "owner_managed": F.coalesce("owner_managed", F.lit(False))})
    found = decide(found).withColumns({"new_artist": F.coalesce("its_artist", "was_artist"), "new_venue": F.coalesce(F.nullif(F.col("its_venue"), F.lit("")), F.col("was_venue"))})
    reason = (
        F.when(F.col("event_id").isNull(), "No canonical event mapping for destructive projection")
        .when(F.col("there").isNull(), F.concat(F.lit("Canonical event "), F.col("event_id"), F.lit(" no longer exists")))
        .when(F.col("decision") == "owner-managed", F.concat(F.lit("owner-managed event blocks "), F.col("authority"), F.lit(" mutation")))
        .when(F.col("decision") == "stronger-support", F.concat(F.lit("fresh higher-authority support ("), F.col("support_authority"), F.lit(") blocks destructive projection")))
        .when(F.col("new_artist").isNull() | F.col("new_venue").isNull(), "Canonical event is missing artistId/venueId")
    )
    cancel, gone = F.col("action") == "cancel", F.col("message").isNull()
    found = found.withColumn("message", reason)
    ids = {"artist_id": F.when(gone, F.col("new_artist")), "venue_id": F.when(gone, F.col("new_venue")), "event_id": F.when(gone, F.col("event_id"))}
    return _outcome(found, F.when(gone, "success").otherwise("exception"), message=F.col("message"), **ids, event_cancelled=gone & cancel, event_hidden=gone & ~cancel, n_claims=F.when(gone, F.col("n_claims")).otherwise(F.col("n_named")))


def _put_forward(items: DataFrame, world: World, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Creations, updates and reconciliations: entities are resolved, tombstones asked, the event ensured, its owner respected.

    Items meet each table themselves, the two that are keyed by artist, venue and date one after the other, so that they are dealt once a key.
    """
    event = world.events.select(F.col("id").alias("was_event"), F.lit(True).alias("there"))
    out = items.join(dealt(event), "was_event", "left")
    for kind, known in (("artist", world.artists), ("venue", world.venues)):
        out = out.withColumn("key", match_key(F.col(f"{kind}_name"))).drop(f"{kind}_name").join(dealt(_keyed(known).withColumnRenamed("id", "found")), "key", "left")
        new = F.col(f"was_{kind}").isNull() & F.col("found").isNull()
        out = out.withColumns({f"{kind}_id": F.coalesce(f"was_{kind}", "found", identity(f"{kind}-", F.col("key"))), f"new_{kind}": new}).drop("key", "found", f"was_{kind}")
    out = blocked_by_tombstone(out, world.tombstones)
    keys = ["artist_id", "venue_id", "date"]
    out = out.join(dealt(_of_keys(world.events)), keys, "left")
    known = F.col("there").isNotNull()
    ids = {"event_id": F.when(known, F.col("was_event")).otherwise(F.coalesce("same", identity("event-", *map(F.col, keys)))), "new_event": ~known & F.col("same").isNull()}
    out = out.withColumns(ids).drop("date", "was_event", "there", "same")
    owned = world.events.select(F.col("id").alias("event_id"), owner_managed().alias("owner_managed"))
    out = keep(out.join(dealt(owned), "event_id", "left").withColumn("owner_managed", F.coalesce("owner_managed", F.lit(False))))
    # Several items may need one new entity: one of them creates it, the others find it there.
    kinds = ("artist", "venue", "event")
    needs = F.array_compact(F.array(*(F.when(F.col(f"new_{kind}"), F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id"))) for kind in kinds)))
    first = out.where("not blocked").select("idempotency_key", F.inline(needs)).groupBy("kind", "id").agg(F.min("idempotency_key").alias("idempotency_key"))
    first = first.groupBy("idempotency_key").agg(*(F.max(F.col("kind") == kind).alias(f"makes_{kind}") for kind in kinds))
    out = out.join(dealt(first), "idempotency_key", "left").withColumns({f"new_{kind}": F.coalesce(f"makes_{kind}", F.lit(False)) for kind in kinds})
    changes = {"tombstoned": F.lit(False), "destructive": F.lit(False), "mutation": (F.col("action") == "update") | ~F.col("new_event"), "support": F.lit(None).cast("int"), "proposed": F.lit(0)}
    out = decide(out.withColumns(changes))
    stopped, allowed = F.col("blocked"), F.col("decision") == "allow"
    free = ~stopped & allowed
    why = F.when(stopped, "active tombstone requires explicit owner/artist/venue-owned reinstatement").when(~allowed, F.concat(F.lit("owner-managed event blocks "), F.col("authority"), F.lit(" mutation")))
    columns = {"message": why, "n_claims": F.when(stopped, F.col("n_named")).otherwise(F.col("n_claims")), "protected": ~stopped & ~allowed}
    columns |= {f"{kind}_id": F.when(~stopped, F.col(f"{kind}_id")) for kind in kinds}
    columns |= {f"{kind}_created": ~stopped & F.col(f"new_{kind}") for kind in ("artist", "venue")}
    columns |= {"event_created": free & F.col("new_event"), "event_updated": free & ~F.col("new_event") & (F.col("action") == "update"), "reinstated": free & F.coalesce(F.col("tombstone") == "active", F.lit(False))}
    return _outcome(out, F.when(stopped, "exception").otherwise("success"), **columns)


def _told(outcomes: DataFrame, candidates: DataFrame | None, how: str = "inner") -> DataFrame:
    """Outcomes with their candidates' columns; without ``candidates`` they have these already."""
    return outcomes if candidates is None else outcomes.join(dealt(candidates), "idempotency_key", how)


def tombstone_rows(outcomes: DataFrame, candidates: DataFrame | None, world: World, created_at: str) -> DataFrame:
    """New tombstones of cancelled and hidden events, where none of any status is there yet.

    ``candidates`` (idempotency_key, date, claim_id): the candidate's date and the claim that took the event back.
    """
    gone = _told(outcomes.where("status = 'success' and (event_cancelled or event_hidden)"), candidates)
    keys = ["artist_id", "venue_id", "date"]
    gone = gone.join(dealt(world.tombstones.select(*keys)), keys, "left_anti").join(world.sources.select("source_id", "authority"), "source_id")
    print_ = F.concat_ws("|", *keys)
    why = F.when(F.col("event_cancelled"), "explicit cancellation").otherwise("absent from complete snapshot")
    rows = gone.select(identity("tombstone-", print_).alias("id"), print_.alias("event_fingerprint"), F.col("event_id").alias("canonical_event_id"), *keys, F.lit("active").alias("status"), why.alias("reason"), F.col("authority").alias("authority_class"), "source_id", "claim_id", "observation_id", F.lit(created_at).alias("created_at"), "idempotency_key")
    return best_per_key(rows, ["id"], F.struct(F.lit(0)), F.col("idempotency_key")).drop("idempotency_key")


def reinstated(tombstones: DataFrame, outcomes: DataFrame, candidates: DataFrame | None, at: str, changed: bool = False) -> DataFrame:
    """``tombstones`` after the run: those that a strong source's event brought back are reinstated, none is deleted. With ``changed`` only these."""
    keys = ["artist_id", "venue_id", "date"]
    back = _told(outcomes.where("reinstated"), candidates).groupBy(*keys).agg(F.min("claim_id").alias("_claim"))
    out = tombstones.join(dealt(back.withColumn("_back", F.lit(True))), keys, "inner" if changed else "left")
    hit = F.coalesce(F.col("_back") & (F.col("status") == "active"), F.lit(False))
    out = out.where(hit) if changed else out
    return out.select(*keys, F.when(hit, "reinstated").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(at)).alias("superseded_at"), F.when(hit, F.col("_claim")).alias("superseded_by_claim_id"))


def prior_claims(found: DataFrame, items: DataFrame) -> DataFrame:
    """(idempotency_key, prior_claim_id): the newest claim of the item's own source, neither the proposed one nor about its status.

    ``items`` (idempotency_key, source_id, proposed_claim_id); of equal times the least claim_id.
    """
    rows = found.join(dealt(items.select("idempotency_key", "source_id", "proposed_claim_id")), "idempotency_key")
    rows = rows.where((F.col("claim_source") == F.col("source_id")) & ~F.col("claim_id").eqNullSafe(F.col("proposed_claim_id")) & (F.col("predicate") != "hasStatus"))
    best = best_per_key(rows.select("idempotency_key", "claim_id", "observed_at"), ["idempotency_key"], F.struct("observed_at"), F.col("claim_id"))
    return best.select("idempotency_key", F.col("claim_id").alias("prior_claim_id"))


def merged_mappings(mappings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``mappings`` after the run: each id is the resolved one, or else the one before. An exception leaves its mapping as it is."""
    keys, ids = ["source_id", "candidate_key"], ["artist_id", "venue_id", "event_id"]
    new = outcomes.where("status in ('success', 'shadow')")
    new = best_per_key(new.select(*keys, *ids, "idempotency_key"), keys, F.struct(F.lit(0)), F.col("idempotency_key")).select(*keys, *(F.col(c).alias(f"_{c}") for c in ids))
    return mappings.select(*keys, *ids).join(dealt(new), keys, "full_outer").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in ids))


def changed_mappings(mappings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The rows of :func:`merged_mappings` that the run's successes and shadows name; no other row is read further than its key."""
    keys, ids = ["source_id", "candidate_key"], ["artist_id", "venue_id", "event_id"]
    new = outcomes.where("status in ('success', 'shadow')")
    new = best_per_key(new.select(*keys, *ids, "idempotency_key"), keys, F.struct(F.lit(0)), F.col("idempotency_key"))
    old = mappings.select(*keys, *(F.col(c).alias(f"_{c}") for c in ids))
    return new.join(dealt(old), keys, "left").select(*keys, *(F.coalesce(c, f"_{c}").alias(c) for c in ids))


def support_links(outcomes: DataFrame, found: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(entity_type, entity_id, claim_id) that successful creations and updates add: all claims to the event, performer claims to the artist, place claims to the venue.

    Links are a set: those of ``links`` aren't added again.
    """
    put = outcomes.where("status = 'success' and action not in ('cancel', 'withdraw')").select("idempotency_key", "artist_id", "venue_id", "event_id")
    rows = put.join(dealt(found.select("idempotency_key", "claim_id", "predicate")), "idempotency_key")
    one = lambda kind, when: F.when(when, F.struct(F.lit(kind).alias("entity_type"), F.col(f"{kind}_id").alias("entity_id")))
    made = F.array_compact(F.array(one("event", F.lit(True)), one("artist", F.col("predicate").isin("hasPerformer", "hasPerformerName")), one("venue", F.col("predicate").isin("occursAt", "hasVenueName"))))
    out = rows.select("claim_id", F.inline(made)).select("entity_type", "entity_id", "claim_id").distinct()
    return out if links is None else out.join(dealt(links), ["entity_type", "entity_id", "claim_id"], "left_anti")


def merge_external_ids(existing: Column, source: Column, key: Column) -> Column:
    """The distinct well-formed (source, id) of a list, in order, and then the new one unless it is there."""
    good = F.filter(F.coalesce(existing, F.array().cast("array<struct<source:string,id:string>>")), lambda x: (F.nullif(x["source"], F.lit("")).isNotNull()) & (F.nullif(x["id"], F.lit("")).isNotNull()))
    return F.array_distinct(F.concat(good, F.array(F.struct(source.alias("source"), key.alias("id")))))


def update_payload(existing: Column) -> list[Column]:
    """What an update sets, from a candidate's columns: five fields always, six where the candidate has them (else null, that is unset)."""
    paid = F.when(F.nullif(F.col("admission_status"), F.lit("")).isNotNull(), F.col("admission_status") == "PAID_CONFIRMED")
    optional = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("end_time", "title", "event_url", "ticket_url", "price")]
    ids = merge_external_ids(existing, F.col("source_id"), F.col("source_event_key"))
    return [F.col("artist_id"), F.col("venue_id"), F.col("date"), F.col("start_time"), ids.alias("external_ids"), *optional, paid.alias("ticketed")]


def new_entities(outcomes: DataFrame, candidates: DataFrame | None, kind: str) -> DataFrame:
    """The artists or venues that a run creates: id, name, where they are, and the source's id for them (by name, if it has none)."""
    made = _told(outcomes.where(f"status = 'success' and {kind}_created"), candidates).withColumn("id", F.col(f"{kind}_id"))
    name = F.lower(F.col(f"{kind}_name"))
    if kind == "artist":
        own, where = F.concat(F.lit("name:"), name), {"location": F.coalesce("artist_location", "venue_location"), "region": F.col("venue_location")}
    else:
        own, where = F.concat(F.lit("name:"), name, F.lit(":"), F.lower("venue_location")), {"city": F.col("venue_location"), "address": F.col("venue_address")}
    external = F.array(F.struct(F.col("source_id").alias("source"), F.coalesce(f"{kind}_external_id", own).alias("id")))
    return made.select("id", F.col(f"{kind}_name").alias("name"), *(c.alias(n) for n, c in where.items()), external.alias("external_ids"))


#: What an event has besides its ids; an update leaves unset what its candidate lacks.
EVENT_TEXTS = ("date", "start_time", "end_time", "title", "event_url", "ticket_url", "price")


def changed_events(outcomes: DataFrame, candidates: DataFrame | None, events: DataFrame) -> DataFrame:
    """The events that a run creates, updates, cancels, hides or brings back, whole, one row each.

    Items of one event count in the order of their keys: a later one's value stands, and what it leaves unset stays. ``events`` may
    lack columns, which are null then.
    """
    touched = outcomes.where("status = 'success' and (event_created or event_updated or event_cancelled or event_hidden or reinstated)")
    rows = _told(touched, None if candidates is None else candidates.drop("n_claims", "status"), "left").withColumn("source_event_key", without_prefix(F.col("candidate_key"), F.concat(F.lit("event:"), F.col("source_id"), F.lit(":"))))
    put = F.col("event_created") | F.col("event_updated")
    paid = F.when(F.nullif(F.col("admission_status"), F.lit("")).isNotNull(), F.col("admission_status") == "PAID_CONFIRMED")
    value = {"artist_id": F.col("artist_id"), "venue_id": F.col("venue_id"), **{c: F.nullif(F.col(c), F.lit("")) for c in EVENT_TEXTS}, "ticketed": paid}
    value = {c: F.when(put, v) for c, v in value.items()}
    value["cancelled"] = F.when(F.col("event_cancelled"), F.lit(True)).when(F.col("reinstated"), F.lit(False))
    value["is_public"] = F.when(F.col("event_hidden"), F.lit(False)).when(F.col("reinstated"), F.lit(True))
    last = lambda c, v: F.max_by(v, F.when(v.isNotNull(), F.col("idempotency_key"))).alias(f"_{c}")
    ids = F.sort_array(F.collect_set(F.when(put, F.struct("idempotency_key", F.struct(F.col("source_id").alias("source"), F.col("source_event_key").alias("id")).alias("x")))))
    new = rows.groupBy(F.col("event_id").alias("id")).agg(*(last(c, v) for c, v in value.items()), ids.alias("_ids"))
    kinds = {"cancelled": "boolean", "is_public": "boolean", "ticketed": "boolean", "verified_by_artist": "boolean", "artist_ids": "array<string>", "external_ids": "array<struct<source:string,id:string>>"}
    columns = ("artist_id", "artist_ids", "venue_id", *EVENT_TEXTS, "ticketed", "cancelled", "is_public", "membership_id", "verified_by_artist", "external_ids")
    old = events.select("id", *(F.col(c) if c in events.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in columns))
    both = new.join(dealt(old), "id", "left")
    merged = F.array_distinct(F.concat(F.coalesce("external_ids", F.array().cast(kinds["external_ids"])), F.transform("_ids", lambda x: x["x"])))
    found = {c: F.coalesce(f"_{c}", c) for c in value} | {"cancelled": F.coalesce("_cancelled", "cancelled", F.lit(False)), "is_public": F.coalesce("_is_public", "is_public", F.lit(True)), "external_ids": merged}
    return both.select("id", *(found.get(c, F.col(c)).alias(c) for c in columns))


def withdrawals(outcomes: DataFrame, priors: DataFrame, at: str) -> DataFrame:
    """(id, source_id, observation_id, prior_claim_id, source_event_key, reason, created_at) of hidden events whose source had said something before."""
    gone = outcomes.where("status = 'success' and event_hidden").join(dealt(priors), "idempotency_key")
    key = without_prefix(F.col("candidate_key"), F.concat(F.lit("event:"), F.col("source_id"), F.lit(":")))
    return gone.select(identity("withdrawal-", F.col("idempotency_key")).alias("id"), "source_id", "observation_id", "prior_claim_id", key.alias("source_event_key"), F.lit("absent-from-complete-snapshot").alias("reason"), F.lit(at).alias("created_at"))


def verified(outcomes: DataFrame, candidates: DataFrame, events: DataFrame) -> DataFrame:
    """(idempotency_key, problem) of written events that don't read back as they should: missing, or another date, venue or artist."""
    wrote = outcomes.where("status = 'success' and not protected and not event_cancelled and not event_hidden").join(dealt(candidates.select("idempotency_key", F.col("date").alias("_date"))), "idempotency_key")
    read = events.select(F.col("id").alias("event_id"), F.col("date"), F.col("venue_id").alias("_venue"), F.col("artist_id").alias("_artist"), "artist_ids", F.lit(True).alias("_there"))
    rows = wrote.join(dealt(read), "event_id", "left")
    artist = F.col("_artist").eqNullSafe(F.col("artist_id")) | F.coalesce(F.array_contains("artist_ids", F.col("artist_id")), F.lit(False))
    problem = F.when(F.col("_there").isNull(), "missing").when(~F.col("date").eqNullSafe(F.col("_date")), "date mismatch").when(~F.col("_venue").eqNullSafe(F.col("venue_id")), "venue mismatch").when(~artist, "artist mismatch")
    return rows.select("idempotency_key", problem.alias("problem")).where("problem is not null")


def exceptions(outcomes: DataFrame, created_at: str) -> DataFrame:
    """One open exception for each item that ended as one; its id is its item's. Such items are complete and not tried again."""
    return outcomes.where("status = 'exception'").select(identity("projection-exception-", F.col("idempotency_key")).alias("id"), "idempotency_key", F.col("message").alias("reason"), F.lit(created_at).alias("created_at"))


def ledger_rows(outcomes: DataFrame) -> DataFrame:
    """(idempotency_key, status) to add to the ledger: exceptions count as done."""
    return outcomes.where("status <> 'idempotent'").select("idempotency_key", F.when(F.col("status") == "shadow", "shadow").otherwise("success").alias("status"))


def enrichment_items(outcomes: DataFrame) -> DataFrame:
    """(id, entity_type, entity_id, source_id, observation_id) of each newly created artist and venue."""
    made = outcomes.where("status = 'success'")
    pick = lambda kind: made.where(f"{kind}_created").select(F.lit(kind).alias("entity_type"), F.col(f"{kind}_id").alias("entity_id"), "source_id", "observation_id")
    rows = pick("artist").unionByName(pick("venue"))
    return rows.withColumn("id", identity("enrich-", F.col("entity_type"), F.col("entity_id"), F.col("source_id"), F.col("observation_id")))


def run_items(outcomes: DataFrame) -> DataFrame:
    """The counters of each item, for :func:`claimspark.operators.reconcile.run_summary`."""
    one = lambda c: c.cast("long")
    put = (F.col("status") == "success") & ~F.col("action").isin("cancel", "withdraw")
    return outcomes.where("status <> 'idempotent'").select(
        "observation_id", "idempotency_key", F.col("n_claims").alias("claims"), one(F.col("artist_created")).alias("artists_created"), one(put & ~F.col("artist_created")).alias("artists_matched"),
        one(F.col("venue_created")).alias("venues_created"), one(put & ~F.col("venue_created")).alias("venues_matched"), one(F.col("event_created")).alias("events_created"),
        one(F.col("event_updated")).alias("events_updated"), one(F.col("event_cancelled")).alias("events_cancelled"), F.lit(0).cast("long").alias("projection_failures"),
    )
