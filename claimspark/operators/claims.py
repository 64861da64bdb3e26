"""Claims: subject, predicate and value, one row each; the latest of each predicate; candidates; authority."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.text import identity, json_string, present
from claimspark.functions.times import fresh
from claimspark.operators.reconcile import best_per_key

# Authority classes and their scores, and the predicates for which some classes score otherwise.
BASE_SCORE = {"owner": 100, "artist-owned": 90, "venue-owned": 90, "official-ticket": 80, "curated": 65, "aggregator": 45, "capture": 35}
ARTIST = ("hasName hasNameVariant hasFacebookUrl hasWebsiteUrl hasInstagramUrl hasLocation hasArtistType hasActType hasGenre hasBio".split(), {"artist-owned": 100, "venue-owned": 50, "official-ticket": 55})
VENUE = ("hasAddress hasGooglePlaceId locatedIn".split(), {"venue-owned": 100, "artist-owned": 55, "official-ticket": 65})
EVENT = ("hasPerformer hasPerformerName occursAt hasVenueName occursOn startsAt endsAt hasTitle hasAdmissionStatus hasPrice hasTicketUrl hasEventUrl hasStatus performsAt".split(), {"venue-owned": 95, "artist-owned": 92, "official-ticket": 88})


#: Predicates of an event's plain columns, in the order in which claims are made.
PLAIN = {
    "occursOn": "date", "startsAt": "start_time", "endsAt": "end_time", "hasTitle": "title", "hasEventUrl": "event_url", "hasTicketUrl": "ticket_url",
    "hasAdmissionStatus": "admission_status", "hasPrice": "price", "hasStatus": "status",
}


def claim_id(observation: Column, subject: Column, predicate: Column, json: Column) -> Column:
    return identity("claim-", observation, subject, predicate, json)


def explode_claims(rows: DataFrame, observation: Column, subject: Column, values: dict[str, Column], keep: list[str] = [], fallback: Column | None = None) -> DataFrame:  # noqa: B006
    """A claim for each predicate whose value is present; blank values claim nothing.

    A row without any gets one claim ``derivedFrom`` of the value ``fallback``, if that is given. The id is made of the
    value as JSON writes it.
    """
    made = F.filter(F.array(*(F.struct(F.lit(p).alias("predicate"), present(v.cast("string")).alias("value")) for p, v in values.items())), lambda c: c["value"].isNotNull())
    if fallback is not None:
        made = F.when(F.size(made) == 0, F.array(F.struct(F.lit("derivedFrom").alias("predicate"), fallback.cast("string").alias("value")))).otherwise(made)
    out = rows.select(observation.alias("observation"), subject.alias("subject"), *keep, F.inline(made))
    return out.withColumn("claim_id", claim_id(F.col("observation"), F.col("subject"), F.col("predicate"), json_string(F.col("value"))))


def _named(name: str, **fields: Column) -> Column:
    """A JSON object of a name and what else is there; null without name."""
    parts = [F.col(name).alias("name"), *(F.nullif(c, F.lit("")).alias(k) for k, c in fields.items())]
    return F.when(F.nullif(F.col(name), F.lit("")).isNotNull(), F.to_json(F.struct(*parts)))


def event_claims(events: DataFrame, source: str, observation: Column, observed_at: Column) -> DataFrame:
    """Claims of events (source_event_key, artist_*, venue_*, date, ...): two for a performer, two for a place, one for each plain column.

    (claim_id, observation_id, source_id, subject, predicate, value, is_object, confidence, evidence, observed_at, status). Null and
    empty values claim nothing; an event without any claims its own key (``derivedFrom``). The objects of performer and place
    have their keys in a fixed order and leave out what is missing.
    """
    performer = _named("artist_name", sourceNativeId=F.col("artist_external_id"), location=F.col("artist_location"))
    place = _named("venue_name", sourceNativeId=F.col("venue_external_id"), location=F.col("venue_location"), address=F.col("venue_address"))
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    row = lambda p, v, json: F.struct(F.lit(p).alias("predicate"), v.alias("value"), F.lit(json).alias("is_object"))
    made = [row("hasPerformerName", full("artist_name"), False), row("hasPerformer", performer, True), row("hasVenueName", full("venue_name"), False), row("occursAt", place, True)]
    made = F.filter(F.array(*made, *(row(p, full(c), False) for p, c in PLAIN.items())), lambda c: c["value"].isNotNull())
    made = F.when(F.size(made) == 0, F.array(row("derivedFrom", F.col("source_event_key"), False))).otherwise(made)
    subject = F.concat(F.lit(f"event:{source}:"), F.col("source_event_key"))
    evidence = F.struct(F.col("source_event_key").alias("raw_item_id"), F.col("content_hash"))
    out = events.select(observation.alias("observation_id"), F.lit(source).alias("source_id"), subject.alias("subject"), evidence.alias("evidence"), observed_at.alias("observed_at"), F.inline(made))
    json = F.when(F.col("is_object"), F.col("value")).otherwise(json_string(F.col("value")))
    out = out.withColumn("claim_id", claim_id(F.col("observation_id"), F.col("subject"), F.col("predicate"), json))
    return out.withColumns({"confidence": F.lit(1.0), "status": F.lit("active")})


def candidates(claims: DataFrame) -> DataFrame:
    """(subject, supporting_claim_ids) of each subject: the ids of its claims, in order."""
    return claims.groupBy("subject").agg(F.sort_array(F.collect_set("claim_id")).alias("supporting_claim_ids"))


def latest_claims(claims: DataFrame, at: str, tie: str) -> DataFrame:
    """The newest active claim of each subject and predicate (all, if there is no column status); of equal times the first by ``tie``."""
    claims = claims.where("status = 'active'") if "status" in claims.columns else claims
    return best_per_key(claims, ["subject", "predicate"], F.struct(F.col(at)), F.col(tie))


def pivot_claims(latest: DataFrame, predicates: list[str]) -> DataFrame:
    """One row a subject with a column for each predicate; the list of predicates is fixed, so no extra pass finds it."""
    return latest.groupBy("subject").agg(*(F.max(F.when(F.col("predicate") == p, F.col("value"))).alias(p) for p in predicates))


def missing_fields(names: Iterable[str]) -> Column:
    """Names of the columns that are null or blank, joined by commas; empty if all are there."""
    return F.array_join(F.array_compact(F.array(*(F.when(present(F.col(n).cast("string")).isNull(), F.lit(n)) for n in names))), ",")


def authority_scores(spark: SparkSession) -> DataFrame:
    """(predicate, authority, score) of every predicate and class: a small fixed table."""
    rows = [(p, a, over.get(a, base)) for group, over in (ARTIST, VENUE, EVENT) for p in group for a, base in BASE_SCORE.items()]
    return spark.createDataFrame(rows, "predicate string, authority string, score int")


def base_scores() -> Column:
    return F.create_map(*[F.lit(x) for kv in BASE_SCORE.items() for x in kv])


def with_authority(claims: DataFrame, sources: DataFrame, scores: DataFrame) -> DataFrame:
    """Claims with the score of their source's class; an unknown source counts as capture, an unknown predicate by class."""
    base = base_scores()
    out = claims.join(sources, "source", "left").withColumn("authority", F.coalesce("authority", F.lit("capture")))
    return out.join(scores, ["predicate", "authority"], "left").withColumn("score", F.coalesce("score", base[F.col("authority")]))


def strongest(claims: DataFrame, by: list[str], now: Column | None = None, days: int = 30) -> DataFrame:
    """The claim of highest score of each group, of equal ones the first by claim_id.

    With ``now`` only active claims (status) count that were observed (observed_at) at most ``days`` before it and aren't
    the proposed one (proposed_claim_id).
    """
    if now is not None:
        claims = claims.where((F.col("status") == "active") & fresh(F.col("observed_at"), now, days) & ~F.col("claim_id").eqNullSafe(F.col("proposed_claim_id")))
    return best_per_key(claims, by, F.struct(F.col("score")), F.col("claim_id"))


#: Classes that may change an owner's event, and those that may bring back a buried one.
OWNERS, REINSTATING = ("owner", "artist-owned"), ("owner", "artist-owned", "venue-owned")


def decide(proposals: DataFrame) -> DataFrame:
    """``proposals`` with decision, by the first gate that shuts: owner-managed, tombstone, stronger-support; else allow.

    Columns: authority and proposed (its score), support (the strongest fresh score, if any), owner_managed, tombstoned,
    destructive, mutation.
    """
    owner = F.col("owner_managed") & (F.col("mutation") | F.col("destructive")) & ~F.col("authority").isin(*OWNERS)
    grave = F.col("tombstoned") & ~F.col("destructive") & ~F.col("authority").isin(*REINSTATING)
    strong = F.col("destructive") & F.coalesce(F.col("support") > F.col("proposed"), F.lit(False))
    return proposals.withColumn("decision", F.when(owner, "owner-managed").when(grave, "tombstone").when(strong, "stronger-support").otherwise("allow"))
