"""Captures: which are taken up, what becomes of them, and what a share link resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import text
from claimspark.operators.assess import capture_dedupe


def unprocessed(captures: DataFrame, most: int) -> DataFrame:
    """At most ``most`` (between 1 and 100) captures of status unprocessed, the newest first.

    The newest by received_at, or else captured_at, or else none; of equal times the greatest id.
    """
    return captures.where("status = 'unprocessed'").orderBy(newest_first(), F.col("id").desc()).limit(min(max(most, 1), 100))


def newest_first() -> Column:
    return F.coalesce("received_at", "captured_at", F.lit("")).desc()


def stored_image(mime: Column, media_type: Column, bucket: Column, key: Column, old_bucket: Column, old_key: Column) -> Column:
    """Where an image capture's object lies: its media, or else the place an older client named; null for other captures."""
    full = lambda x: text.present(x).isNotNull()
    at = lambda b, k: F.concat(F.lit("s3://"), b, F.lit("/"), k)
    found = F.when((media_type == "image") & full(bucket) & full(key), at(bucket, key)).when((F.nullif(old_bucket, F.lit("")).isNotNull()) & (F.nullif(old_key, F.lit("")).isNotNull()), at(old_bucket, old_key))
    return F.when(F.startswith(mime, F.lit("image/")), found)


def identity_of(url: Column, image: Column) -> Column:
    """``url:`` and the canonical address, or else ``image:`` and the object; null without either."""
    address = F.nullif(text.canonical_url(url), F.lit(""))
    return F.coalesce(F.concat(F.lit("url:"), address), F.concat(F.lit("image:"), image))


def scan(captures: DataFrame) -> DataFrame:
    """``captures`` (id, source_app, shared_url, image, received_at, captured_at, claimed) with identity, duplicate_of and outcome.

    ignored: manual tests. failed: no identity. duplicate: an older one of an identity in the batch. queued: those whose lease was
    claimed; skipped: the others. Only captures that get that far are held against each other.
    """
    rows = captures.withColumn("identity", identity_of(F.col("shared_url"), F.col("image")))
    test = F.coalesce(F.col("source_app") == "manual-test", F.lit(False))
    newest = F.coalesce("received_at", "captured_at", F.lit(""))
    out = capture_dedupe(rows.drop("identity"), F.when(~test, identity_of(F.col("shared_url"), F.col("image"))), newest)
    outcome = (
        F.when(test, "ignored").when(F.col("identity").isNull(), "failed").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("claimed"), "queued").otherwise("skipped")
    )
    return out.withColumn("outcome", outcome)


#: What a capture's artist needs before it may be created: column and shown name.
ARTIST_FIELDS = (("name", "name"), ("facebook_url", "facebookUrl"), ("location", "location"), ("artist_type", "artistType"))


def missing_artist_fields() -> Column:
    """Names of what an artist (name, facebook_url, location, artist_type, act_types) lacks, comma-joined; ``artist`` if there is none."""
    parts = [F.when(text.present(F.col(c)).isNull(), F.lit(shown)) for c, shown in ARTIST_FIELDS]
    acts = F.when(F.size(F.coalesce("act_types", F.array().cast("array<string>"))) == 0, F.lit("actType"))
    return F.when(~F.col("has_artist"), "artist").otherwise(F.array_join(F.array_compact(F.array(*parts, acts)), ", "))


def processed(discoveries: DataFrame) -> DataFrame:
    """``discoveries`` with outcome (skipped, ignored, review, retry, processed) and new_status by the first rule that fits.

    Columns: status, classification, has_artist, the artist's fields, n_events, cancelled and start_time of the first event,
    resolver (matched, duplicate, created, review or none). skipped and retry leave the status as it is.
    """
    one = F.col("classification") == "event"
    missing = missing_artist_fields()
    outcome = (
        F.when(~F.col("status").isin("processing", "unprocessed"), "skipped").when(F.col("classification") == "non_music", "ignored")
        .when(~F.col("classification").isin("artist", "event") | ~F.col("has_artist"), "review").when(one & (F.col("n_events") != 1), "review")
        .when(one & ~F.coalesce("cancelled", F.lit(False)) & F.nullif(F.col("start_time"), F.lit("")).isNull(), "retry").when(missing != "", "review")
        .when(F.col("resolver").isin("review", "none"), "review").otherwise("processed")
    )
    out = discoveries.withColumns({"missing": missing, "outcome": outcome})
    status = F.when(F.col("outcome") == "ignored", "ignored").when(F.col("outcome") == "review", "failed").when(F.col("outcome") == "processed", "processed").otherwise(F.col("status"))
    return out.withColumn("new_status", status)


def publishable(cancelled: Column) -> Column:
    """Only cancelled events are held back; admission is no gate here."""
    return ~F.coalesce(cancelled, F.lit(False))


def ticketed(flag: Column, ticket_url: Column) -> Column:
    """A capture's event has tickets if it says so or names where they are."""
    return F.coalesce(flag, F.lit(False)) | F.nullif(ticket_url, F.lit("")).isNotNull()


def resolved_share(url: Column, resolved: Column) -> Column:
    """The address that is looked at: a share link's resolved event or page, all others as they are."""
    kind = text.target_kind(url)
    return F.when((kind == "facebook_share") & (text.refined_kind(kind, resolved) != kind), F.trim(resolved)).otherwise(url)


def with_canonical_url(urls: Column, url: Column) -> Column:
    """The list with the event's own address first, unless it is there."""
    return F.when(F.contains(url, F.lit("facebook.com/events/")) & ~F.array_contains(urls, url), F.concat(F.array(url), urls)).otherwise(urls)


def readiness(discoveries: DataFrame) -> DataFrame:
    """``discoveries`` with exact (one event), missing (artist.* and event.* fields, comma-joined) and ready.

    Columns as of :func:`processed`, and event_artist, venue_name, town, date of the first event.
    """
    artist = [F.when(F.nullif(F.col(c), F.lit("")).isNull(), F.lit(f"artist.{shown}")) for c, shown in ARTIST_FIELDS]
    artist.append(F.when(F.size(F.coalesce("act_types", F.array().cast("array<string>"))) == 0, F.lit("artist.actTypes")))
    event = [F.when(F.nullif(F.col(c), F.lit("")).isNull(), F.lit(f"event.{shown}")) for c, shown in (("event_artist", "artistName"), ("venue_name", "venueName"), ("town", "town"), ("date", "date"), ("start_time", "startTime"))]
    exact = (F.col("classification") == "event") & (F.col("n_events") == 1)
    out = discoveries.withColumns({"exact": exact, "missing": F.array_join(F.array_compact(F.array(*artist, *event)), ", ")})
    return out.withColumn("ready", F.col("exact") & (F.col("missing") == "") & publishable(F.col("cancelled")))
