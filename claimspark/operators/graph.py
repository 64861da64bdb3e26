"""The knowledge graph: nodes and edges of sources, observations, candidates and canonical entities, with their claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.text import safe_segment

NODE = "id string, type string, label string, data map<string,string>, seq int"


def _id(x: Column) -> Column:
    return safe_segment(x, "A-Za-z0-9_.:-")


def _node(rows: DataFrame, seq: int, node: Column, kind: str, label: Column, **data: Column) -> DataFrame:
    """Nodes of one kind; ``seq`` orders the kinds, later data overlays earlier."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in data.items()))
    there = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return rows.select(node.alias("id"), F.lit(kind).alias("type"), label.alias("label"), there.alias("data"), F.lit(seq).alias("seq")).where("id is not null")


def _edge(rows: DataFrame, source: Column, target: Column, label: str, key: Column | None = None) -> DataFrame:
    made = key if key is not None else F.concat(F.lit("edge:"), _id(source), F.lit(":"), _id(target))
    return rows.select(made.alias("id"), source.alias("source"), target.alias("target"), F.lit(label).alias("label"))


def nodes(*parts: DataFrame) -> DataFrame:
    """One row for each id: the first one's type and label, and all data, of each key the last one's value.

    Rows are dealt by id once and sorted only there, so that a task holds its share alone; callers combine much named nodes before.
    """
    rows = reduce(DataFrame.unionByName, parts).repartition("id")
    first = rows.groupBy("id").agg(F.min(F.struct("seq", "type", "label")).alias("_first"))
    keys = rows.select("id", "seq", F.explode("data").alias("key", "value")).groupBy("id", "key").agg(F.max(F.struct("seq", "value")).alias("_last"))
    data = keys.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", F.col("_last.value").alias("value"))))).alias("data"))
    return first.join(data, "id", "left").select("id", "_first.type", "_first.label", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"))


def edges(*parts: DataFrame) -> DataFrame:
    """One row for each id; equal ids of other ends: the greatest. Rows are dealt as in :func:`nodes`."""
    rows = reduce(DataFrame.unionByName, parts).repartition("id")
    return rows.groupBy("id").agg(F.max(F.struct("source", "target", "label")).alias("_e")).select("id", "_e.*")


def observed(observations: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of observations (source_id, observation_id, observed_at) and their events.

    ``events`` (observation_id, candidate_key, source_event_key, artist_external_id, artist_name, venue_external_id, venue_name, date,
    start_time): source observed observation, which asserts the event candidate, which has a performer and occurs at a place.
    """
    source, observation = F.concat(F.lit("source:"), F.col("source_id")), F.concat(F.lit("observation:"), F.col("observation_id"))
    artist, venue = F.concat(F.lit("artist:"), F.col("artist_external_id")), F.concat(F.lit("venue:"), F.col("venue_external_id"))
    event, title = F.col("candidate_key"), F.concat(F.col("artist_name"), F.lit(" @ "), F.col("venue_name"))
    # Artists and venues are much named: each once, before a node is made of it.
    artists, venues = (events.select(f"{k}_external_id", f"{k}_name").distinct() for k in ("artist", "venue"))
    made = nodes(
        _node(observations, 0, source, "source", F.col("source_id"), sourceId=F.col("source_id")),
        _node(observations, 1, observation, "observation", F.concat(F.lit("Observation "), F.substring("observed_at", 1, 19)), observationId=F.col("observation_id"), observedAt=F.col("observed_at")),
        _node(artists, 2, artist, "artist-candidate", F.col("artist_name"), externalId=F.col("artist_external_id")), _node(venues, 3, venue, "venue-candidate", F.col("venue_name"), externalId=F.col("venue_external_id")),
        _node(events, 4, event, "event-candidate", title, date=F.col("date"), startTime=F.col("start_time"), sourceEventKey=F.col("source_event_key")),
    )
    links = edges(_edge(observations, source, observation, "observed"), _edge(events, observation, event, "asserts"), _edge(events, event, artist, "hasPerformer"), _edge(events, event, venue, "occursAt"))
    return made, links


def resolved(events: DataFrame, projections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of canonical entities: candidates resolve to them, events project to theirs, which have performer and place.

    ``projections`` (source_event_key, artist_id, venue_id, event_id); those of unknown events are left out.
    """
    rows = events.join(projections, "source_event_key")
    canonical = {k: F.concat(F.lit(f"canonical-{k}:"), F.col(f"{k}_id")) for k in ("artist", "venue", "event")}
    artist, venue = F.concat(F.lit("artist:"), F.col("artist_external_id")), F.concat(F.lit("venue:"), F.col("venue_external_id"))
    title = F.concat(F.col("artist_name"), F.lit(" @ "), F.col("venue_name"))
    labels = {"artist": F.col("artist_name"), "venue": F.col("venue_name"), "event": title}
    named = {"artist": rows.select("artist_id", "artist_name").distinct(), "venue": rows.select("venue_id", "venue_name").distinct(), "event": rows}
    made = nodes(*(_node(named[k], 5, canonical[k], k, labels[k], canonicalId=F.col(f"{k}_id")) for k in canonical))
    pairs = {k: rows.select(f"{k}_external_id", f"{k}_id").distinct() for k in ("artist", "venue")} | {"event": rows}
    to = lambda a, k, label: _edge(pairs[k], a, canonical[k], label, F.concat(F.lit("resolve:"), _id(a), F.lit(":"), F.col(f"{k}_id")))
    of = lambda k, label: _edge(rows, canonical["event"], canonical[k], label, F.concat(F.lit("canonical:"), F.col("event_id"), F.lit(f":{k}")))
    links = edges(to(artist, "artist", "resolvesTo"), to(venue, "venue", "resolvesTo"), to(F.col("candidate_key"), "event", "projectsTo"), of("artist", "performer"), of("venue", "venue"))
    return made, links


def with_claims(made: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes with claims, the list of those about them (claim_id, subject, predicate, value) in the order of their ids; other claims are left out."""
    # Claims about no node go before they are gathered: a list of all of them, for nothing, would be one task's.
    about = claims.join(made.select(F.col("id").alias("subject")).hint("merge"), "subject", "left_semi")
    listed = about.groupBy(F.col("subject").alias("id")).agg(F.sort_array(F.collect_list(F.struct("claim_id", "predicate", "value"))).alias("claims"))
    return made.join(listed, "id", "left")
