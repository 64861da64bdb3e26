"""Queries of the projection: candidates, gates, outcomes, links and the graph, bound to orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators import access, claims, graph, projection, reconcile
from claimspark.plans.registry import listed, load, pick, query, text
from claimspark.sources import sinks
from claimspark.sources.shared import kept, shared_folder
from claimspark.sources.store import Store

CLASSES = list(claims.BASE_SCORE)
STRONG = "('owner', 'artist-owned', 'venue-owned')"
ACTIONS = ["create", "update", "cancel", "withdraw", "reconcile"]
NOW = "2026-08-01 00:00:00"
#: Scores of the classes for an event's status, as fixed in the survey's table.
STATUS_SCORE = "CASE {a} WHEN 'owner' THEN 100 WHEN 'artist-owned' THEN 92 WHEN 'venue-owned' THEN 95 WHEN 'official-ticket' THEN 88 WHEN 'curated' THEN 65 WHEN 'aggregator' THEN 45 ELSE 35 END"


@query(f"""WITH c AS (SELECT o_orderkey AS item, o_custkey AS artist, o_orderstatus AS venue, o_orderdate::DATE AS d, ({listed(CLASSES)})[1 + o_orderkey % 7] AS authority FROM orders),
    t AS (SELECT o_custkey AS artist, o_orderstatus AS venue, o_orderdate::DATE AS d, min(CASE WHEN o_orderkey % 4 = 0 THEN 'reinstated' ELSE 'active' END) AS status FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL)
    SELECT item, status AS tombstone, coalesce(status = 'active' AND authority NOT IN {STRONG}, false) AS blocked FROM c LEFT JOIN t USING (artist, venue, d)""")
def tombstone_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    keys = [F.col("o_custkey").alias("artist_id"), F.col("o_orderstatus").alias("venue_id"), F.to_date("o_orderdate").alias("date")]
    rows = orders.select(F.col("o_orderkey").alias("item"), *keys, pick(CLASSES, F.col("o_orderkey") % 7).alias("authority"))
    graves = orders.where("o_orderkey % 5 = 0").select(*keys, F.when(F.col("o_orderkey") % 4 == 0, "reinstated").otherwise("active").alias("status"))
    graves = graves.groupBy("artist_id", "venue_id", "date").agg(F.min("status").alias("status"))
    return projection.blocked_by_tombstone(rows, graves).select("item", "tombstone", "blocked")


@query("""WITH i AS (SELECT c_custkey AS k FROM customer), c AS (SELECT 'k' || o_orderkey AS id, CASE WHEN o_custkey % 3 <> 0 THEN 'c' || o_custkey ELSE 'none' END AS subject FROM orders),
    mine AS (SELECT DISTINCT k, id FROM i JOIN c ON subject = 'c' || k), named AS (SELECT DISTINCT k, id FROM i JOIN c ON id IN ('k' || k * 4, 'k' || k * 4 + 1) WHERE k NOT IN (SELECT k FROM mine))
    SELECT 'i' || k AS idempotency_key, id AS claim_id FROM mine UNION ALL SELECT 'i' || k, id FROM named""".replace("'k' || k * 4 + 1", "'k' || (k * 4 + 1)").replace("'k' || k * 4,", "'k' || (k * 4),"))
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    items = load(spark, sf_dir, "customer").select(text("i", k).alias("idempotency_key"), text("c", k).alias("candidate_key"), F.array(text("k", k * 4), text("k", k * 4 + 1)).alias("claim_ids"))
    made = load(spark, sf_dir, "orders").select(text("k", F.col("o_orderkey")).alias("claim_id"), F.when(F.col("o_custkey") % 3 != 0, text("c", F.col("o_custkey"))).otherwise("none").alias("subject"), F.lit("s").alias("source_id")).distinct()
    return projection.item_claims(items, made).select("idempotency_key", "claim_id")


@query("""WITH want AS (SELECT DISTINCT o_custkey AS a, o_orderstatus AS v, o_orderdate::DATE AS d FROM orders WHERE o_orderkey % 2 = 0),
    have AS (SELECT o_custkey AS a, o_orderstatus AS v, o_orderdate::DATE AS d, min('e' || o_orderkey) AS id FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL)
    SELECT a AS artist_id, v AS venue_id, d AS date, coalesce(id, 'event-' || sha256(concat(a, chr(31), v, chr(31), d))[1:32]) AS ensured_id, id IS NULL AS event_created FROM want LEFT JOIN have USING (a, v, d)""")
def canonical_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    keys = [F.col("o_custkey").alias("artist_id"), F.col("o_orderstatus").alias("venue_id"), F.to_date("o_orderdate").alias("date")]
    return projection.ensure_events(orders.where("o_orderkey % 2 = 0").select(*keys), orders.where("o_orderkey % 3 = 0").select(text("e", F.col("o_orderkey")).alias("id"), *keys))


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, projection.World]:
    """Work items of orders, and a world around them: nine sources (one unknown), claims, mappings, events, tombstones, links."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").cast("string").alias("date")).dropDuplicates(["k"])
    orders = keep(orders)
    k, c = F.col("k"), F.col("c")
    source = text("s", c % 9)
    subject = F.concat(F.lit("event:"), source, F.lit(":"), k.cast("string"))
    items = orders.select(
        text("i", k).alias("idempotency_key"), source.alias("source_id"), F.lit("obs-1").alias("observation_id"), subject.alias("candidate_key"), pick(ACTIONS, k % 5).alias("action"), F.array(text("st", k)).alias("claim_ids"),
    )
    n = F.col("n")
    sources = spark.range(8).select(F.col("id").alias("n")).select(text("s", n).alias("source_id"), pick(CLASSES, n % 7).alias("authority"), (n == 7).alias("shadow"), F.when(n == 6, "cowork").otherwise("aws").alias("writer"))
    performer = F.to_json(F.struct(text("Act ", c % 200).alias("name")))
    place = F.to_json(F.struct(text("Room ", c % 60).alias("name"), F.when(k % 13 != 0, "Town").alias("location")))
    made = F.array(*(F.struct(F.lit(p).alias("predicate"), v.alias("value"), i.alias("claim_id")) for p, v, i in (
        ("hasPerformer", performer, text("pe", k)), ("occursAt", place, text("ve", k)), ("occursOn", F.col("date"), text("da", k)), ("startsAt", F.lit("20:00"), text("ti", k)), ("hasStatus", F.lit("scheduled"), text("st", k)))))
    found = orders.where("k % 11 <> 0").select(source.alias("source_id"), subject.alias("subject"), F.lit("2026-07-20T00:00:00Z").alias("observed_at"), F.lit("active").alias("status"), F.inline(made))
    mapped = orders.where("k % 4 = 0").select(source.alias("source_id"), subject.alias("candidate_key"), text("a", c % 200).alias("artist_id"), text("v", c % 60).alias("venue_id"), text("e", k).alias("event_id"))
    events = orders.where("k % 4 = 0 and k % 3 <> 0").select(
        text("e", k).alias("id"), text("a", c % 200).alias("artist_id"), F.array().cast("array<string>").alias("artist_ids"), text("v", c % 60).alias("venue_id"), "date", F.lit(False).alias("cancelled"), F.lit(True).alias("is_public"),
        F.when(k % 7 == 0, "m").alias("membership_id"), F.lit(False).alias("verified_by_artist"), F.array(F.struct(source.alias("source"), k.cast("string").alias("id"))).alias("external_ids"),
    )
    artists = spark.range(0, 200, 2).select(text("a", F.col("id")).alias("id0"), text("ACT  ", F.col("id")).alias("name")).select(F.col("id0").alias("id"), "name")
    venues = spark.range(0, 60, 2).select(text("v", F.col("id")).alias("id0"), text("room ", F.col("id")).alias("name")).select(F.col("id0").alias("id"), "name")
    graves = orders.where("k % 17 = 0").select(text("a", c % 200).alias("artist_id"), text("v", c % 60).alias("venue_id"), "date").distinct().withColumn("status", F.lit("active"))
    links = orders.where("k % 4 = 0").select(F.lit("event").alias("entity_type"), text("e", k).alias("entity_id"), text("pe", k + 3).alias("claim_id"))
    ledger = orders.where("k % 10 = 1").select(text("i", k).alias("idempotency_key"), F.when(k % 3 == 0, "failed").otherwise("success").alias("status"))
    return items, projection.World(sources, found, mapped, artists, venues, events, graves, links, ledger)


def keep(df: DataFrame) -> DataFrame:
    return kept(df, "projection")


def candidates(items: DataFrame, around: projection.World) -> DataFrame:
    """The items' candidates, with the claim that each item puts forward."""
    return projection.item_candidates(items, around.claims, keep).withColumn("claim_id", F.try_element_at("claim_ids", F.lit(1)))


_WORLD = f"""o AS (SELECT DISTINCT ON (o_orderkey) o_orderkey AS k, o_custkey AS c, o_orderdate::DATE::VARCHAR AS d FROM orders),
    i AS (SELECT *, 's' || (c % 9) AS source, ({listed(ACTIONS)})[1 + k % 5] AS action, CASE WHEN c % 9 < 8 THEN ({listed(CLASSES)})[1 + (c % 9) % 7] END AS authority, k % 10 = 1 AND k % 3 <> 0 AS done, k % 4 = 0 AND k % 3 <> 0 AS there,
        k % 4 = 0 AND k % 3 <> 0 AND k % 7 = 0 AS owned, k % 4 = 0 AS mapped FROM o),
    g AS (SELECT DISTINCT 'a' || (c % 200) AS a, 'v' || (c % 60) AS v, d FROM o WHERE k % 17 = 0),
    sup AS (SELECT k, {STATUS_SCORE.format(a='coalesce(a, ' + repr('capture') + ')')} AS score, coalesce(a, 'capture') AS who FROM (SELECT i.k, CASE WHEN p.c % 9 < 8 THEN ({listed(CLASSES)})[1 + (p.c % 9) % 7] END AS a FROM i JOIN o p ON p.k = i.k + 3 AND p.k % 11 <> 0 WHERE i.mapped)),
    r AS (SELECT i.*, sup.score AS support, sup.who, {STATUS_SCORE.format(a='authority')} AS own,
        CASE WHEN mapped THEN 'a' || (c % 200) WHEN c % 200 % 2 = 0 THEN 'a' || (c % 200) ELSE 'artist-' || sha256('act ' || (c % 200))[1:32] END AS artist,
        CASE WHEN mapped THEN 'v' || (c % 60) WHEN c % 60 % 2 = 0 THEN 'v' || (c % 60) ELSE 'venue-' || sha256('room ' || (c % 60))[1:32] END AS venue FROM i LEFT JOIN sup ON i.k = sup.k),
    s AS (SELECT r.*, g.d IS NOT NULL AS grave,
        CASE WHEN done THEN 'idempotent' WHEN authority IS NULL THEN 'exception' WHEN k % 11 = 0 THEN 'exception' WHEN k % 13 = 0 THEN 'exception' WHEN c % 9 IN (6, 7) THEN 'shadow' ELSE 'live' END AS gate
        FROM r LEFT JOIN g ON g.a = r.artist AND g.v = r.venue AND g.d = r.d),
    x AS (SELECT *, action IN ('cancel', 'withdraw') AS destructive,
        CASE WHEN action IN ('cancel', 'withdraw') THEN CASE WHEN NOT mapped THEN 'No canonical event mapping for destructive projection' WHEN NOT there THEN 'Canonical event e' || k || ' no longer exists'
            WHEN owned AND authority NOT IN ('owner', 'artist-owned') THEN 'owner-managed event blocks ' || authority || ' mutation' WHEN support > own THEN 'fresh higher-authority support (' || who || ') blocks destructive projection' END
        WHEN grave AND authority NOT IN {STRONG} THEN 'active tombstone requires explicit owner/artist/venue-owned reinstatement' END AS stop FROM s),
    h AS (SELECT 'a' || (c % 200) AS a, 'v' || (c % 60) AS v, d, min('e' || k) AS id FROM o WHERE k % 4 = 0 AND k % 3 <> 0 GROUP BY ALL),
    y AS (SELECT x.*, h.id AS match, CASE WHEN there THEN 'e' || k ELSE coalesce(h.id, 'event-' || sha256(concat(artist, chr(31), venue, chr(31), x.d))[1:32]) END AS event FROM x LEFT JOIN h ON h.a = artist AND h.v = venue AND h.d = x.d),
    z AS (SELECT y.*, gate = 'live' AND NOT destructive AND stop IS NULL AS put, coalesce(e.k % 7 = 0, false) AS event_owned FROM y LEFT JOIN o e ON y.event = 'e' || e.k AND e.k % 4 = 0 AND e.k % 3 <> 0),
    w AS (SELECT *, put AND NOT there AND match IS NULL AND 'i' || k = min(CASE WHEN put AND NOT there AND match IS NULL THEN 'i' || k END) OVER (PARTITION BY event) AS new_event,
        put AND starts_with(artist, 'artist-') AND 'i' || k = min(CASE WHEN put AND starts_with(artist, 'artist-') THEN 'i' || k END) OVER (PARTITION BY artist) AS new_artist,
        put AND starts_with(venue, 'venue-') AND 'i' || k = min(CASE WHEN put AND starts_with(venue, 'venue-') THEN 'i' || k END) OVER (PARTITION BY venue) AS new_venue FROM z),
    f AS (SELECT *, put AND event_owned AND (action = 'update' OR NOT new_event) AND authority NOT IN ('owner', 'artist-owned') AS guarded FROM w),
    outcome AS (SELECT 'i' || k AS idempotency_key, source AS source_id, action, CASE WHEN gate = 'live' THEN CASE WHEN stop IS NULL THEN 'success' ELSE 'exception' END ELSE gate END AS status,
        CASE gate WHEN 'exception' THEN CASE WHEN authority IS NULL THEN 'Unknown source ' || source WHEN k % 11 = 0 THEN 'Projection item has no readable Claims' ELSE 'Projection candidate event:' || source || ':' || k || ' missing venueLocation' END
            WHEN 'shadow' THEN CASE WHEN c % 9 = 7 THEN 'source is in shadow mode' ELSE 'writerAuthority=cowork' END
            WHEN 'live' THEN CASE WHEN guarded THEN 'owner-managed event blocks ' || authority || ' mutation' ELSE stop END END AS message,
        CASE WHEN gate = 'live' AND stop IS NULL THEN CASE WHEN destructive THEN 'e' || k ELSE event END WHEN gate = 'shadow' AND mapped THEN 'e' || k END AS event_id,
        put AND NOT guarded AND new_event AS event_created, put AND NOT guarded AND NOT new_event AND action = 'update' AS event_updated, new_artist AS artist_created, new_venue AS venue_created, put AND NOT guarded AND grave AS reinstated, guarded AS protected,
        gate = 'live' AND stop IS NULL AND action = 'cancel' AS event_cancelled, gate = 'live' AND stop IS NULL AND action = 'withdraw' AS event_hidden, artist, venue, d, c, k FROM f)"""


@query(f"WITH {_WORLD} SELECT idempotency_key, source_id, action, status, message, event_id, event_created, event_updated, artist_created, venue_created, reinstated, protected, event_cancelled, event_hidden FROM outcome")
def projection_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, around = world(spark, sf_dir)
    out = projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep)
    return out.select("idempotency_key", "source_id", "action", "status", "message", "event_id", "event_created", "event_updated", "artist_created", "venue_created", "reinstated", "protected", "event_cancelled", "event_hidden")


@query(f"""WITH {_WORLD}, puts AS (SELECT * FROM outcome WHERE status = 'success' AND action NOT IN ('cancel', 'withdraw')),
    l AS (SELECT 'event' AS entity_type, event_id AS entity_id, unnest(['pe' || k, 've' || k, 'da' || k, 'ti' || k, 'st' || k]) AS claim_id FROM puts UNION SELECT 'artist', artist, 'pe' || k FROM puts UNION SELECT 'venue', venue, 've' || k FROM puts)
    SELECT entity_type, entity_id, claim_id FROM l EXCEPT SELECT 'event', 'e' || k, 'pe' || (k + 3) FROM o WHERE k % 4 = 0""")
def support_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, around = world(spark, sf_dir)
    out = projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep)
    # Only creations and updates add links, so that no other item's claims are looked for.
    put = items.where("action not in ('cancel', 'withdraw')")
    return projection.support_links(out, projection.item_claims(put, around.claims), around.links)


@query(f"""WITH {_WORLD}, taken AS (SELECT * FROM outcome WHERE event_cancelled OR event_hidden), dated AS (SELECT 'a' || (c % 200) AS a, 'v' || (c % 60) AS v, d, k, event_cancelled, source_id FROM taken),
    fresh AS (SELECT dated.* FROM dated WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.a = dated.a AND g.v = dated.v AND g.d = dated.d))
    SELECT 'tombstone-' || sha256(concat_ws('|', a, v, d))[1:32] AS id, arg_min(CASE WHEN event_cancelled THEN 'explicit cancellation' ELSE 'absent from complete snapshot' END, 'i' || k) AS reason, arg_min('e' || k, 'i' || k) AS canonical_event_id FROM fresh GROUP BY a, v, d""")
def tombstone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, around = world(spark, sf_dir)
    put = candidates(items, around)
    out = projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep, put)
    return projection.tombstone_rows(out, put.select("idempotency_key", "date", "claim_id"), around, NOW).select("id", "reason", "canonical_event_id")


@query(f"""WITH {_WORLD}, chg AS (SELECT * FROM outcome WHERE status = 'success' AND (event_created OR event_updated OR event_cancelled OR event_hidden OR reinstated)),
    put AS (SELECT event_id AS id, idempotency_key AS i, event_created OR event_updated AS put, source_id || ':' || k AS own, artist, venue, d, CASE WHEN event_cancelled THEN true WHEN reinstated THEN false END AS cancelled, CASE WHEN event_hidden THEN false WHEN reinstated THEN true END AS shown FROM chg),
    old AS (SELECT 'e' || k AS id, 'a' || (c % 200) AS artist, 'v' || (c % 60) AS venue, d, source || ':' || k AS own FROM i WHERE there),
    ev AS (SELECT n.id, coalesce(arg_max(n.artist, i) FILTER (put), any_value(old.artist)) AS artist_id, coalesce(arg_max(n.venue, i) FILTER (put), any_value(old.venue)) AS venue_id, coalesce(arg_max(n.d, i) FILTER (put), any_value(old.d)) AS date,
        coalesce(arg_max(cancelled, i) FILTER (cancelled IS NOT NULL), false) AS cancelled, coalesce(arg_max(shown, i) FILTER (shown IS NOT NULL), true) AS is_public, list_sort(list_distinct(list_filter([any_value(old.own)], lambda z: z IS NOT NULL) || coalesce(list(n.own) FILTER (put), []))) AS ids
        FROM put n LEFT JOIN old ON n.id = old.id GROUP BY n.id)
    SELECT id, artist_id, venue_id, date, cancelled, is_public, array_to_string(ids, ',') AS external_ids FROM ev""")
def projection_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a run changes, written with all its other changes in one commit and read back from the store."""
    items, around = world(spark, sf_dir)
    put = candidates(items, around)
    out = projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep, put)
    store = Store(spark, shared_folder(spark, "canonical"), indexes={"event": ["venue_id"]})
    sinks.write_projection(store, out, None, put, around, NOW)
    events = store.read("event", "id string, artist_id string, venue_id string, date string, cancelled boolean, is_public boolean, external_ids array<struct<source:string,id:string>>")
    return events.withColumn("external_ids", F.array_join(F.sort_array(F.transform("external_ids", lambda x: F.concat(x["source"], F.lit(":"), x["id"]))), ","))


@query(f"""WITH {_WORLD}, new AS (SELECT source_id, 'event:' || source_id || ':' || k AS candidate_key, CASE WHEN status = 'success' THEN CASE WHEN event_cancelled OR event_hidden THEN 'a' || (c % 200) ELSE artist END END AS a, event_id AS e FROM outcome WHERE status IN ('success', 'shadow')),
    old AS (SELECT source AS source_id, 'event:' || source || ':' || k AS candidate_key, 'a' || (c % 200) AS a, 'e' || k AS e FROM i WHERE mapped)
    SELECT coalesce(new.source_id, old.source_id) AS source_id, coalesce(new.candidate_key, old.candidate_key) AS candidate_key, coalesce(new.a, old.a) AS artist_id, coalesce(new.e, old.e) AS event_id FROM new FULL JOIN old ON new.candidate_key = old.candidate_key""")
def merged_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, around = world(spark, sf_dir)
    out = projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep)
    return projection.merged_mappings(around.mappings, out).select("source_id", "candidate_key", "artist_id", "event_id")


@query(f"""WITH {_WORLD} SELECT count(*) AS items_seen, sum((status = 'success' AND NOT event_cancelled AND NOT event_hidden)::INT - artist_created::INT)::BIGINT AS artists_matched, sum(artist_created::INT)::BIGINT AS artists_created, sum(venue_created::INT)::BIGINT AS venues_created,
    sum(event_created::INT)::BIGINT AS events_created, sum(event_updated::INT)::BIGINT AS events_updated, sum(event_cancelled::INT)::BIGINT AS events_cancelled FROM outcome WHERE status <> 'idempotent'""")
def projection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, around = world(spark, sf_dir)
    rows = projection.run_items(projection.project(items, around, F.to_timestamp(F.lit(NOW)), keep)).withColumns({"completed_at": F.lit(NOW), "expected_items": F.lit(1), "error": F.lit(None).cast("string")})
    return reconcile.run_summary(rows).select("items_seen", "artists_matched", "artists_created", "venues_created", "events_created", "events_updated", "events_cancelled")


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderdate::DATE::VARCHAR AS d, o_totalprice AS p FROM orders),
    j AS (SELECT *, 'event:desk:' || k AS subject, 'Act ' || c AS a, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN '' ELSE 'Room "' || s || '"' END AS v FROM o WHERE k % 6 <> 0 OR k % 12 = 0),
    x AS (SELECT subject, unnest([{'p': 'hasPerformerName', 'v': CASE WHEN k % 12 <> 0 THEN a END, 'j': false}, {'p': 'hasPerformer', 'v': CASE WHEN k % 12 <> 0 THEN '{"name":"' || a || '","sourceNativeId":"a' || c || '"}' END, 'j': true},
        {'p': 'hasVenueName', 'v': CASE WHEN k % 12 <> 0 THEN nullif(v, '') END, 'j': false}, {'p': 'occursAt', 'v': CASE WHEN k % 12 <> 0 AND v <> '' THEN '{"name":"' || replace(v, '"', '\\"') || '","location":"Town"}' END, 'j': true},
        {'p': 'occursOn', 'v': CASE WHEN k % 12 <> 0 THEN d END, 'j': false}, {'p': 'hasStatus', 'v': CASE WHEN k % 12 <> 0 THEN s END, 'j': false}, {'p': 'derivedFrom', 'v': CASE WHEN k % 12 = 0 THEN k::VARCHAR END, 'j': false}]) AS c FROM j)
    SELECT subject, c.p AS predicate, c.v AS value, 'claim-' || sha256(concat('obs-1', chr(31), subject, chr(31), c.p, chr(31), CASE WHEN c.j THEN c.v ELSE '"' || replace(c.v, '"', '\\"') || '"' END))[1:32] AS claim_id FROM x WHERE c.v IS NOT NULL""")
def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk_claims(spark, sf_dir).select("subject", "predicate", "value", "claim_id")


def desk_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of orders as events; every twelfth has nothing but its key."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").cast("string").alias("d"), F.col("o_totalprice").alias("p")).distinct()
    orders = orders.where("k % 6 <> 0 or k % 12 = 0")
    k, full = F.col("k"), F.col("k") % 12 != 0
    none = F.lit(None).cast("string")
    venue = F.when(k % 3 == 1, "").when(k % 3 == 2, text('Room "', F.col("s"), '"'))
    columns = {
        "source_event_key": k.cast("string"), "artist_name": F.when(full, text("Act ", F.col("c"))), "artist_external_id": text("a", F.col("c")), "artist_location": F.lit(""), "venue_name": F.when(full, venue), "venue_external_id": none,
        "venue_location": F.lit("Town"), "venue_address": none, "date": F.when(full, F.col("d")), "status": F.when(full, F.col("s")), "content_hash": none,
        **{c: none for c in ("start_time", "end_time", "title", "event_url", "ticket_url", "admission_status", "price")},
    }
    return claims.event_claims(orders.select(*(c.alias(n) for n, c in columns.items())), "desk", F.lit("obs-1"), F.lit("2026-01-01T00:00:00Z"))


@query("""WITH o AS (SELECT DISTINCT 'event:orders:' || o_orderkey AS subject, o_orderstatus AS s, o_orderdate::DATE::VARCHAR AS d FROM orders),
    x AS (SELECT subject, unnest([{'p': 'hasStatus', 'v': s}, {'p': 'occursOn', 'v': d}]) AS c FROM o), i AS (SELECT DISTINCT subject, 'claim-' || sha256(concat('obs-1', chr(31), subject, chr(31), c.p, chr(31), '"', c.v, '"'))[1:32] AS id FROM x)
    SELECT subject, string_agg(id, ',' ORDER BY id) AS claim_ids, count(*) AS n FROM i GROUP BY subject""")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    made = claims.explode_claims(orders, F.lit("obs-1"), text("event:orders:", F.col("o_orderkey")), {"hasStatus": F.col("o_orderstatus"), "occursOn": F.to_date("o_orderdate")})
    out = claims.candidates(made)
    return out.select("subject", F.array_join("supporting_claim_ids", ",").alias("claim_ids"), F.size("supporting_claim_ids").cast("long").alias("n"))


@query("""WITH c AS (SELECT o_custkey AS item, o_orderkey AS claim, o_orderdate::DATE::VARCHAR AS observed, o_orderkey % 4 = 0 AS status, o_orderkey % 3 AS src, o_custkey % 3 AS own FROM (SELECT DISTINCT o_custkey, o_orderkey, o_orderdate FROM orders))
    SELECT item AS idempotency_key, arg_min(claim, claim) FILTER (observed = last) AS prior_claim_id FROM (SELECT *, max(observed) OVER (PARTITION BY item) AS last FROM c WHERE NOT status AND src = own AND claim % 10 <> 7) GROUP BY item""")
def prior_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").distinct()
    k = F.col("o_orderkey")
    found = rows.where(k % 10 != 7).select(F.col("o_custkey").alias("idempotency_key"), k.alias("claim_id"), F.to_date("o_orderdate").cast("string").alias("observed_at"), F.when(k % 4 == 0, "hasStatus").otherwise("occursOn").alias("predicate"), (k % 3).alias("claim_source"))
    items = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idempotency_key"), (F.col("c_custkey") % 3).alias("source_id"), F.lit(None).cast("long").alias("proposed_claim_id"))
    return projection.prior_claims(found, items)


@query("""WITH c AS (SELECT c_custkey AS k, [{'s': 's' || (c_custkey % 3), 'i': c_custkey::VARCHAR}, {'s': 's1', 'i': c_custkey::VARCHAR}, {'s': '', 'i': 'x'}, {'s': 's2', 'i': NULL}] AS ids FROM customer),
    u AS (SELECT DISTINCT k, x.s || ':' || x.i AS id FROM (SELECT k, unnest(ids || [{'s': 's2', 'i': k::VARCHAR}]) AS x FROM c) WHERE x.s <> '' AND x.i IS NOT NULL) SELECT k AS c_custkey, string_agg(id, ',' ORDER BY id) AS external_ids FROM u GROUP BY k""")
def external_id_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    pair = lambda s, i: F.struct(s.alias("source"), i.alias("id"))
    existing = F.array(pair(text("s", F.col("c_custkey") % 3), k), pair(F.lit("s1"), k), pair(F.lit(""), F.lit("x")), pair(F.lit("s2"), F.lit(None).cast("string")))
    merged = projection.merge_external_ids(existing, F.lit("s2"), k)
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.sort_array(F.transform(merged, lambda x: F.concat(x["source"], F.lit(":"), x["id"]))), ",").alias("external_ids"))


def seen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations by order status, their events, and projections of every second one."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.to_date("o_orderdate").cast("string").alias("date")).distinct()
    orders = kept(orders, "graph")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    observations = orders.select(F.lit("desk").alias("source_id"), text("obs ", F.col("o_orderstatus")).alias("observation_id"), F.lit("2026-01-01T00:00:00Z").alias("observed_at")).distinct()
    events = orders.select(
        text("obs ", F.col("o_orderstatus")).alias("observation_id"), text("event:", k).alias("candidate_key"), k.cast("string").alias("source_event_key"), text("a", c).alias("artist_external_id"), text("Act ", c).alias("artist_name"),
        text("v", c % 50).alias("venue_external_id"), text("Room ", c % 50).alias("venue_name"), "date", F.lit("20:00").alias("start_time"),
    )
    return observations, events, orders.where("o_orderkey % 2 = 0").select(k.cast("string").alias("source_event_key"), text("A", c % 100).alias("artist_id"), text("V", c % 50).alias("venue_id"), text("E", k).alias("event_id"))


_SEEN = """o AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderdate::DATE::VARCHAR AS d FROM orders)"""


@query(f"""WITH {_SEEN}, n AS (SELECT 'source:desk' AS id, 'source' AS type, 'desk' AS label, 'sourceId=desk' AS data UNION SELECT 'observation:obs ' || s, 'observation', 'Observation 2026-01-01T00:00:00', 'observationId=obs ' || s || ',observedAt=2026-01-01T00:00:00Z' FROM o
    UNION SELECT 'artist:a' || c, 'artist-candidate', 'Act ' || c, 'externalId=a' || c FROM o UNION SELECT 'venue:v' || (c % 50), 'venue-candidate', 'Room ' || (c % 50), 'externalId=v' || (c % 50) FROM o
    UNION SELECT 'event:' || k, 'event-candidate', 'Act ' || c || ' @ Room ' || (c % 50), 'date=' || d || ',sourceEventKey=' || k || ',startTime=20:00' FROM o
    UNION SELECT 'canonical-artist:A' || (c % 100), 'artist', min('Act ' || c), 'canonicalId=A' || (c % 100) FROM o WHERE k % 2 = 0 GROUP BY c % 100 UNION SELECT 'canonical-venue:V' || (c % 50), 'venue', 'Room ' || (c % 50), 'canonicalId=V' || (c % 50) FROM o WHERE k % 2 = 0
    UNION SELECT 'canonical-event:E' || k, 'event', 'Act ' || c || ' @ Room ' || (c % 50), 'canonicalId=E' || k FROM o WHERE k % 2 = 0) SELECT * FROM n""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, events, projections = seen(spark, sf_dir)
    data = F.array_join(F.transform(F.sort_array(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    both = graph.observed(observations, events)[0].unionByName(graph.resolved(events, projections)[0])
    return both.select("id", "type", "label", data.alias("data"))


@query(f"""WITH {_SEEN} SELECT 'edge:source:desk:observation:obs_' || s AS id, 'source:desk' AS source, 'observation:obs ' || s AS target, 'observed' AS label FROM o UNION SELECT 'edge:observation:obs_' || s || ':event:' || k, 'observation:obs ' || s, 'event:' || k, 'asserts' FROM o
    UNION SELECT 'edge:event:' || k || ':artist:a' || c, 'event:' || k, 'artist:a' || c, 'hasPerformer' FROM o UNION SELECT 'edge:event:' || k || ':venue:v' || (c % 50), 'event:' || k, 'venue:v' || (c % 50), 'occursAt' FROM o
    UNION SELECT 'resolve:artist:a' || c || ':A' || (c % 100), 'artist:a' || c, 'canonical-artist:A' || (c % 100), 'resolvesTo' FROM o WHERE k % 2 = 0 UNION SELECT 'resolve:venue:v' || (c % 50) || ':V' || (c % 50), 'venue:v' || (c % 50), 'canonical-venue:V' || (c % 50), 'resolvesTo' FROM o WHERE k % 2 = 0
    UNION SELECT 'resolve:event:' || k || ':E' || k, 'event:' || k, 'canonical-event:E' || k, 'projectsTo' FROM o WHERE k % 2 = 0 UNION SELECT 'canonical:E' || k || ':artist', 'canonical-event:E' || k, 'canonical-artist:A' || (c % 100), 'performer' FROM o WHERE k % 2 = 0
    UNION SELECT 'canonical:E' || k || ':venue', 'canonical-event:E' || k, 'canonical-venue:V' || (c % 50), 'venue' FROM o WHERE k % 2 = 0""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, events, projections = seen(spark, sf_dir)
    return graph.observed(observations, events)[1].unionByName(graph.resolved(events, projections)[1])


@query(f"""WITH {_SEEN} SELECT 'artist:a' || c AS id, count(*) AS n, string_agg('k' || k, ',' ORDER BY 'k' || k) AS claims FROM o GROUP BY c UNION ALL SELECT DISTINCT 'venue:v' || (c % 50), 0, '' FROM o""")
def graph_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events, _ = seen(spark, sf_dir)
    made = events.select(F.concat(F.lit("artist:"), "artist_external_id").alias("subject"), F.concat(F.lit("k"), "source_event_key").alias("claim_id"), F.lit("hasName").alias("predicate"), F.col("artist_name").alias("value"))
    other = made.withColumn("subject", F.lit("nobody"))
    nodes = made.select(F.col("subject").alias("id")).union(events.select(F.concat(F.lit("venue:"), "venue_external_id"))).distinct()
    out = graph.with_claims(nodes, made.union(other))
    ids = F.coalesce(F.array_join(F.transform("claims", lambda c: c["claim_id"]), ","), F.lit(""))
    return out.select("id", F.coalesce(F.size("claims"), F.lit(0)).cast("long").alias("n"), ids.alias("claims"))


@query("""WITH c AS (SELECT o_orderkey AS claim_id, o_custkey AS subject, o_orderstatus AS observation_id, o_orderdate AS observed_at FROM (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders)), s AS (SELECT min(subject) AS m FROM c)
    SELECT 'id' AS path, claim_id FROM c WHERE claim_id = (SELECT min(claim_id) FROM c) UNION ALL SELECT 'observation', claim_id FROM (SELECT claim_id FROM c WHERE observation_id = 'O' ORDER BY observed_at, claim_id LIMIT 1000) UNION ALL SELECT 'subject', claim_id FROM c, s WHERE subject = m
    UNION ALL SELECT 'batch', claim_id FROM c WHERE subject IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0) UNION ALL SELECT 'external', min(claim_id) FROM c, s WHERE subject = m""")
def access_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("observation_id"), F.col("o_orderdate").alias("observed_at")).distinct()
    first, subject = made.agg(F.min("claim_id"), F.min("subject")).first()
    asked = load(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("subject"))
    external = made.select(F.col("claim_id").alias("id"), F.array(F.struct(F.lit("desk").alias("source"), F.col("subject").cast("string").alias("id"))).alias("external_ids"))
    parts = {
        "id": access.claim_by_id(made, first), "observation": access.claims_of_observation(made, "O"), "subject": access.claims_of_subject(made, subject), "batch": access.by_keys(made, asked),
        "external": access.by_external_id(external, "desk", str(subject)).select(F.col("id").alias("claim_id")),
    }
    out = None
    for path, rows in parts.items():
        rows = rows.select(F.lit(path).alias("path"), "claim_id")
        out = rows if out is None else out.unionByName(rows)
    return out
