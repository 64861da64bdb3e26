"""Queries of enrichment: gaps and intake, gates, merges, evidence, usage, write-back; commercial places and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import text as tx
from claimspark.operators import assess, enrich
from claimspark.plans.registry import listed, load, pick, query, text


@query("""WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) || ' ' ELSE o_orderpriority END AS name, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS town, o_custkey AS c FROM (SELECT DISTINCT o_orderkey, o_orderpriority, o_orderstatus, o_custkey FROM orders) WHERE o_orderkey % 3 = 0),
    g AS (SELECT *, lower(trim(name)) AS n, lower(trim(coalesce(town, ''))) AS t FROM o), u AS (SELECT n, t, unnest(['http://e.org/' || (c % 5), 'http://t.org/' || (c % 3)]) AS url, unnest([0, 1]) AS p, k FROM g),
    f AS (SELECT n, t, url, min((k, p)) AS pos FROM u GROUP BY ALL), l AS (SELECT n, t, string_agg(url, ',' ORDER BY pos) AS evidence FROM f GROUP BY ALL), m AS (SELECT n, t, arg_max(name, k) AS name, max_by({'t': town}, k) AS town FROM g GROUP BY ALL)
    SELECT m.name, m.town.t AS town, l.evidence FROM m JOIN l ON m.n = l.n AND m.t = l.t""")
def commercial_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey").distinct()
    events = orders.select(
        k.alias("event_id"), F.when(k % 2 == 0, F.concat(F.upper("o_orderpriority"), F.lit(" "))).otherwise(F.col("o_orderpriority")).alias("venue_name"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("town"),
        F.when(k % 3 == 0, "PAID_CONFIRMED").otherwise("UNKNOWN").alias("admission"), F.array(text("http://e.org/", c % 5)).alias("source_urls"), F.array(text("http://t.org/", c % 3)).alias("admission_urls"),
    )
    return assess.commercial_signals(events).select("name", "town", F.array_join("evidence_urls", ",").alias("evidence"))


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS free, count(*) FILTER (l_returnflag = 'R') AS paid, bool_or(l_linestatus = 'F') AS venue FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, free = 0 AND ((venue AND paid >= 2) OR paid >= 3) AS suppressed, CASE WHEN free = 0 AND ((venue AND paid >= 2) OR paid >= 3) THEN 270 ELSE 0 END AS suppression_days, venue AND free = 0 AND paid >= 2 AS ticketed_venue,
        CASE WHEN free = 0 AND ((venue AND paid >= 2) OR paid >= 3) THEN '2026-09-28' END AS until FROM c""")
def eligibility_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumn("admission", F.when(F.col("l_returnflag") == "N", "FREE_CONFIRMED").when(F.col("l_returnflag") == "R", "PAID_CONFIRMED").otherwise("UNKNOWN"))
    out = assess.eligibility_decisions(lines, "l_orderkey", F.col("l_linestatus") == "F", "admission")
    until = F.date_format(assess.suppressed_until(F.to_timestamp(F.lit("2026-01-01"))), "yyyy-MM-dd")
    return out.select("l_orderkey", "suppressed", "suppression_days", "ticketed_venue", until.alias("until"))


def entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as artists and suppliers as places, with gaps by their numbers."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    full = lambda when, value: F.when(when, value).otherwise("")
    artists = load(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("location"), F.when(k % 2 == 0, F.array(F.lit("Rock"))).alias("genres"), full(k % 3 != 0, "Band").alias("artist_type"),
        F.when(k % 5 != 0, F.array(F.lit("Covers"))).otherwise(F.array().cast("array<string>")).alias("act_type"), full(k % 7 != 0, "bio").alias("bio"), full(k % 4 == 0, "http://facebook.com/a").alias("facebook_url"), full(k % 6 == 0, "http://a.org").alias("website_url"),
        F.when(k % 9 == 0, "high_confidence").alias("enrichment_status"),
    )
    venues = load(spark, sf_dir, "supplier").select(
        s.alias("id"), F.col("s_name").alias("name"), full(s % 2 == 0, "City").alias("city"), F.when(s % 3 == 0, F.array(F.lit("http://x.org"), F.lit("http://FACEBOOK.com/v"))).alias("social_urls"), full(s % 4 == 0, "http://v.org").alias("website"),
        (s % 5 == 0).alias("validated"), F.when(s % 7 == 0, "high_confidence").alias("enrichment_status"),
    )
    return artists, venues


_GAP = "SELECT '{e}' AS entity, unnest([{pairs}], recursive := true) FROM {t}"
_PAIR = "{{'counter': '{name}', 'n': count(*) FILTER ({when})}}"


def _gaps(entity: str, table: str, **counters: str) -> str:
    return _GAP.format(e=entity, t=table, pairs=", ".join(_PAIR.format(name=n, when=w) for n, w in counters.items()))


@query(_gaps("artist", "(SELECT c_custkey AS k FROM customer)", total="true", missing_genres="k % 2 <> 0", missing_artist_type="k % 3 = 0", missing_act_type="k % 5 = 0", missing_bio="k % 7 = 0", missing_facebook="k % 4 <> 0", missing_website="k % 6 <> 0", high_confidence="k % 9 = 0")
    + " UNION ALL " + _gaps("venue", "(SELECT s_suppkey AS k FROM supplier)", total="true", missing_facebook="k % 3 <> 0", missing_website="k % 4 <> 0", validated="k % 5 = 0", high_confidence="k % 7 = 0"))
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.gap_statistics(*entities(spark, sf_dir))


@query("""WITH e AS (SELECT o_custkey AS a, o_orderkey % 100 AS v FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND o_orderstatus IN ('O', 'P'))
    SELECT 'artist' AS type, c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS town, CASE WHEN c_custkey % 4 = 0 THEN 'http://facebook.com/a' END AS facebook_url, CASE WHEN c_custkey % 6 = 0 THEN 'http://a.org' END AS website FROM customer
        WHERE c_custkey % 9 <> 0 AND (c_custkey % 2 <> 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND c_custkey IN (SELECT a FROM e)
    UNION ALL SELECT 'venue', s_suppkey::VARCHAR, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'City' END, CASE WHEN s_suppkey % 3 = 0 THEN 'http://FACEBOOK.com/v' END, CASE WHEN s_suppkey % 4 = 0 THEN 'http://v.org' END FROM supplier
        WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0 AND s_suppkey IN (SELECT v FROM e)""")
def intake_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    artists, venues = entities(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("cell"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("artist_id"), (F.col("o_orderkey") % 100).alias("venue_id"))
    cells = orders.select("cell").distinct().withColumn("radius", F.when(F.col("cell") == "F", 100).when(F.col("cell") == "O", 25).otherwise(50))
    events = enrich.events_in(orders, enrich.cells_of(50, cells), F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("1996-12-31")))
    return enrich.intake(enrich.taking_part(artists, events, "artist_id"), enrich.taking_part(venues, events, "venue_id"))


@query("SELECT count(*) AS events, count(DISTINCT o_custkey) AS artists, count(DISTINCT nullif(o_clerk, '')) AS venues FROM orders".replace("nullif(o_clerk, '')", "o_orderpriority"))
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.entity_counts(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artist_id"), F.col("o_orderpriority").alias("venue_id")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 50 OFFSET 20")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.page(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), 20, 50, "c_name", "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'band' WHEN 1 THEN 'solo' END ELSE 'old' END AS artist_type, CASE WHEN c_custkey % 5 = 0 THEN 'covers' ELSE 'old' END AS act_type,
    CASE WHEN c_custkey % 2 = 0 THEN 'Rock' ELSE 'Pop' END AS genres, CASE WHEN c_custkey % 7 <> 0 THEN 'bio' END AS bio FROM customer""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none, some = F.array().cast("array<string>"), lambda x: F.array(F.lit(x))
    rows = load(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k % 3 != 0, F.col("c_name")).otherwise("").alias("old_facebook_url"), text("new", k).alias("new_facebook_url"), F.when(k % 4 != 0, "old").alias("old_artist_type"), F.when(k % 3 == 0, "Band").when(k % 3 == 1, "Solo Act").otherwise("Choir").alias("new_artist_type"),
        F.when(k % 5 != 0, some("old")).otherwise(none).alias("old_act_type"), F.array(F.lit("Covers"), F.lit("Mime")).alias("new_act_type"), F.when(k % 2 != 0, some("Pop")).alias("old_genres"), some("Rock").alias("new_genres"),
        F.when(k % 7 != 0, "bio").otherwise("").alias("old_bio"), F.lit(None).cast("string").alias("new_bio"), *(F.lit("x").alias(f"{o}_{c}") for o in ("old", "new") for c in ("location", "location_type")),
    )
    got = enrich.patched()
    return rows.select("c_custkey", got["facebook_url"].alias("name"), got["artist_type"].alias("artist_type"), F.array_join(got["act_type"], ",").alias("act_type"), F.array_join(got["genres"], ",").alias("genres"), got["bio"].alias("bio"))


WORDS = ("rock", "R&B", "heavy metal band", "Folk", "jazzy", "xyz", "POP", "rock n roll")
AS_GENRES = ("Rock", "R&B", "Metal", "Folk", "Jazz", "", "Pop", "Rock n Roll")


@query(f"SELECT p_partkey, concat_ws(',', nullif(({listed(AS_GENRES)})[1 + p_partkey % 8], ''), nullif(({listed(AS_GENRES)})[1 + (p_partkey // 8) % 8], '')) AS genres, CASE p_partkey % 3 WHEN 0 THEN 'Solo Act' WHEN 1 THEN 'DJ' END AS kind FROM part")
def genre_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.array(pick(WORDS, k % 8), pick(WORDS, (k / 8).cast("long") % 8))
    kind = F.when(k % 3 == 0, "solo act").when(k % 3 == 1, "dj").otherwise("soloist")
    one = F.try_element_at(tx.vocabulary(F.array(F.col("t")), tuple(enrich.ARTIST_TYPES), False), F.lit(1))
    rows = load(spark, sf_dir, "part").select("p_partkey", words.alias("w"), kind.alias("t"))
    return rows.select("p_partkey", F.array_join(tx.vocabulary(F.col("w"), enrich.GENRES), ",").alias("genres"), one.alias("kind"))


@query("""WITH c AS (SELECT o_custkey AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, 'http://f/' || o_orderkey AS url, o_orderkey % 3 <> 0 AS is_match, (o_orderkey % 10) / 10.0 AS confidence FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)),
    g AS (SELECT *, is_match AND confidence >= 0.6 AND rank <= 2 AS good FROM c)
    SELECT entity_id, CASE WHEN bool_or(good) THEN 'matched' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, arg_min(url, rank) FILTER (good) AS url, coalesce(arg_min(confidence, rank) FILTER (good), 0)::DOUBLE AS confidence FROM g GROUP BY entity_id""")
def page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy("o_orderkey"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), "o_orderkey").distinct().withColumn("rank", rank)
    return enrich.page_match(rows.select("entity_id", "rank", text("http://f/", k).alias("url"), (k % 3 != 0).alias("is_match"), ((k % 10) / 10).alias("confidence")))


@query("""WITH e AS (SELECT o_orderstatus AS g, o_orderkey AS seq, 'http://e.org/' || (o_custkey % 30) AS url, o_custkey AS note FROM (SELECT o_orderstatus, o_orderkey, min(o_custkey) AS o_custkey FROM orders GROUP BY ALL))
    SELECT g, url AS source_url, arg_max(note, seq) AS note, min(seq) AS seq FROM e GROUP BY g, url""")
def merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("seq")).agg(F.min("o_custkey").alias("note"))
    return enrich.merged_evidence(rows.withColumn("source_url", text("http://e.org/", F.col("note") % 30)), "g").select("g", "source_url", "note", "seq")


@query("""WITH p AS (SELECT page_id, url FROM pages) SELECT page_id, 0 AS seq, 'ev_' || sha1('https://a.org/' || page_id)[1:12] AS evidence_id, 'a.org' AS domain FROM p UNION ALL SELECT page_id, 1, 'ev_' || sha1('http://B.org/x')[1:12], 'b.org' FROM p WHERE page_id % 2 = 0""")
def evidence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    first = F.concat(F.lit('{"a":[{"url":"https://a.org/'), k, F.lit('"},{"uri": "https://a.org/'), k, F.lit('"}'))
    body = F.concat(first, F.when(F.col("page_id") % 2 == 0, ',{"source":{"url":"http://B.org/x"}}').otherwise(',{"url":"ftp://c.org/"}'), F.lit("]}"))
    return enrich.evidence(load(spark, sf_dir, "pages").select("page_id", body.alias("body")), "page_id", "body").select("page_id", "seq", "evidence_id", "domain")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'plain ' || c_custkey WHEN 1 THEN 'last ' || c_custkey END AS output FROM customer")
def output_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    steps = text('{"steps":[{"type":"model_output","content":[{"type":"text","text":"first"}]},{"type":"search","content":[{"type":"text","text":"no"}]},{"type":"model_output","content":[{"type":"text","text":"last ', k, '"},{"type":"image"}]}]}')
    body = F.when(k % 3 == 0, text('{"output_text":"plain ', k, '"}')).when(k % 3 == 1, steps).otherwise('{"steps":[]}')
    return load(spark, sf_dir, "customer").select("c_custkey", body.alias("body")).select("c_custkey", enrich.output_text(F.col("body")).alias("output"))


@query("SELECT user_id, sum(event_id % 3)::BIGINT AS searches, sum(event_id % 100)::BIGINT AS input_tokens, sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 50 END)::BIGINT AS output_tokens, count(*) AS calls, round(sum(event_id % 3) * 0.005 + count(*) * 0.00025, 6)::DOUBLE AS cost FROM events GROUP BY user_id")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    calls = load(spark, sf_dir, "events").select("user_id", (e % 3).alias("searches"), (e % 100).alias("input_tokens"), F.when(e % 7 != 0, e % 50).alias("output_tokens"))
    return enrich.usage(calls, "user_id").withColumn("cost", F.round("cost", 6))


@query("""SELECT user_id AS entity_id, max(value) FILTER (event_type = 'click') AS a_confidence, max(value) FILTER (event_type = 'view') AS b_confidence, max(event_id) FILTER (event_type = 'click') AS a_latency_ms, max(event_id) FILTER (event_type = 'view') AS b_latency_ms FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def provider_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = load(spark, sf_dir, "events").where(kind.isin("click", "view")).select(F.col("user_id").alias("entity_id"), F.when(kind == "click", "a").otherwise("b").alias("provider"), F.col("value").alias("confidence"), F.lit("x").alias("status"), F.col("event_id").alias("latency_ms"), F.lit(0.0).alias("cost"))
    return enrich.compared(rows, ("a", "b")).select("entity_id", "a_confidence", "b_confidence", "a_latency_ms", "b_latency_ms")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN 'high_confidence' ELSE 'old' END AS enrichment_status, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END END AS confidence,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'Facebook: matched with 87% confidence; ' ELSE '' END || 'Genres: Rock, Pop' END AS notes FROM customer""")
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    base = load(spark, sf_dir, "customer")
    known = base.select(F.lit("artist").alias("type"), k.alias("id"), F.lit("old").alias("enrichment_status"), F.lit(None).cast("string").alias("enrichment_date"), F.lit(None).cast("string").alias("enrichment_data"))
    matched = k % 7 == 0
    results = base.where(k % 5 != 0).select(
        F.lit("artist").alias("type"), k.alias("id"), (k % 3 == 0).alias("suppressed"), F.when(matched & (k % 4 != 0), "matched").otherwise("not_found").alias("facebook_status"), F.when(matched & (k % 4 != 0), "http://facebook.com/a").alias("facebook_url"), F.lit(0.87).alias("facebook_confidence"),
        F.lit("").alias("bio"), F.lit(None).cast("string").alias("website"), F.when(k % 4 != 0, F.array(F.lit("Rock"), F.lit("Pop"))).alias("genres"), F.lit("").alias("artist_type"), F.array().cast("array<string>").alias("act_types"),
        F.when(k % 2 == 0, 0.85).otherwise(0.59).alias("identity_confidence"), F.lit("2026-01-01").alias("retrieved_at"),
    )
    out = enrich.write_back(known, results)
    part = lambda key: F.get_json_object("enrichment_data", f"$.{key}").alias(key)
    return out.select("id", "enrichment_status", part("confidence"), part("notes"))


@query("""WITH e AS (SELECT c_custkey AS k, c_custkey % 50 AS subject, c_custkey < 50 AS is_subject, c_custkey % 4 <> 0 AS gap FROM customer), v AS (SELECT o_custkey % 50 AS subject, o_custkey AS n FROM orders WHERE o_orderkey % 3 = 0)
    SELECT k AS id FROM e WHERE gap AND subject % 2 = 0 AND subject IN (SELECT subject FROM v) AND (is_subject OR EXISTS (SELECT 1 FROM v WHERE v.subject = e.subject AND v.n = e.k))""")
def rich_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    done = k % 4 == 0
    rows = load(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 50).alias("subject_id"), (k < 50).alias("is_subject"), text(" Name ", k).alias("name"), F.lit("artist").alias("entity_type"), done.alias("facebook_searched"), F.when(done, "matched").alias("facebook_status"),
        F.when(done, "http://f").alias("facebook_url"), F.when(done, "bio").alias("bio"), done.alias("has_profile"),
    )
    events = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 50).alias("subject_id"), text("NAME ", F.col("o_custkey")).alias("artist_name"), F.lit("nowhere").alias("venue_name"))
    eligible = rows.select("subject_id", (F.col("subject_id") % 2 == 0).alias("auto_enrich")).distinct()
    return enrich.rich_targets(rows, eligible, events).select("id")


@query("""WITH o AS (SELECT c_custkey AS index, c_name AS value FROM customer), r AS (SELECT o_custkey AS index, o_orderkey AS seq, 'v' || o_orderkey AS value FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT -1, 0, 'x')
    SELECT o.index, coalesce(arg_max(r.value, r.seq), any_value(o.value)) AS value FROM o LEFT JOIN r ON o.index = r.index GROUP BY o.index""")
def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index"), F.col("c_name").alias("value"))
    results = load(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("index"), F.col("o_orderkey").alias("seq"), text("v", F.col("o_orderkey")).alias("value"))
    other = spark.range(1).select(F.lit(-1).cast("long").alias("index"), F.lit(0).cast("long").alias("seq"), F.lit("x").alias("value"))
    return enrich.applied(originals, results.unionByName(other), ["value"])


@query("""WITH l AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, 'https://www.facebook.com/p' || k || ',https://FACEBOOK.com/q' AS pages, CASE WHEN k % 2 = 0 THEN 'https://www.act' || k || '.org' ELSE '' END AS sites, 'https://m.facebook.com/events/' || k || '/,http://facebook.com/events/x' AS events FROM l""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    links = F.array(text("https://www.facebook.com/p", k, "?x=1"), F.lit("https://facebook.com/search?q=1"), text("https://www.facebook.com/p", k, "/"), F.lit("https://FACEBOOK.com/q/"), F.when(k % 2 == 0, text("https://www.Act", k, ".org/about")).otherwise("https://songkick.com/act"))
    page = text("<a href='https://m.facebook.com/events/", k, "/'> http://facebook.com/events/x <b>https://m.facebook.com/events/", k, "/</b>")
    rows = load(spark, sf_dir, "customer").select("c_custkey", links.alias("links"), page.alias("page"), text("Act ", k).alias("name"))
    join = lambda c: F.array_join(c, ",")
    return rows.select("c_custkey", join(tx.page_urls(F.col("links"))).alias("pages"), join(tx.own_sites(F.col("links"), F.col("name"))).alias("sites"), join(tx.event_links(F.col("page"))).alias("events"))


@query("""SELECT o_orderstatus AS grp, count(*) AS n, min(o_orderkey) AS first FROM (SELECT DISTINCT o_orderstatus, o_orderkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1""")
def prompt_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("k")).distinct()
    made = enrich.prompt_targets(rows, "grp", "k", ["k"]).withColumn("t", F.from_json("targets", "array<struct<index:long,k:long>>"))
    # The list is numbered from 0 in the order of its keys.
    good = F.forall("t", lambda x: (x["index"] == 0) | (x["k"] > F.element_at(F.col("t"), x["index"].cast("int"))["k"]))
    return made.select("grp", F.when(good, F.size("t")).cast("long").alias("n"), F.element_at("t", 1)["k"].alias("first"))
