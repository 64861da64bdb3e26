"""Queries of the sources: listings, sheets, dates and times, runs and their state, captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import text as tx
from claimspark.functions import times
from claimspark.operators import assess, captures, listings, reconcile, runs, tabular
from claimspark.plans.registry import listed, load, pick, query, text

SITE = listings.Site(aliases=(("brand#11", "The Eleven"), ("brand#12", "The Dozen")), flagged=("brand#13",), locality="Town", region="Region")
#: Lines of a listing ({n}: a part's name, {b}: its brand), and what is to become of each: reason, artist, time.
LINES = (
    ("{n} - {b}", None, "{n}", None), ("{n} from 8pm - {b}", None, "{n}", "20:00"), ("- {b}", "venue_only", None, None), ("{n} at {b}, 8:30pm", None, "{n}", "20:30"), ("{b}, 9pm", "venue_only", None, None),
    ("Reserved - {b}", "placeholder_performer", None, None), ("Blues Jam at {b}", "jam_night", None, None), ("Open Mic - {b}", "generic_recurring", None, None), ("DJ Ann - {b}", "generic_dj", None, None),
    ("Email: {n}", "", None, None), ("{n}", "", None, None), ("8pm - {b}", "time_not_artist", None, None), ("Friday 21st August {n} - {b}", "footer_date_row", None, None), ("{n} at looking for a venue", "placeholder_venue", None, None),
    ("{n} at {b} - reserved", None, "{n} at {b}", None), ("{n} 19:45pm - {b}", None, "{n}", "19:45"), ("Karaoke 7pm - {b}", "generic_recurring", None, None), ("TBC - {b}", "placeholder_performer", None, None),
)
HEADS = ("Friday 21st August", "SATURDAY 1st march", "Monday 3rd Foo")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each part size: its parts are lines, every twentieth of them a day's header."""
    k = F.col("p_partkey")
    body = F.replace(F.replace(pick([x[0] for x in LINES], k % len(LINES)), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))
    body = F.when(k % 20 == 0, pick(HEADS, (k / 20).cast("long") % 3)).otherwise(body)
    return load(spark, sf_dir, "part").select(F.col("p_size").alias("page"), k.alias("line"), body.alias("body"))


def _cases(column: int, missing: str = "NULL") -> str:
    return " ".join(f"WHEN {n} THEN " + (missing if x[column] is None else "'" + x[column].replace("'", "''") + "'") for n, x in enumerate(LINES))


# Line 14 has a dash, so that it reads artist and place around it: the place is "reserved".
_LINES = rf"""l AS (SELECT p_size AS page, p_partkey AS line, p_name AS n, p_brand AS b, p_partkey % {len(LINES)} AS form, p_partkey % 20 = 0 AS head, (p_partkey // 20) % 3 AS day FROM part),
    d AS (SELECT *, last_value(CASE WHEN head THEN ({listed(('2026-08-21', '2026-03-01', ''))})[1 + day] END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS date FROM l),
    c AS (SELECT page, line, date, b, n, form, CASE WHEN form IN (0, 1, 3, 11, 12, 15) AND lower(b) LIKE '%brand#13%' THEN 'venue_geocode_risk' ELSE CASE form {_cases(1)} END END AS reason,
        replace(replace(CASE form {_cases(2)} END, '{{n}}', n), '{{b}}', b) AS artist, CASE form {_cases(3)} END AS time, CASE WHEN form = 14 THEN 'reserved' ELSE b END AS venue FROM d WHERE NOT head AND date <> ''),
    found AS (SELECT * FROM c WHERE reason IS NULL OR reason <> '')"""
_SLUG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query(f"WITH {_LINES} SELECT reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY reason")
def parked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings.listed(page_lines(spark, sf_dir), "page", "line", "body", 2026, SITE)
    return assess.parked_counts(listings.parked(listings.gate(found)))


@query(f"""WITH {_LINES}, e AS (SELECT *, CASE lower(b) WHEN 'brand#11' THEN 'The Eleven' WHEN 'brand#12' THEN 'The Dozen' ELSE venue END AS place FROM found WHERE reason IS NULL)
    SELECT page, line, date, artist AS artist_name, CASE WHEN form = 14 THEN venue ELSE place END AS venue_name, coalesce(time, '20:00') AS start_time, time IS NULL AS time_defaulted,
        date || '_' || {_SLUG.format(x='artist')} || '_' || {_SLUG.format(x='CASE WHEN form = 14 THEN venue ELSE place END')} AS source_event_key FROM e""")
def listing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = listings.listed(page_lines(spark, sf_dir), "page", "line", "body", 2026, SITE)
    return listings.listed_events(found, SITE, ("page", "line")).select("page", "line", "date", "artist_name", "venue_name", "start_time", "time_defaulted", "source_event_key")


@query(f"WITH {_LINES} SELECT count(*) FILTER (reason IS NULL AND time IS NULL) AS defaulted, count(*) FILTER (reason IS NULL AND time IS NULL) || ' time(s) defaulted to 20:00' AS warning FROM found")
def defaulted_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.defaulted_warning(listings.listed_events(listings.listed(page_lines(spark, sf_dir), "page", "line", "body", 2026, SITE), SITE), SITE)


#: Ways to write the date {y}-{m}-{d}: Spark's text and the SQL that says what it is.
DATES = (
    ("{y}-{mm}-{dd}", True), ("{y}-{m}-{d}", True), ("{d}/{m}/{y}", True), ("{dd}.{mm}.{yy}", True), ("{d}-{m}-{yy}", True), ("{d} {name} {y}", True), ("{name} {d}, {y}", True), ("{d} {short} {y}", True), ("1/1/1899", False),
    ("31/02/2026", False), ("soon", False), ("", False), ("{m}/{y}", False), ("{d}/{m}/{y}x", False), (" {d}/{m}/{y} ", True), ("{d}/{m}/19{yy}", False),
)


@query(f"SELECT o_orderkey, CASE WHEN ({'[' + ', '.join(str(ok).lower() for _, ok in DATES) + ']'})[1 + o_orderkey % {len(DATES)}] THEN o_orderdate::DATE + INTERVAL 30 YEARS END::DATE AS date FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.add_months(F.to_date("o_orderdate"), 360)
    written = pick([x[0] for x in DATES], F.col("o_orderkey") % len(DATES))
    for mark, form in (("{dd}", "dd"), ("{d}", "d"), ("{mm}", "MM"), ("{m}", "M"), ("{yy}", "yy"), ("{y}", "yyyy"), ("{name}", "MMMM"), ("{short}", "MMM")):
        written = F.replace(written, F.lit(mark), F.date_format(day, form))
    return load(spark, sf_dir, "orders").select("o_orderkey", times.uk_date(written).alias("date"))


#: Stage times and what they mean: (text, time, defaulted). {h} is an hour from 1 to 11, {H} the same in the evening.
STAGE = (
    ("{h}pm", "{H}:00", False), ("{h}", "{H}:00", False), ("{h}:30", "{H}:30", False), ("20:30:00", "20:30", False), ("(8pm)", "20:00", False), ("Matinee {h}:15 - 6", "{H}:15", False), ("{h}pm to 11pm", "{H}:00", False),
    ("{h}.45pm - late", "{H}:45", False), ("8.30pm £5 entry", "20:30", False), ("9pm, free entry", "21:00", False), ("", "21:00", True), ("TBC", "21:00", True), ("£10", "21:00", True), ("7:12", "21:00", True), ("07:12:00 am", "21:00", True),
    ("21 August 2026", "21:00", True), ("late", "21:00", True), ("25:00", "21:00", True), ("12am", "00:00", False), ("12:30", "12:30", False), ("14:00am", "14:00", False), ("0:15", "00:15", False),
)


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, (l_orderkey * 7 + l_linenumber) % {len(STAGE)} AS form, 1 + l_orderkey % 11 AS h FROM lineitem)
    SELECT l_orderkey, l_linenumber, replace(({listed([x[1] for x in STAGE])})[1 + form], '{{H}}', (12 + h)::VARCHAR) AS time, ({'[' + ', '.join(str(x[2]).lower() for x in STAGE) + ']'})[1 + form] AS defaulted FROM l""")
def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, hour = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % len(STAGE), 1 + F.col("l_orderkey") % 11
    written = F.replace(pick([x[0] for x in STAGE], form), F.lit("{h}"), hour.cast("string"))
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", written.alias("w")).distinct()
    return rows.select("l_orderkey", "l_linenumber", times.stage_time(F.col("w")).alias("t")).select("l_orderkey", "l_linenumber", "t.time", "t.defaulted")


ZONES, CADENCES = ["Europe/London", "America/New_York", "Asia/Kolkata"], ["daily", "twice-daily", "weekly", "manual"]


@query(f"""WITH s AS (SELECT p_partkey AS id, ({listed(ZONES)})[1 + p_partkey % 3] AS zone, ({listed(CADENCES)})[1 + (p_partkey // 3) % 4] AS cadence, p_partkey % 24 AS h, p_partkey % 60 AS m, TIMESTAMP '2026-06-01 05:00:00' + INTERVAL 1 DAY * (p_partkey % 7) AS anchor FROM part),
    d AS (SELECT *, (timezone(zone, TIMESTAMPTZ '2026-06-10 11:30:00+00'))::DATE + k::INT AS day FROM s, (SELECT unnest(range(-1, 9)) AS k)),
    t AS (SELECT id, timezone(zone, day + INTERVAL 1 MINUTE * (h * 60 + m + late)) AS slot FROM d, (SELECT unnest([0, 720]) AS late) WHERE (late = 0 OR cadence = 'twice-daily') AND cadence <> 'manual' AND (cadence <> 'weekly' OR dayofweek(day) = dayofweek(timezone(zone, anchor::TIMESTAMPTZ))))
    SELECT s.id, (SELECT strftime(min(slot), '%Y-%m-%d %H:%M') FROM t WHERE t.id = s.id AND slot > TIMESTAMPTZ '2026-06-10 11:30:00+00') AS next_scan FROM s""")
def schedule_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    at = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    anchor = F.to_timestamp(F.lit("2026-06-01 05:00:00")) + F.make_dt_interval((k % 7).cast("int"))
    rows = load(spark, sf_dir, "part").select(k.alias("id"), pick(ZONES, k % 3).alias("timezone"), pick(CADENCES, (k / 3).cast("long") % 4).alias("cadence"), at.alias("local_time"), anchor.alias("next_scan_at"))
    return times.next_scan(rows, F.to_timestamp(F.lit("2026-06-10 11:30:00"))).select("id", F.date_format("next_scan", "yyyy-MM-dd HH:mm").alias("next_scan"))


SHEET_VENUES = ["{n}, Hanley", "{n} in Leek", "The {n}", "Eleven {n}, Crewe", "{n}  Arms,   Stone", "you can add {n}"]


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a sheet out of parts: dates, artists, places, times, some of each unusable."""
    k = F.col("p_partkey")
    when = F.when(k % 5 == 0, "1/1/1899").when(k % 5 == 1, "2026-08-21").when(k % 5 == 2, "21/8/26").when(k % 5 == 3, "1/1/2025").otherwise("August 21, 2026")
    venue = F.replace(pick(SHEET_VENUES, k % len(SHEET_VENUES)), F.lit("{n}"), F.col("p_name"))
    return load(spark, sf_dir, "part").select(
        (k + 1).alias("row_index"), when.alias("date"), F.when(k % 11 == 0, " ").otherwise(text(" Act ", k % 40, " ")).alias("artist"), venue.alias("venue"), F.when(k % 3 == 0, "8pm").otherwise("").alias("time"),
        F.when(k % 2 == 0, "Rock").otherwise("").alias("genre"), F.when(k % 4 == 0, "https://e.org/").otherwise("x").alias("url"),
    )


_SHEET = f"""s AS (SELECT p_partkey AS k, 'Act ' || (p_partkey % 40) AS artist_name, replace(({listed(SHEET_VENUES)})[1 + p_partkey % 6], '{{n}}', p_name) AS raw FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 5 IN (1, 2, 4) AND p_partkey % 6 <> 5),
    e AS (SELECT k, artist_name, regexp_replace(trim(raw), '\\s+', ' ', 'g') AS venue_name, '2026-08-21' AS date, CASE WHEN k % 3 = 0 THEN '20:00' ELSE '21:00' END AS start_time, k % 3 <> 0 AS start_time_defaulted,
        ({listed(('Stoke-on-Trent', 'Leek', 'Stoke-on-Trent', 'Crewe', 'Stone', ''))})[1 + k % 6] AS town, k % 6 = 2 AS town_defaulted, CASE WHEN k % 2 = 0 THEN 'Rock' END AS genre, CASE WHEN k % 4 = 0 THEN 'https://e.org/' END AS event_url FROM s)"""


@query(f"""WITH {_SHEET} SELECT 'sheet-' || sha256(date || '|' || lower(venue_name) || '|' || lower(artist_name))[1:12] AS source_event_key, 'row:' || (k + 1) AS raw_row_ref, date, start_time, start_time_defaulted, artist_name, venue_name, town, genre, event_url,
    'sheet-artist-' || sha256(lower(artist_name))[1:12] AS artist_external_id, concat_ws('; ', CASE WHEN start_time_defaulted THEN 'Missing stage time' END, CASE WHEN town_defaulted THEN 'Town defaulted to Stoke-on-Trent for ''' || venue_name || '''' END) AS warnings FROM e""")
def sheet_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tabular.normalised(sheet(spark, sf_dir), F.to_date(F.lit("2026-08-01")))
    return out.select("source_event_key", "raw_row_ref", "date", "start_time", "start_time_defaulted", "artist_name", "venue_name", "town", "genre", "event_url", "artist_external_id", F.array_join("warnings", "; ").alias("warnings"))


@query(f"""WITH {_SHEET}, k AS (SELECT *, 'sheet-' || sha256(date || '|' || lower(venue_name) || '|' || lower(artist_name))[1:12] AS ev, 'artist:sheet-artist-' || sha256(lower(artist_name))[1:12] AS a, 'venue:sheet-venue-' || sha256(lower(venue_name))[1:12] AS v FROM e),
    c AS (SELECT 'row:' || (k + 1) AS evidence, unnest([{{'s': a, 'p': 'hasName', 'v': artist_name, 'j': false}}, {{'s': a, 'p': 'hasGenre', 'v': genre, 'j': false}}, {{'s': v, 'p': 'hasName', 'v': venue_name, 'j': false}}, {{'s': v, 'p': 'locatedIn', 'v': town, 'j': false}},
        {{'s': 'event:' || ev, 'p': 'hasPerformer', 'v': '{{"type":"artist-candidate","key":"' || a || '"}}', 'j': true}}, {{'s': 'event:' || ev, 'p': 'hasPerformerName', 'v': artist_name, 'j': false}}, {{'s': 'event:' || ev, 'p': 'occursAt', 'v': '{{"type":"venue-candidate","key":"' || v || '"}}', 'j': true}},
        {{'s': 'event:' || ev, 'p': 'hasVenueName', 'v': venue_name, 'j': false}}, {{'s': 'event:' || ev, 'p': 'occursOn', 'v': date, 'j': false}}, {{'s': 'event:' || ev, 'p': 'startsAt', 'v': start_time, 'j': false}}, {{'s': 'event:' || ev, 'p': 'hasStatus', 'v': 'scheduled', 'j': false}},
        {{'s': 'event:' || ev, 'p': 'reportedBy', 'v': 'sheet', 'j': false}}, {{'s': 'event:' || ev, 'p': 'derivedFrom', 'v': 'obs-1', 'j': false}}, {{'s': 'event:' || ev, 'p': 'hasEventUrl', 'v': event_url, 'j': false}}]) AS x FROM k)
    SELECT evidence, x.s AS subject, x.p AS predicate, x.v AS value, 'claim-' || sha256('obs-1|' || x.s || '|' || x.p || '|' || CASE WHEN x.j THEN x.v ELSE '"' || x.v || '"' END)[1:24] AS claim_id FROM c WHERE x.v IS NOT NULL""")
def sheet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.claims(tabular.normalised(sheet(spark, sf_dir), F.to_date(F.lit("2026-08-01"))), "obs-1", "sheet").select("evidence", "subject", "predicate", "value", "claim_id")


@query(f"""WITH v AS (SELECT p_partkey, p_partkey % 6 AS f, p_name AS n FROM part)
    SELECT p_partkey, ({listed(('Staffordshire', 'Staffordshire', 'Staffordshire', 'Cheshire', 'Staffordshire', 'Staffordshire'))})[1 + f] AS region, CASE f WHEN 0 THEN 'Hanley' WHEN 1 THEN 'Leek' WHEN 3 THEN 'Crewe' WHEN 4 THEN 'Stone' ELSE '' END AS city, f = 3 AS specialist FROM v""")
def region_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet(spark, sf_dir).select((F.col("row_index") - 1).alias("p_partkey"), tabular.region(F.col("venue")).alias("r"), tabular.specialist(tx.place_slug(F.col("venue"))).alias("specialist"))
    return rows.select("p_partkey", "r.region", "r.city", "specialist")


@query(f"""WITH {_SHEET}, a AS (SELECT 'The ' || p_name AS variant, min(p_partkey) AS id FROM part WHERE p_partkey % 4 = 0 GROUP BY 1),
    slugs AS (SELECT regexp_replace(regexp_replace(lower(variant), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, max('V' || id) AS id FROM a GROUP BY 1),
    j AS (SELECT k, town_defaulted, regexp_replace(regexp_replace(lower(venue_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM e)
    SELECT k, id AS trusted_id, CASE WHEN town_defaulted AND id IS NULL THEN 'defaulted town without trusted place' WHEN starts_with(slug, 'eleven') OR starts_with(slug, 'artisan-tap') THEN 'specialist place' END AS refusal FROM j LEFT JOIN slugs USING (slug)""")
def venue_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tabular.normalised(sheet(spark, sf_dir), F.to_date(F.lit("2026-08-01")))
    part = load(spark, sf_dir, "part").where("p_partkey % 4 = 0").groupBy(text("The ", F.col("p_name")).alias("variant")).agg(F.min("p_partkey").alias("id"))
    known = part.select("variant", F.col("variant").alias("canonical"), text("V", F.col("id")).alias("trusted_id"))
    rows = tabular.aliased(events, known).withColumns({"town_defaulted": tabular.town(F.col("venue_name"))["defaulted"], "venue_slug": tx.place_slug(F.col("venue_name"))})
    return tabular.additive(rows).select((F.regexp_extract("raw_row_ref", "([0-9]+)$", 1).cast("long") - 1).alias("k"), "trusted_id", "refusal")


def past_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs out of events: one each, of the user as source; purchases fail, views are incomplete."""
    at = F.col("ts").cast("string")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("run_id"), at.alias("started_at"), (F.col("event_type") != "purchase").alias("ok"), (F.col("event_type") != "view").alias("complete"))


_RUNS = "r AS (SELECT user_id AS source_id, event_id AS run_id, ts AS started_at, event_type <> 'purchase' AS ok, event_type <> 'view' AS complete FROM events)"


@query(f"""WITH {_RUNS}, a AS (SELECT source_id, max(started_at) AS started_at, source_id % 2 = 0 AS complete, CASE WHEN source_id % 3 = 0 THEN 'append-only' ELSE 'delta' END AS mode FROM r GROUP BY source_id)
    SELECT a.source_id, max_by(r.run_id, (r.started_at, r.run_id)) AS baseline FROM a LEFT JOIN r ON r.source_id = a.source_id AND r.ok AND r.started_at < a.started_at AND (NOT (a.complete AND a.mode = 'delta') OR r.complete) GROUP BY a.source_id""")
def baseline_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = past_runs(spark, sf_dir)
    s = F.col("source_id")
    asked = rows.groupBy("source_id").agg(F.max("started_at").alias("started_at")).withColumns({"complete": s % 2 == 0, "mode": F.when(s % 3 == 0, "append-only").otherwise("delta"), "semantics": F.lit("complete")})
    return runs.baselines(rows.where("ok"), asked).select("source_id", "baseline")


@query(f"""WITH {_RUNS}, n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1), s AS (SELECT DISTINCT source_id FROM r WHERE source_id % 2 = 0)
    SELECT n.source_id, CASE WHEN ok THEN run_id WHEN s.source_id IS NOT NULL THEN -1 END AS last_observation, CASE WHEN ok AND complete THEN run_id WHEN s.source_id IS NOT NULL THEN -2 END AS last_complete_observation, CASE WHEN ok THEN 0 WHEN s.source_id IS NOT NULL THEN 5 ELSE 1 END AS consecutive_failures
    FROM n LEFT JOIN s USING (source_id)""")
def run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = past_runs(spark, sf_dir).withColumns({"observation": F.col("run_id"), "normalised": F.col("run_id")})
    text_null = F.lit(None).cast("string")
    state = rows.where("source_id % 2 = 0").select("source_id").distinct().select(
        "source_id", F.lit(-1).cast("long").alias("last_observation"), F.lit(-2).cast("long").alias("last_complete_observation"), F.lit(-1).cast("long").alias("last_normalised"), F.lit(-2).cast("long").alias("last_complete_normalised"),
        *(text_null.alias(c) for c in ("last_run_at", "last_success_at", "last_failure_at")), F.lit(4).cast("long").alias("consecutive_failures"),
    )
    return runs.run_state(state, runs.newest_runs(rows)).select("source_id", "last_observation", "last_complete_observation", "consecutive_failures")


@query(f"WITH {_RUNS}, l AS (SELECT source_id, max((started_at, run_id)) FILTER (ok) AS last FROM r GROUP BY source_id) SELECT l.source_id, count(r.run_id) AS consecutive_failures FROM l LEFT JOIN r ON r.source_id = l.source_id AND (l.last IS NULL OR (r.started_at, r.run_id) > l.last) GROUP BY l.source_id")
def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream of runs keeps as failures in a row, as one batch."""
    return runs.failures_in_a_row(past_runs(spark, sf_dir), "source_id", "started_at", F.col("ok"), "run_id")


_DIFF = """d AS (SELECT o_custkey % 10 AS source_id, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'withdrawn' WHEN o_orderkey % 5 = 1 THEN 'updated' ELSE 'unchanged' END AS action, o_orderkey AS k FROM orders)"""


@query(f"""WITH {_DIFF}, n AS (SELECT source_id, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'withdrawn') AS withdrawn, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action <> 'withdrawn') AS valid_events,
        3 * count(*) AS claims, count(*) FILTER (action <> 'unchanged') AS projection_work_items FROM d GROUP BY source_id), p AS (SELECT c_custkey % 11 AS source_id, count(*) AS parked FROM customer GROUP BY 1)
    SELECT coalesce(n.source_id, p.source_id) AS source_id, coalesce(added, 0) AS added, coalesce(updated, 0) AS updated, coalesce(withdrawn, 0) AS withdrawn, coalesce(unchanged, 0) AS unchanged, coalesce(valid_events, 0) AS valid_events, coalesce(claims, 0) AS claims, coalesce(parked, 0) AS parked,
        coalesce(projection_work_items, 0) AS projection_work_items, coalesce(valid_events, 0) + coalesce(parked, 0) AS raw_items FROM n FULL JOIN p ON n.source_id = p.source_id""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    action = F.when(k % 10 == 0, "added").when(k % 7 == 0, "withdrawn").when(k % 5 == 1, "updated").otherwise("unchanged")
    diff = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("source_id"), action.alias("action"))
    made = diff.select("source_id", F.explode(F.array(*map(F.lit, "abc"))).alias("claim"))
    parked = load(spark, sf_dir, "customer").select((F.col("c_custkey") % 11).alias("source_id"))
    return runs.report(diff, made, parked, diff.where("action <> 'unchanged'"))


@query("""WITH e AS (SELECT o_orderstatus AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders), r AS (SELECT unnest(['F', 'O', 'P', 'none']) AS run_id)
    SELECT r.run_id, sha256('page ' || r.run_id) AS capture_hash, count(e.run_id) AS item_count, count(e.run_id) FILTER (d IS NULL OR d >= DATE '1996-01-01') AS future_item_count FROM r LEFT JOIN e USING (run_id) GROUP BY r.run_id""")
def observation_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run_id"), F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate").cast("string")).alias("date"))
    known = load(spark, sf_dir, "orders").select("o_orderstatus").distinct().select(F.col("o_orderstatus").alias("run_id")).union(spark.range(1).select(F.lit("none")))
    asked = known.select("run_id", F.lit("desk").alias("source_id"), F.lit("1996-01-01T00:00:00Z").alias("observed_at"), F.concat(F.lit("page "), "run_id").alias("body"), F.lit(True).alias("complete"), F.lit("1996-01-01").alias("run_date"))
    return runs.observations(events, asked).select("run_id", "capture_hash", "item_count", "future_item_count")


@query("SELECT 's' || p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN 'browser' ELSE 'standard' END AS queue, 'scheduled' AS reason FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AND DATE '2026-01-01' + p_size <= DATE '2026-01-20' ORDER BY DATE '2026-01-01' + p_size, 's' || p_partkey LIMIT 100")
def dispatch_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.dispatch(schedule(spark, sf_dir), F.lit("2026-01-20")).select("source_id", "queue", "reason")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    due = F.date_add(F.to_date(F.lit("2026-01-01")), F.col("p_size"))
    return load(spark, sf_dir, "part").select(text("s", k).alias("source_id"), (k % 4 != 0).alias("enabled"), F.when(k % 3 == 0, "browser").otherwise("standard").alias("runtime"), due.cast("string").alias("next_scan_at"), F.when(k % 5 != 0, F.date_add(due, 1).cast("string")).alias("next_scan"))


@query("""WITH s AS (SELECT 's' || p_partkey AS source_id, p_partkey % 4 <> 0 AS enabled, p_partkey % 6 AS stale, (DATE '2026-01-01' + p_size)::VARCHAR AS due, (DATE '2026-01-02' + p_size)::VARCHAR AS next FROM part WHERE p_partkey % 5 <> 0)
    SELECT source_id, CASE WHEN enabled AND stale <> 0 THEN 'enqueued' ELSE 'stale' END AS outcome, CASE WHEN enabled AND stale <> 0 THEN next ELSE due END AS next_scan_at FROM s""")
def schedule_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schedule(spark, sf_dir)
    wanted = rows.where("next_scan is not null")
    number = F.regexp_extract("source_id", "([0-9]+)$", 1).cast("long")
    moves = wanted.select("source_id", F.when(number % 6 == 0, "1999-01-01").otherwise(F.col("next_scan_at")).alias("expected"), "next_scan")
    moved, outcome = runs.advance(rows, moves)
    return outcome.join(moved.select("source_id", "next_scan_at"), "source_id").select("source_id", "outcome", "next_scan_at")


_CAPTURES = """c AS (SELECT page_id AS id, page_id % 13 = 0 AS test, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'https://e.org/p' || (page_id % 40) END AS url, CASE WHEN page_id % 14 = 0 THEN 's3://b/k' || (page_id % 60) END AS image, CASE WHEN page_id % 9 = 0 THEN '' ELSE lpad((page_id % 17)::VARCHAR, 2, '0') END AS got, page_id % 11 <> 0 AS claimed FROM pages),
    i AS (SELECT *, coalesce('url:' || url, 'image:' || image) AS identity FROM c), w AS (SELECT *, CASE WHEN NOT test AND identity IS NOT NULL THEN first_value(id) OVER (PARTITION BY identity, test ORDER BY got DESC, id DESC) END AS first FROM i),
    s AS (SELECT id, CASE WHEN test THEN 'ignored' WHEN identity IS NULL THEN 'failed' WHEN first <> id THEN 'duplicate' WHEN claimed THEN 'queued' ELSE 'skipped' END AS outcome, CASE WHEN first <> id THEN first END AS duplicate_of FROM w)"""


@query(f"WITH {_CAPTURES} SELECT id, outcome, duplicate_of FROM s")
def capture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).select("id", "outcome", "duplicate_of")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    rows = load(spark, sf_dir, "pages").select(
        k.alias("id"), F.when(k % 13 == 0, "manual-test").otherwise("app").alias("source_app"), F.when(k % 7 != 0, text("HTTPS://e.org:443/p", k % 40, "/?utm_a=1")).alias("shared_url"),
        captures.stored_image(F.lit("image/png"), F.when(k % 28 == 0, "image"), F.lit("b"), text("k", k % 60), F.when(k % 14 == 0, "b"), text("k", k % 60)).alias("image"),
        F.when(k % 9 != 0, F.lpad((k % 17).cast("string"), 2, "0")).alias("received_at"), F.lit(None).cast("string").alias("captured_at"), (k % 11 != 0).alias("claimed"),
    )
    return captures.scan(rows)


@query(f"WITH {_CAPTURES} SELECT count(*) AS discovered, count(*) FILTER (outcome = 'queued') AS queued, count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'duplicate') AS duplicate FROM s")
def capture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outcome_counts(scanned(spark, sf_dir), ("queued", "ignored", "failed", "duplicate"))


STATUSES, KINDS, RESOLVERS = ["unprocessed", "processing", "processed"], ["artist", "event", "non_music", "venue"], ["matched", "created", "duplicate", "review", "none"]


@query(f"""WITH d AS (SELECT o_orderkey AS k, ({listed(STATUSES)})[1 + o_orderkey % 3] AS status, ({listed(KINDS)})[1 + (o_orderkey // 3) % 4] AS kind, o_custkey % 9 <> 0 AS artist, o_custkey % 4 AS n, o_custkey % 5 = 0 AS off, o_orderkey % 8 <> 0 AS timed, o_custkey % 6 = 0 AS bare, ({listed(RESOLVERS)})[1 + o_custkey % 5] AS resolver FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders))
    SELECT k, CASE WHEN NOT artist THEN 'artist' WHEN bare THEN 'facebookUrl, actType' ELSE '' END AS missing, o AS outcome, CASE o WHEN 'ignored' THEN 'ignored' WHEN 'review' THEN 'failed' WHEN 'processed' THEN 'processed' ELSE status END AS new_status FROM
    (SELECT *, CASE WHEN status = 'processed' THEN 'skipped' WHEN kind = 'non_music' THEN 'ignored' WHEN kind = 'venue' OR NOT artist THEN 'review' WHEN kind = 'event' AND n <> 1 THEN 'review' WHEN kind = 'event' AND NOT off AND NOT timed THEN 'retry' WHEN bare THEN 'review' WHEN resolver IN ('review', 'none') THEN 'review' ELSE 'processed' END AS o FROM d)""")
def capture_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bare = c % 6 == 0
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct().select(
        k.alias("k"), pick(STATUSES, k % 3).alias("status"), pick(KINDS, (k / 3).cast("long") % 4).alias("classification"), (c % 9 != 0).alias("has_artist"), F.lit("Act").alias("name"), F.when(~bare, "https://facebook.com/a").otherwise(" ").alias("facebook_url"),
        F.lit("Town").alias("location"), F.lit("Band").alias("artist_type"), F.when(~bare, F.array(F.lit("Covers"))).alias("act_types"), (c % 4).alias("n_events"), (c % 5 == 0).alias("cancelled"), F.when(k % 8 != 0, "20:00").alias("start_time"), pick(RESOLVERS, c % 5).alias("resolver"),
    )
    return captures.processed(rows).select("k", "missing", "outcome", "new_status")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.facebook.com/events/' || page_id WHEN 1 THEN 'https://facebook.com/share/' || page_id ELSE (CASE page_id % 4 WHEN 2 THEN 'https://facebook.com/events/' ELSE 'https://e.org/' END) || page_id END AS url, CASE page_id % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'unknown' WHEN 2 THEN 'event' ELSE 'url' END AS object FROM pages")
def share_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 4 < 2, text("https://facebook.com/share/", k)).when(k % 4 == 2, text("https://facebook.com/events/", k)).otherwise(text("https://e.org/", k))
    after = F.when(k % 4 == 0, text("https://www.facebook.com/events/", k)).when(k % 4 == 1, "https://e.org/login").otherwise("https://facebook.com/other")
    kind = tx.refined_kind(tx.target_kind(F.col("u")), F.col("r"))
    rows = load(spark, sf_dir, "pages").select("page_id", url.alias("u"), after.alias("r"))
    return rows.select("page_id", captures.resolved_share(F.col("u"), F.col("r")).alias("url"), tx.object_type(kind).alias("object"))


ADDRESSES = ("http://example.org/{}", "https://10.0.0.{}/", "ftp://example.org/", "http://user@example.org/", "http://localhost/x", "https://172.20.1.1/{}", "https://172.32.1.1/{}", "http://[::1]/", "http://[fe80::1]/", "http://192.169.1.1/", "http://169.254.1.1/", "https://a.localhost/")
SAFE = (True, False, False, False, False, False, True, False, False, True, False, False)


@query(f"SELECT page_id, ({'[' + ', '.join(str(s).lower() for s in SAFE) + ']'})[1 + page_id % {len(SAFE)}] AS safe FROM pages")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.replace(pick(ADDRESSES, F.col("page_id") % len(SAFE)), F.lit("{}"), (F.col("page_id") % 200).cast("string"))
    return load(spark, sf_dir, "pages").select("page_id", tx.safe_address(url).alias("safe"))


def _summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = {c: F.lit(0).cast("long") for c in reconcile.COUNTERS}
    counters |= {"claims": F.col("l_quantity").cast("long"), "events_created": (F.col("l_returnflag") == "N").cast("long")}
    lines = load(spark, sf_dir, "lineitem")
    error = F.when(F.col("l_returnflag") == "R", text("e", F.col("l_linenumber")))
    return lines.select(F.col("l_orderkey").alias("observation_id"), F.col("l_linenumber").alias("idempotency_key"), F.col("l_shipdate").cast("string").alias("completed_at"), (F.col("l_orderkey") % 4 + 1).alias("expected_items"), error.alias("error"), *(c.alias(n) for n, c in counters.items()))


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS i, l_shipdate::VARCHAR AS t, 1 + l_orderkey % 4 AS x, CASE WHEN l_returnflag = 'R' THEN 'e' || l_linenumber END AS e, l_quantity::BIGINT AS q, (l_returnflag = 'N')::INT AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, e NULLS FIRST, q, n) = 1)
    SELECT o AS observation_id, count(*) AS items_seen, sum(q)::BIGINT AS claims, sum(n)::BIGINT AS events_created, count(e) AS projection_failures, CASE WHEN count(*) >= max(x) AND count(e) = 0 THEN 'success' ELSE 'partial' END AS status,
        count(*) >= max(x) AS done, coalesce(string_agg(e, ',' ORDER BY i), '') AS errors FROM l GROUP BY o""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reconcile.run_summary(_summary_rows(spark, sf_dir))
    return out.select("observation_id", "items_seen", "claims", "events_created", "projection_failures", "status", F.col("completed_at").isNotNull().alias("done"), F.array_join("errors", ",").alias("errors"))


@query("SELECT 'i' || lpad(o_orderkey::VARCHAR, 12, '0') AS idempotency_key, row_number() OVER (ORDER BY 'i' || lpad(o_orderkey::VARCHAR, 12, '0')) AS run_ordinal, count(*) OVER () AS run_item_count FROM (SELECT DISTINCT o_orderkey FROM orders)")
def run_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "orders").select(F.concat(F.lit("i"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("idempotency_key")).distinct()
    return reconcile.numbered(items).select("idempotency_key", "run_ordinal", F.col("run_item_count").cast("long").alias("run_item_count"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\s+in\s+(\w+)$', ', \1'), 'q', 'q') AS place, regexp_replace(p_type, '[^A-Za-z0-9._-]', '_', 'g') AS segment, p_partkey::VARCHAR AS bare, CASE WHEN length(p_name) > 12 THEN p_name[1:12] || '…' ELSE p_name END AS short,
    string_split(p_name, ' ')[-1] AS locality, CASE p_partkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'html' ELSE 'text' END AS kind FROM part""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mime = F.when(k % 3 == 0, "text/CSV; x").when(k % 3 == 1, "text/html").otherwise("image/png")
    return load(spark, sf_dir, "part").select(
        "p_partkey", tx.place_name(F.concat(F.lit("  "), F.col("p_name"), F.lit(" SK1 3XX"))).alias("place"), tx.safe_segment(F.col("p_type")).alias("segment"), tx.without_prefix(text("event:s:", k), F.lit("event:s:")).alias("bare"),
        tx.shortened(F.col("p_name"), 12).alias("short"), tx.last_word(F.col("p_name"), "none").alias("locality"), tx.content_kind(mime).alias("kind"),
    )
