"""Registered queries of the reconciliation operators on the driver's tables, with their SQL; further ones are in the modules named at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import text, times
from claimspark.operators import access, assess, claims, reconcile
from claimspark.plans.registry import ORACLES, QUERIES, load, pick, query
from claimspark.sources.shared import kept

ORDERS_KEY = ["o_orderkey"]
RUN_DATE = "DATE '1998-01-01'"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _named(name: str, f):  # noqa: ANN001, ANN202
    """The same query under another name."""

    def same(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(spark, sf_dir)

    same.__name__ = name
    return same


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of orders: the later one lacks some, has others, and some with another status."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("priority"))
    printed = lambda df: df.withColumn("print", reconcile.fingerprint("status", "date", "priority"))
    before = printed(orders.where("key % 10 <> 0"))
    after = printed(orders.where("key % 7 <> 0").withColumn("status", F.when(F.col("key") % 5 == 1, "X").otherwise(F.col("status"))))
    unique = lambda df: reconcile.first_per_key(df, ["key"], F.col("print"))
    return unique(before), unique(after)


def diff(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    before, after = snapshots(spark, sf_dir)
    return reconcile.snapshot_diff(before, after, F.to_date(F.lit("1998-01-01")), complete)


def diff_sql(gone: str = f"CASE WHEN b.d < {RUN_DATE} THEN 'pastDropped' ELSE 'withdrawn' END") -> str:
    print_ = "sha256(concat('date=', o_orderdate::DATE::VARCHAR, chr(31), 'priority=', o_orderpriority, chr(31), 'status=', {s}, chr(31)))"
    late = "CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END"
    return f"""b AS (SELECT o_orderkey AS key, min({print_.format(s='o_orderstatus')}) AS p, arg_min(o_orderdate::DATE, {print_.format(s='o_orderstatus')}) AS d FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY 1),
        a AS (SELECT o_orderkey AS key, min({print_.format(s=late)}) AS p, arg_min(o_orderdate::DATE, {print_.format(s=late)}) AS d FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1),
        diff AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.d, b.d) AS date, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN {gone} WHEN a.p = b.p THEN 'unchanged' ELSE 'updated' END AS action FROM b FULL JOIN a ON a.key = b.key)"""


@query(f"WITH {diff_sql()} SELECT key, action, date FROM diff")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir)


@query(f"WITH {diff_sql()} SELECT action, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM diff GROUP BY action")
def snapshot_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(f"WITH {diff_sql("'ignoredAbsence'")} SELECT key, action, date FROM diff")
def snapshot_diff_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(spark, sf_dir, complete=False)


@query(f"""WITH {diff_sql()}, w AS (SELECT 'event:orders:' || key AS candidate, CASE WHEN action IN ('added', 'updated') AND key % 4 = 0 THEN 'cancel' WHEN action = 'added' THEN 'create' WHEN action = 'updated' THEN 'update' WHEN action = 'withdrawn' THEN 'withdraw' END AS work FROM diff)
    SELECT candidate, work, 'projection-' || sha256(concat('orders', chr(31), 'obs-1', chr(31), candidate, chr(31), work))[1:32] AS id, concat_ws(':', 'orders', 'obs-1', candidate, work) AS idempotency_key FROM w WHERE work IS NOT NULL""")
def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.work_items(diff(spark, sf_dir), "orders", "obs-1", F.col("key") % 4 == 0)


@query("SELECT p_partkey, sha256(concat('p_brand=', p_brand, chr(31), 'p_name=', p_name, chr(31), 'p_size=', p_size, chr(31), 'p_type=', p_type, chr(31))) AS print FROM part")
def event_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", reconcile.fingerprint("p_name", "p_brand", "p_type", "p_size").alias("print"))


@query("""WITH c AS (SELECT 'obs-' || (o_custkey % 10) AS observation, 'event:' || o_orderkey AS subject, unnest([{'p': 'hasStatus', 'v': nullif(trim(o_orderstatus), '')}, {'p': 'occursOn', 'v': o_orderdate::DATE::VARCHAR}, {'p': 'hasTitle', 'v': CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE nullif(trim(o_orderpriority), '') END}]) AS x FROM orders)
    SELECT observation, subject, x.p AS predicate, x.v AS value, 'claim-' || sha256(concat(observation, chr(31), subject, chr(31), x.p, chr(31), '"', x.v, '"'))[1:32] AS claim_id FROM c WHERE x.v IS NOT NULL""")
def claim_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"hasStatus": F.col("o_orderstatus"), "occursOn": F.to_date("o_orderdate"), "hasTitle": F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.col("o_orderpriority"))}
    return claims.explode_claims(load(spark, sf_dir, "orders"), F.concat(F.lit("obs-"), (F.col("o_custkey") % 10).cast("string")), F.concat(F.lit("event:"), F.col("o_orderkey").cast("string")), values)


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), "value", F.col("ts").alias("observed"))


LATEST = "latest AS (SELECT event_id AS claim_id, user_id AS subject, event_type AS predicate, value, ts AS observed FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1)"


@query(f"WITH {LATEST} SELECT claim_id, subject, predicate, value FROM latest")
def latest_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.latest_claims(event_claims(spark, sf_dir), "observed", "claim_id").drop("observed")


KINDS = ["click", "purchase", "view", "signup", "search", "login", "logout"]


@query(f"WITH {LATEST} SELECT subject, {', '.join(f'max(CASE WHEN predicate = {k!r} THEN value END) AS {k}' for k in KINDS)} FROM latest GROUP BY subject")
def claim_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.pivot_claims(claims.latest_claims(event_claims(spark, sf_dir), "observed", "claim_id"), KINDS)


@query(f"WITH {LATEST}, p AS (SELECT subject, {', '.join(f'max(CASE WHEN predicate = {k!r} THEN value END) AS {k}' for k in KINDS)} FROM latest GROUP BY subject) SELECT subject, concat_ws(',', {', '.join(f'CASE WHEN {k} IS NULL THEN {k!r} END' for k in KINDS)}) AS missing FROM p")
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_pivot(spark, sf_dir).select("subject", claims.missing_fields(KINDS).alias("missing"))


CLASSES = list(claims.BASE_SCORE)
PREDICATES = ["hasName", "hasAddress", "occursOn", "supersedes"]
_CLASS = f"([{', '.join(map(repr, CLASSES))}])[1 + user_id % 7]"
_PREDICATE = f"([{', '.join(map(repr, PREDICATES))}])[1 + event_id % 4]"
_SCORE = f"CASE {' '.join(f'WHEN p IN ({chr(44).join(map(repr, g))}) AND a = {a!r} THEN {s}' for g, over in (claims.ARTIST, claims.VENUE, claims.EVENT) for a, s in over.items())} {' '.join(f'WHEN a = {a!r} THEN {s}' for a, s in claims.BASE_SCORE.items())} END"
STRONGEST = f"""strong AS (SELECT event_id AS claim_id, subject, p AS predicate, a AS authority, {_SCORE} AS score FROM (SELECT event_id, user_id % 50 AS subject, {_PREDICATE} AS p, {_CLASS} AS a FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAYS)
    QUALIFY row_number() OVER (PARTITION BY subject, p ORDER BY score DESC, event_id) = 1)"""


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    # One number.
    last = events.agg(F.max("ts")).first()[0]
    made = events.select(F.col("event_id").alias("claim_id"), (F.col("user_id") % 50).alias("subject"), pick(PREDICATES, F.col("event_id") % 4).alias("predicate"), F.col("user_id").alias("source"), F.col("ts").cast("string").alias("observed_at"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("proposed_claim_id"))
    sources = events.select(F.col("user_id").alias("source"), pick(CLASSES, F.col("user_id") % 7).alias("authority")).distinct()
    return claims.strongest(claims.with_authority(made, sources, claims.authority_scores(spark)), ["subject", "predicate"], F.lit(last))


@query(f"WITH {STRONGEST} SELECT claim_id, subject, predicate, authority, score FROM strong")
def strongest_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supported(spark, sf_dir).select("claim_id", "subject", "predicate", "authority", "score")


@query(f"""WITH {STRONGEST}, p AS (SELECT *, claim_id % 2 = 0 AS destructive, claim_id % 3 = 0 AS mutation FROM strong)
    SELECT claim_id, CASE WHEN subject % 11 = 0 AND (mutation OR destructive) AND authority NOT IN ('owner', 'artist-owned') THEN 'owner-managed'
    WHEN subject % 5 = 0 AND NOT destructive AND authority NOT IN ('owner', 'artist-owned', 'venue-owned') THEN 'tombstone' WHEN destructive AND score > 60 THEN 'stronger-support' ELSE 'allow' END AS decision FROM p""")
def authority_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim, subject = F.col("claim_id"), F.col("subject")
    flags = ((claim % 2 == 0).alias("destructive"), (claim % 3 == 0).alias("mutation"), (subject % 11 == 0).alias("owner_managed"), (subject % 5 == 0).alias("tombstoned"))
    p = supported(spark, sf_dir).select("claim_id", "authority", F.lit(60).alias("proposed"), F.col("score").alias("support"), *flags)
    return claims.decide(p).select("claim_id", "decision")


@query("SELECT event_id AS item, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_type <> 'click')")
def ledger_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select(F.col("event_id").alias("idempotency_key"), "user_id", "event_type")
    ledger = events.where("idempotency_key % 3 = 0").select("idempotency_key", F.when(F.col("event_type") == "click", "failed").otherwise("success").alias("status"))
    return reconcile.pending(events, ledger).select(F.col("idempotency_key").alias("item"), "user_id")


_COUNTS = "count(*) FILTER (l_returnflag = 'N') AS free, count(*) FILTER (l_returnflag = 'R') AS paid, count(*) FILTER (l_returnflag = 'A') AS unknown"
_RATIO = "(CASE WHEN free + paid = 0 THEN 0.0 ELSE {0} / (free + paid) END)"


@query(f"""WITH c AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS venue, {_COUNTS} FROM lineitem GROUP BY l_orderkey),
    k AS (SELECT l_orderkey, free, paid, unknown, CASE WHEN venue AND paid >= 2 AND free = 0 THEN 'COMMERCIAL_TICKETING' WHEN paid >= 3 AND {_RATIO.format('paid')} >= 0.8 AND free = 0 THEN 'COMMERCIAL_TICKETING' WHEN free >= 2 AND {_RATIO.format('free')} >= 0.8 THEN 'GRASSROOTS_FREE' WHEN free >= 1 AND paid = 0 THEN 'LIKELY_GRASSROOTS' WHEN free > 0 AND paid > 0 THEN 'MIXED' ELSE 'UNKNOWN' END AS class FROM c)
    SELECT *, class IN ('GRASSROOTS_FREE', 'LIKELY_GRASSROOTS') AS auto_enrich FROM k""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumn("admission", F.when(F.col("l_returnflag") == "N", "FREE_CONFIRMED").when(F.col("l_returnflag") == "R", "PAID_CONFIRMED").otherwise("UNKNOWN"))
    return assess.eligibility(lines, "l_orderkey", F.col("l_linestatus") == "F", "admission")


@query("SELECT l_returnflag IN ('N', 'R') AS publish, l_returnflag = 'N' AS enrich, l_returnflag = 'N' AS expand, count(*) AS n FROM lineitem GROUP BY ALL")
def admission_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    admission = F.when(F.col("l_returnflag") == "N", "FREE_CONFIRMED").when(F.col("l_returnflag") == "R", "PAID_CONFIRMED").otherwise("UNKNOWN")
    return load(spark, sf_dir, "lineitem").select(F.inline(F.array(assess.disposition(admission)))).groupBy("publish", "enrich", "expand").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND (o_orderkey % 9 = 0 OR o_orderdate + INTERVAL {assess.SUPPRESSED_DAYS} DAYS > TIMESTAMP '1996-06-01'))")
def suppression_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    until = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise((F.col("o_orderdate") + F.expr(f"INTERVAL {assess.SUPPRESSED_DAYS} DAYS")).cast("string"))
    held = orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("suppressed"), until.alias("suppressed_until"))
    return assess.unsuppressed(orders.select("o_orderkey"), held, ["o_orderkey"], F.to_timestamp(F.lit("1996-06-01")))


@query("""WITH f AS (SELECT DISTINCT lang, doc_id FROM documents WHERE n_chars > 1500), t AS (SELECT DISTINCT lang, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1),
    b AS (SELECT coalesce(f.lang, t.lang) AS lang, f.doc_id AS x, t.doc_id AS y FROM f FULL JOIN t ON f.doc_id = t.doc_id AND f.lang = t.lang),
    c AS (SELECT lang, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS tp, count(*) FILTER (y IS NULL) AS fp, count(*) FILTER (x IS NULL) AS fn FROM b GROUP BY lang)
    SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END::DOUBLE AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END::DOUBLE AS recall FROM c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    good = load(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return assess.precision_recall(docs.where("n_chars > 1500").select("lang", "doc_id"), docs.join(good, "doc_id", "left_semi").select("lang", "doc_id"), ["lang"])


@query("""WITH e AS (SELECT c_custkey AS key, c_name AS name, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey % 13 <> 0),
    a AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) || '!' ELSE c_name END AS name, (c_nationkey + (c_custkey % 11 = 0)::INT)::VARCHAR AS nation, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 17 <> 0),
    alone AS (SELECT 'events.' || coalesce(e.key, a.key) AS path, 'PROJECTION_DIFFERENCE' AS classification, e.key IS NULL AS added FROM e FULL JOIN a ON e.key = a.key WHERE e.key IS NULL OR a.key IS NULL),
    fields AS (SELECT e.key, unnest([{'f': 'name', 'e': e.name, 'a': a.name, 'c': 'IDENTITY_DIFFERENCE'}, {'f': 'nation', 'e': e.nation, 'a': a.nation, 'c': 'PROJECTION_DIFFERENCE'}, {'f': 'segment', 'e': e.segment, 'a': a.segment, 'c': 'PROJECTION_DIFFERENCE'}]) AS x FROM e JOIN a ON e.key = a.key),
    d AS (SELECT path, classification, CASE WHEN added THEN NULL ELSE 'event' END AS expected, CASE WHEN added THEN 'event' END AS actual FROM alone UNION ALL SELECT 'events.' || key || '.' || x.f, x.c, x.e, x.a FROM fields WHERE x.e IS DISTINCT FROM x.a)
    SELECT path, expected, actual, CASE WHEN ok THEN 'EXPECTED_RULE_CHANGE' ELSE classification END AS classification, NOT ok AS material
    FROM (SELECT *, path LIKE 'events.%.segment' AND string_split(path, '.')[2]::INT % 10 = 0 AS ok FROM d)""")
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    base = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    other = base.where("key % 17 <> 0").select("key", F.when(key % 7 == 0, F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")).alias("name"), (F.col("nation") + (key % 11 == 0).cast("int")).alias("nation"), F.when(key % 5 != 0, F.col("segment")).alias("segment"))
    allowed = base.where("key % 10 = 0").select(F.concat(F.lit("events."), key.cast("string"), F.lit(".segment")).alias("path"))
    out = assess.parity(base.where("key % 13 <> 0"), other, "key", ["name"], allowed)
    whole = lambda c: F.when(F.startswith(c, F.lit("{")), "event").otherwise(F.col(c)).alias(c)
    return out.select("path", whole("expected"), whole("actual"), "classification", "material")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_quantity, l_returnflag) = 1)
    SELECT l_orderkey, count(*) AS items, sum(l_quantity::BIGINT)::BIGINT AS quantity, sum((l_returnflag = 'R')::INT)::BIGINT AS failed FROM l GROUP BY l_orderkey""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").withColumns({"quantity": F.col("l_quantity").cast("long"), "failed": (F.col("l_returnflag") == "R").cast("long")})
    return reconcile.run_rollup(lines, "l_orderkey", ["l_linenumber"], ["quantity", "failed"], F.col("l_shipdate").desc(), F.col("l_quantity"), F.col("l_returnflag"))


@query(r"""SELECT page_id, regexp_replace(split_part(u, '?', 1), '/$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM
    (SELECT page_id, u, list_filter(string_split(substr(u, length(split_part(u, '?', 1)) + 2), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN (TRACKING) AND NOT starts_with(lower(p), 'utm_')) AS k FROM (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages))""".replace("TRACKING", ", ".join(map(repr, text.TRACKING))))
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"))


LINKS = (
    "https://www.facebook.com/room/events/{}", "HTTPS://m.facebook.com/events/{}?ref=1", "https://facebook.com/share/{}/", "https://facebook.com/room{}", "https://fb.me/e/{}", "https://fb.me/x{}",
    "http://www.instagram.com/p/{}", "ftp://example.org/{}", "{}", "", "https://example.org:8080/events/{}", "https://notfacebook.com/events/{}",
)
LINK_KINDS = "facebook_event facebook_event facebook_share facebook_url facebook_event_short generic_url instagram_url unknown unknown unknown generic_url generic_url".split()


@query(f"SELECT page_id, ([{', '.join(map(repr, LINK_KINDS))}])[1 + page_id % {len(LINKS)}] AS kind FROM pages")
def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.replace(pick(LINKS, F.col("page_id") % len(LINKS)), F.lit("{}"), F.col("page_id").cast("string"))
    return load(spark, sf_dir, "pages").select("page_id", text.target_kind(link).alias("kind"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
    k AS (SELECT page_id, u, list_filter(string_split(substr(u, length(split_part(u, '?', 1)) + 2), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN (TRACKING) AND NOT starts_with(lower(p), 'utm_')) AS k FROM u),
    p AS (SELECT page_id AS id, nullif(regexp_replace(split_part(u, '?', 1), '/$', '') || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END, '') AS identity FROM k)
    SELECT id, identity, CASE WHEN identity IS NOT NULL AND row_number() OVER w > 1 THEN first_value(id) OVER w END AS duplicate_of FROM p WINDOW w AS (PARTITION BY identity ORDER BY id DESC)""".replace("TRACKING", ", ".join(map(repr, text.TRACKING))))
def capture_dedupe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one canonical url: the newest is kept, the others point to it."""
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return assess.capture_dedupe(pages, F.nullif(text.canonical_url(F.col("url")), F.lit("")), F.col("id")).drop("url")


query(ORACLES["capture_dedupe_url"])(_named("capture_dedupe", capture_dedupe_url))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def slug_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", text.match_key(F.col("p_name")).alias("key"), text.slug(F.col("p_name")).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.85 THEN 'HIGH' WHEN c_acctbal / 10000 >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM customer")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", assess.band(F.col("c_acctbal") / 10000).alias("band"))


@query("SELECT conv_id, turn, role, q AS question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM conversations) WHERE q IS NOT NULL")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    out = assess.carry_forward(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn").cast("string")), "question")
    return out.withColumn("question", F.col("question").cast("long"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def inspect_sql() -> str:
    text_of = lambda pattern: f"nullif(regexp_extract(h, '{pattern.replace(chr(39), chr(39) * 2)}', 1, 'i'), '')"
    decode = lambda x: f"replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&quot;', '\"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>')"
    pick = lambda name: f"nullif({STRIP.format(x=decode('coalesce(' + ', '.join(map(text_of, text.meta_patterns(name))) + ')'))}, '')"
    title = f"nullif({decode(STRIP.format(x=text_of(text.TITLE)))}, '')"
    return f"SELECT page_id, coalesce({pick('og:title')}, {title}) AS title, coalesce({pick('og:description')}, {pick('description')}) AS description FROM (SELECT page_id, CASE WHEN regexp_matches(url, '^https?://', 'i') THEN substr(html, 1, 250000) END AS h FROM pages)"


@query(inspect_sql())
def page_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's inspection; html_inspect, whose SQL reads plain titles, does no more than that."""
    title, description = text.inspected(F.when(F.col("url").rlike("(?i)^https?://"), F.col("html")))
    return load(spark, sf_dir, "pages").select("page_id", title.alias("title"), description.alias("description"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS d FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
    r AS (SELECT DISTINCT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT d, depth + 1 FROM r JOIN e ON node = s WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda name, a, b: load(spark, sf_dir, name).select(F.concat(F.lit(a[0]), F.col(a[1]).cast("string")).alias("src"), F.concat(F.lit(b[0]), F.col(b[1]).cast("string")).alias("dst"))
    edges = edge("nation", ("r", "n_regionkey"), ("n", "n_nationkey")).union(edge("customer", ("n", "c_nationkey"), ("c", "c_custkey"))).union(edge("orders", ("c", "o_custkey"), ("o", "o_orderkey"))).distinct()
    start = load(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return assess.expand(start, kept(edges, "edges"), 3, lambda df: kept(df, "reached"))


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20")
def topk_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.newest(load(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id")


@query("SELECT p_partkey, DATE '2026-01-01' + p_size AS next_scan FROM part WHERE p_size % 3 <> 0 AND DATE '2026-01-01' + p_size <= DATE '2026-01-20' ORDER BY next_scan, p_partkey LIMIT 100")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_size") % 3 != 0).alias("enabled"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")).alias("next_scan"))
    return access.due(sources, F.to_date(F.lit("2026-01-20"))).select(F.col("source_id").alias("p_partkey"), "next_scan")


@query("SELECT count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (n_chars < 200) AS short_text, count(*) FILTER (n_chars < 200 AND l.doc_id IS NULL) AS both_gaps FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = load(spark, sf_dir, "labels").select(F.col("doc_id"), F.lit(True).alias("known")).distinct()
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(known, "doc_id", "left")
    short, bare = F.col("n_chars") < 200, F.col("known").isNull()
    return docs.agg(F.count("*").alias("n"), F.count_if(bare).alias("unlabelled"), F.count_if(short).alias("short_text"), F.count_if(short & bare).alias("both_gaps"))


# These register their queries beside the ones above.
from claimspark.plans import enrich_queries, landed_queries, projection_queries, resolve_queries, source_queries, stream_queries  # noqa: E402, F401
