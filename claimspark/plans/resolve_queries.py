"""Queries of conflict resolution, shared footprints, circles of cells, and folds over runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions import geo
from claimspark.operators import access, runs, trust
from claimspark.plans.registry import load, query, text

_CLAIMS = """c AS (SELECT DISTINCT 's' || (l_suppkey % 40) AS source, 'p' || (l_partkey % 500) AS subject, 'hasStatus' AS predicate, CASE WHEN l_suppkey % 40 < 25 THEN 'true' ELSE l_returnflag END AS value FROM lineitem),
    a AS (SELECT *, coalesce(CASE WHEN substr(source, 2)::INT % 7 < 5 THEN (30 + 2 * (substr(source, 2)::INT)) / 100.0::DOUBLE END, 0.35::DOUBLE) AS authority FROM c),
    t0 AS (SELECT source, round(max(authority), 9) AS trust FROM a GROUP BY source)"""


def _rounds() -> str:
    steps = []
    for k in range(trust.ROUNDS):
        steps.append(f"""o{k} AS MATERIALIZED (SELECT subject, predicate, value, sum(trust) AS own, max(authority) AS authority, count(*) AS n_sources FROM a JOIN t{k} USING (source) GROUP BY ALL),
    h{k} AS MATERIALIZED (SELECT o.*, round(own / sum(own) OVER (PARTITION BY subject, predicate), 9) AS confidence FROM o{k} o),
    t{k + 1} AS MATERIALIZED (SELECT source, round(avg(confidence), 9) AS trust FROM a JOIN h{k} USING (subject, predicate, value) GROUP BY source)""")
    return ", ".join(steps)


def contested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Claims of suppliers about parts, most of one mind, and their sources' scores, some unknown."""
    s = F.col("l_suppkey") % 40
    made = load(spark, sf_dir, "lineitem").select(text("s", s).alias("source"), text("p", F.col("l_partkey") % 500).alias("subject"), F.lit("hasStatus").alias("predicate"), F.when(s < 25, "true").otherwise(F.col("l_returnflag")).alias("value"))
    n = F.col("id")
    return made, spark.range(40).where("id % 7 < 5").select(text("s", n).alias("source"), (30 + 2 * n).alias("score"))


@query(f"WITH {_CLAIMS}, {_rounds()} SELECT source, round(trust, 6) AS trust FROM t{trust.ROUNDS}")
def source_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.trust_scores(*contested(spark, sf_dir))[0].withColumn("trust", F.round("trust", 6))


@query(f"""WITH {_CLAIMS}, {_rounds()}, last AS (SELECT * FROM h{trust.ROUNDS - 1})
    SELECT subject, predicate, value, round(confidence, 6) AS confidence, n > 1 AS contested FROM (SELECT *, count(*) OVER (PARTITION BY subject, predicate) AS n, row_number() OVER (PARTITION BY subject, predicate ORDER BY authority DESC, confidence DESC, value) AS k FROM last) WHERE k = 1""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.resolved(trust.trust_scores(*contested(spark, sf_dir))[1]).withColumn("confidence", F.round("confidence", 6))


@query("""WITH i AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END || (o_custkey % 60) AS entity, (o_custkey % 60) || ':' || (o_orderkey // 5 % 12) AS token FROM orders),
    n AS (SELECT entity, count(*) AS n FROM i GROUP BY entity), p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS common FROM i x JOIN i y ON x.token = y.token AND x.entity < y.entity GROUP BY ALL)
    SELECT a, b, common, x.n AS size_a, y.n AS size_b FROM p JOIN n x ON x.entity = a JOIN n y ON y.entity = b WHERE 100 * common >= 60 * (x.n + y.n - common)""")
def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places under two names: those that share their performers and days."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 60
    items = load(spark, sf_dir, "orders").select(F.concat(F.when(k % 5 == 0, "b").otherwise("a"), c.cast("string")).alias("entity"), text(c, ":", F.expr("o_orderkey div 5 % 12")).alias("token"))
    return trust.footprint_pairs(items)


_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(p.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - q.lon) / 2), 2))))"


@query(f"""WITH p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 18001) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36001) / 100.0 - 180 AS lon FROM customer),
    q AS (SELECT s_suppkey AS circle, (s_suppkey * 3571 % 17801) / 100.0 - 89 AS lat, (s_suppkey * 7753 % 36001) / 100.0 - 180 AS lon, 50 + s_suppkey % 20 * 60 AS radius FROM supplier)
    SELECT circle, id, round({_KM}, 3) AS km FROM p, q WHERE {_KM} <= radius""")
def geo_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within circles about suppliers, by the circles' geohash cells and then exactly."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    places = load(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 18001 / 100.0 - 90).alias("lat"), (k * 104729 % 36001 / 100.0 - 180).alias("lon"))
    circles = load(spark, sf_dir, "supplier").select(s.alias("circle"), (s * 3571 % 17801 / 100.0 - 89).alias("lat"), (s * 7753 % 36001 / 100.0 - 180).alias("lon"), (50 + s % 20 * 60).alias("radius"))
    return geo.within(places, circles, 3).select("circle", "id", F.round("km", 3).alias("km"))


@query("""WITH r AS (SELECT o_custkey % 50 AS source_id, o_orderdate::DATE::VARCHAR AS started_at, o_orderkey % 3 <> 0 AS ok, o_orderkey % 2 = 0 AS whole, 'o' || o_orderkey AS observation, o_orderkey FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderkey FROM orders)),
    k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at, ok, whole, observation) AS n FROM r),
    g AS (SELECT source_id, max(n) FILTER (ok) AS good, max(n) FILTER (ok AND whole) AS whole, max(n) AS last FROM k GROUP BY source_id)
    SELECT g.source_id, any_value(k.observation) FILTER (k.n = good) AS last_observation, any_value(k.observation) FILTER (k.n = g.whole) AS last_complete_observation, max(k.started_at) AS last_run_at, any_value(k.started_at) FILTER (k.n = good) AS last_success_at,
        count(*) FILTER (k.n > coalesce(good, 0)) AS consecutive_failures FROM g JOIN k USING (source_id) GROUP BY g.source_id""")
def run_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of sources after all their runs at once."""
    k = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", k).distinct()
    rows = rows.select((F.col("o_custkey") % 50).cast("string").alias("source_id"), F.to_date("o_orderdate").cast("string").alias("started_at"), (k % 3 != 0).alias("ok"), (k % 2 == 0).alias("complete"), text("o", k).alias("observation"), text("o", k).alias("normalised"))
    none = spark.createDataFrame([], "source_id string, last_observation string, last_complete_observation string, last_normalised string, last_complete_normalised string, last_run_at string, last_success_at string, last_failure_at string, consecutive_failures long")
    out = runs.folded(none, rows)
    return out.select(F.col("source_id").cast("long").alias("source_id"), "last_observation", "last_complete_observation", "last_run_at", "last_success_at", "consecutive_failures")


@query("""WITH l AS (SELECT DISTINCT 'e' || (o_custkey % 30) AS entity, 'c' || o_orderkey AS claim FROM orders), w AS (SELECT claim FROM l WHERE entity = 'e7'), e AS (SELECT DISTINCT o_custkey % 30 AS k FROM orders WHERE o_custkey % 2 = 0)
    SELECT 'support' AS path, claim AS key, NULL AS value FROM w UNION ALL SELECT 'items', 'c' || o_orderkey, NULL FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) WHERE o_custkey % 30 = 11
    UNION ALL SELECT 'eligibility', 'c' || c_custkey, CASE WHEN c_custkey % 30 IN (SELECT k FROM e) THEN 'class ' || (c_custkey % 30) END FROM customer""")
def lookup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that support an entity, the items of a run, and eligibility looked up for a batch of customers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = load(spark, sf_dir, "orders").select(k, c).distinct()
    links = orders.select(F.lit("event").alias("entity_type"), text("e", c % 30).alias("entity_id"), text("c", k).alias("claim_id"))
    support = access.support_claims(links, "event", "e7").select(F.lit("support").alias("path"), F.col("claim_id").alias("key"), F.lit(None).cast("string").alias("value"))
    items = access.run_items(orders.select(text("o", c % 30).alias("observation_id"), text("c", k).alias("idempotency_key")), "o11").select(F.lit("items").alias("path"), F.col("idempotency_key").alias("key"), F.lit(None).cast("string").alias("value"))
    known = orders.where("o_custkey % 2 = 0").select((c % 30).alias("group")).distinct().withColumn("class", text("class ", F.col("group")))
    found = access.with_looked_up(load(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 30).alias("group")), known, ["group"]).select(F.lit("eligibility").alias("path"), text("c", F.col("c_custkey")).alias("key"), F.col("class").alias("value"))
    return support.unionByName(items).unionByName(found)


_DRIFT = """s AS (SELECT source, period, k * CASE WHEN source < 3 AND first >= DATE '1995-06-01' THEN 4 ELSE 1 END AS n FROM (SELECT o_custkey % 20 AS source, date_trunc('month', o_orderdate)::DATE AS period, count(*) AS k, min(o_orderdate::DATE) AS first FROM orders GROUP BY ALL)),
    w AS (SELECT *, ln(n + 1.0) AS l FROM s),
    m AS (SELECT *, n / avg(n) OVER b AS ratio, avg(l) OVER b AS mb, avg(l) OVER a AS ma, greatest(0.0, avg(l * l) OVER b - (avg(l) OVER b) * (avg(l) OVER b)) AS vb, greatest(0.0, avg(l * l) OVER a - (avg(l) OVER a) * (avg(l) OVER a)) AS va,
        count(*) OVER b = 6 AND count(*) OVER a = 6 AS whole FROM w WINDOW b AS (PARTITION BY source ORDER BY period ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY source ORDER BY period ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
    d AS (SELECT source, period, round(ratio, 6) AS ratio, CASE WHEN whole THEN round((ma - mb) / sqrt((vb + va) / 6 + 1e-6), 4) END AS z FROM m)"""


@query(f"""WITH {_DRIFT}, t AS (SELECT source, max(period) AS last_period, arg_max(ratio, period) AS last_ratio, count(*) FILTER (abs(z) >= 3) AS changes, max(abs(z)) FILTER (abs(z) >= 3) AS top FROM d GROUP BY source)
    SELECT t.source, last_period, last_ratio, changes, (SELECT min(period) FROM d WHERE d.source = t.source AND abs(z) = t.top) AS strongest FROM t""")
def source_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly counts of sources, some of which grow in the middle: changes of level and the last ratio."""
    rows = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("source"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period"), F.to_date("o_orderdate").alias("d"))
    counts = rows.groupBy("source", "period").agg(F.count("*").alias("k"), F.min("d").alias("first"))
    counts = counts.withColumn("n", F.col("k") * F.when((F.col("source") < 3) & (F.col("first") >= F.to_date(F.lit("1995-06-01"))), 4).otherwise(1))
    return runs.health(runs.drift(counts, "source", "period", "n"), "source", "period")
