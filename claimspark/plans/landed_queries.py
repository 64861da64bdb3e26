"""Queries over what Spark lands out of the given tables: text pages, sheets, queues, artifacts, images, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.operators.tabular import COLUMNS
from claimspark.plans import source_queries as made
from claimspark.plans.registry import load, query, text
from claimspark.sources import adapters, formats, landed, sinks
from claimspark.sources.shared import shared_folder
from claimspark.sources.store import Store


def landed_pages(spark: SparkSession, sf_dir: str) -> str:
    """The pages of :func:`made.page_lines` as text files, one each, in a new shared folder."""
    folder = shared_folder(spark, "pages")
    lines = made.page_lines(spark, sf_dir).select("page", "line", F.coalesce("body", F.lit("")).alias("value"))
    lines.repartition("page").sortWithinPartitions("page", "line").select("page", "value").write.partitionBy("page").text(folder)
    return folder


adapters.register("pages", adapters.listing(made.SITE))


@query(f"""WITH {made._LINES}, e AS (SELECT *, CASE lower(b) WHEN 'brand#11' THEN 'The Eleven' WHEN 'brand#12' THEN 'The Dozen' ELSE venue END AS place FROM found WHERE reason IS NULL)
    SELECT page::BIGINT AS page, date, artist AS artist_name, CASE WHEN form = 14 THEN venue ELSE place END AS venue_name, coalesce(time, '20:00') AS start_time, time IS NULL AS time_defaulted,
        date || '_' || {made._SLUG.format(x='artist')} || '_' || {made._SLUG.format(x='CASE WHEN form = 14 THEN venue ELSE place END')} AS source_event_key FROM e""")
def listing_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages landed as text files, read by the format ``listing`` and parsed by their adapter."""
    found = adapters.run(spark, "pages", landed_pages(spark, sf_dir), "2026-08-01")
    page = F.regexp_extract("document", "page=([0-9]+)", 1).cast("long")
    return found.events.select(page.alias("page"), "date", "artist_name", "venue_name", "start_time", "time_defaulted", "source_event_key")


@query(f"WITH {made._LINES} SELECT page::BIGINT AS page, count(*) AS n, count(*) || ' time(s) defaulted to 20:00' AS warning FROM found WHERE reason IS NULL AND time IS NULL GROUP BY page")
def listing_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapters.run(spark, "pages", landed_pages(spark, sf_dir), "2026-08-01")
    return found.warnings.select(F.regexp_extract("document", "page=([0-9]+)", 1).cast("long").alias("page"), "n", "warning")


@query(f"""WITH {made._SHEET} SELECT 'sheet-' || sha256(date || '|' || lower(venue_name) || '|' || lower(artist_name))[1:12] AS source_event_key, date, start_time, start_time_defaulted AS time_defaulted, artist_name, venue_name, town AS venue_location, event_url,
    'sheet-artist-' || sha256(lower(artist_name))[1:12] AS artist_external_id FROM e""")
def sheet_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets landed as files of five columns sets, read by the format ``sheet`` and parsed by their adapter."""
    folder = shared_folder(spark, "sheets")
    rows = made.sheet(spark, sf_dir)
    rows.select("row_index", *COLUMNS).repartitionByRange(4, "row_index").sortWithinPartitions("row_index").select(*COLUMNS).write.option("header", True).option("escape", '"').csv(folder)
    events = adapters.run(spark, "sheet", folder, "2026-08-01").events
    return events.select("source_event_key", "date", "start_time", "time_defaulted", "artist_name", "venue_name", "venue_location", "event_url", "artist_external_id")


@query("""SELECT 's' || (o_orderkey % 9) AS source_id, count(*) AS n, count(DISTINCT o_orderkey) AS items FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey % 13 <> 0 GROUP BY ALL""")
def queue_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items of orders sent in two batches, the first of them twice: the queue has each item once, and no incomplete one."""
    folder = shared_folder(spark, "queue")
    k = F.col("o_orderkey")
    items = load(spark, sf_dir, "orders").select(k).distinct().select(text("i", k).alias("idempotency_key"), F.when(k % 13 != 0, text("s", k % 9)).alias("source_id"), k)
    for batch, half in (("b0", 0), ("b0", 0), ("b1", 1)):
        sinks.publish(items.where(k % 2 == half), folder, ["idempotency_key", "source_id"], batch)
    got = formats.register(spark).read.format("queue").option("path", folder).load()
    return got.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("items"))


@query("""SELECT 'source-observations/' || s || '/' || strftime(d, '%Y/%m/%d') || '/obs-' || k || '/raw.' || CASE WHEN k % 2 = 0 THEN 'html' ELSE 'json' END AS evidence_key, k % 3 = 0 AS again
    FROM (SELECT DISTINCT o_orderkey AS k, 's' || (o_orderkey % 5) AS s, o_orderdate::DATE AS d FROM orders)""")
def evidence_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations put once each; those that come again are told apart and change nothing."""
    k = F.col("o_orderkey")
    seen = load(spark, sf_dir, "orders").select(k, F.to_date("o_orderdate").alias("d")).distinct()
    seen = seen.select(text("obs-", k).alias("observation_id"), text("s", k % 5).alias("source_id"), F.to_timestamp("d").alias("observed_at"), F.when(k % 2 == 0, "text/html").otherwise("application/json").alias("content_type"), text("body ", k).alias("body"), (k % 3 == 0).alias("_again"))
    store = Store(spark, shared_folder(spark, "evidence"), indexes={"source_observation": ["source_id"]})
    sinks.put_evidence(store, seen.drop("_again"))
    again = sinks.put_evidence(store, seen.where("_again").drop("_again").withColumn("body", F.lit("changed"))).select("observation_id", F.lit(True).alias("again"))
    kept = store.read("source_observation", "observation_id string, evidence_key string, body string").where("body <> 'changed'")
    return kept.join(again, "observation_id", "left").select("evidence_key", F.coalesce("again", F.lit(False)).alias("again"))


@query("""WITH m AS (SELECT DISTINCT o_orderkey AS k FROM orders)
    SELECT CASE WHEN k % 7 = 0 THEN 'no source' WHEN k % 7 = 1 THEN 'unknown reason' WHEN k % 7 = 2 THEN 'no time' WHEN k % 7 = 3 AND k % 2 = 0 THEN 'wrong runtime' ELSE 'valid' END AS outcome, count(*) AS n FROM m GROUP BY ALL""")
def message_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan requests as JSON messages: valid ones, and why the others are rejected."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.when(k % 7 != 0, text("s", k % 9)).alias("sourceId"), F.when(k % 7 == 1, "now").otherwise("manual").alias("reason"), F.when(k % 7 != 2, "2026-01-01T00:00:00Z").alias("requestedAt"), F.when((k % 7 == 3) & (k % 2 == 0), "browser").alias("runtime")))
    good, bad = landed.messages(load(spark, sf_dir, "orders").select(k).distinct().select(k, body.alias("body")), "body", F.lit("standard"))
    return good.select(F.lit("valid").alias("outcome")).unionByName(bad.select(F.col("rejected").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT 's' || (o_orderkey % 3) AS source_id, 'r' || (o_orderkey % 4) AS run_id, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY ALL""")
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's normalised artifacts written as JSON lines by source and run, and read again."""
    folder, k = shared_folder(spark, "artifacts"), F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(k).distinct().select(text("s", k % 3).alias("source_id"), text("r", k % 4).alias("run_id"), k.alias("key"))
    sinks.write_artifacts(rows, folder, "normalised")
    return spark.read.schema("key long, source_id string, run_id string").json(f"{folder}/normalised").groupBy("source_id", "run_id").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT DISTINCT o_orderkey AS k, o_custkey % 20 AS g FROM orders) SELECT 'obs-' || g AS observation_id, count(*) AS claim_records, count(*) AS stored FROM o GROUP BY g""")
def knowledge_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations and their claims in one commit, twice; what is looked up by observation is what was put."""
    k = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").select(k, (F.col("o_custkey") % 20).alias("g")).distinct()
    seen = orders.select("g").distinct().select(text("obs-", F.col("g")).alias("observation_id"), F.lit("desk").alias("source_id"), F.to_timestamp(F.lit("2026-01-01")).alias("observed_at"), F.lit("text/csv").alias("content_type"), F.lit("rows").alias("body"))
    claims = orders.select(text("c", k).alias("claim_id"), text("obs-", F.col("g")).alias("observation_id"), text("event:", k).alias("subject"))
    store = Store(spark, shared_folder(spark, "knowledge"), indexes={"claim": ["observation_id", "subject"]})
    sinks.persist_knowledge(store, seen, claims)
    counts = sinks.persist_knowledge(store, seen, claims)
    stored = store.lookup("claim", "claim_id string, observation_id string", "observation_id", [f"obs-{g}" for g in range(20)]).groupBy("observation_id").agg(F.count("*").alias("stored"))
    return counts.join(stored, "observation_id").select("observation_id", "claim_records", "stored")


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT CASE WHEN k % 4 = 0 THEN 'published' WHEN k % 4 = 1 THEN 'held' ELSE 'new' END AS status, count(*) AS n, sum((k % 4 = 1)::BIGINT)::BIGINT AS notes FROM c GROUP BY ALL""")
def capture_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures whose status and notes are set twice: once counts."""
    k, schema = F.col("c_custkey"), "id string, status string"
    rows = load(spark, sf_dir, "customer").select(k)
    store = Store(spark, shared_folder(spark, "captures"))
    store.upsert("capture", rows.select(text("c", k).alias("id"), F.lit("new").alias("status")), ["id"], schema)
    new = rows.where("c_custkey % 4 < 2").select(text("c", k).alias("id"), F.when(k % 4 == 0, "published").otherwise("held").alias("new_status"), F.when(k % 4 == 1, "see venue").alias("note"), F.lit("2026-01-01").alias("at"))
    for _ in range(2):
        sinks.capture_status(store, new, schema)
    notes = store.read("capture_note", sinks.NOTE).groupBy(F.col("capture_id").alias("id")).agg(F.count("*").alias("notes"))
    return store.read("capture", schema).join(notes, "id", "left").groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("notes", F.lit(0))).alias("notes"))
