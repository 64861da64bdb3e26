"""Queries that run as streams over what Spark lands out of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.plans.registry import load, query, text
from claimspark.sources.shared import kept, shared_folder
from claimspark.sources.store import Store
from claimspark.streaming.lease import leases
from claimspark.streaming.ledger import LEDGER, STATE, consume, track_runs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_RUNS = """r AS (SELECT (o_custkey % 50)::VARCHAR AS source_id, o_orderdate::DATE::VARCHAR AS started_at, o_orderkey % 3 <> 0 AS ok, o_orderkey % 2 = 0 AS whole, 'o' || o_orderkey AS observation FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderkey FROM orders)),
    k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at, ok, whole, observation) AS n FROM r), g AS (SELECT source_id, max(n) FILTER (ok) AS good, max(n) FILTER (ok AND whole) AS whole FROM k GROUP BY source_id)"""


@query(f"""WITH {_RUNS} SELECT g.source_id, any_value(k.observation) FILTER (k.n = good) AS last_observation, any_value(k.observation) FILTER (k.n = g.whole) AS last_complete_observation, max(k.started_at) AS last_run_at,
    count(*) FILTER (k.n > coalesce(good, 0)) AS consecutive_failures FROM g JOIN k USING (source_id) GROUP BY g.source_id""")
def run_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in files by their times, one a batch: the state that the stream keeps is that of all runs."""
    folder, k = shared_folder(spark, "runs"), F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", k).distinct()
    rows = rows.select((F.col("o_custkey") % 50).cast("string").alias("source_id"), F.to_date("o_orderdate").cast("string").alias("started_at"), (k % 3 != 0).alias("ok"), (k % 2 == 0).alias("complete"), text("o", k).alias("observation"), text("o", k).alias("normalised"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    for since, until in (("", "1994"), ("1994", "1997"), ("1997", "9")):
        rows.where((F.col("started_at") >= since) & (F.col("started_at") < until)).coalesce(1).write.mode("append").parquet(folder)
    store = Store(spark, shared_folder(spark, "state"))
    track_runs(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), store, shared_folder(spark, "checkpoint")).awaitTermination()
    return store.read("source_state", STATE).select("source_id", "last_observation", "last_complete_observation", "last_run_at", "consecutive_failures")


@query("""SELECT 'i' || k AS idempotency_key, CASE WHEN k % 7 = 0 THEN 'dead' ELSE 'success' END AS status, CASE WHEN k % 7 = 0 THEN 3 ELSE 1 END::BIGINT AS attempts FROM (SELECT DISTINCT o_orderkey AS k FROM orders)""")
def queue_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are sent four times over: each is done once, and those that always fail are dead after three attempts."""
    folder, k = shared_folder(spark, "queue"), F.col("o_orderkey")
    items = load(spark, sf_dir, "orders").select(k).distinct().select(text("i", k).alias("idempotency_key"), k)
    items = kept(items, "items")
    for _ in range(4):
        items.write.mode("append").parquet(folder)
    # A batch is one sending's files, as many as tasks have written.
    files = max(1, len(spark.read.schema(items.schema).parquet(folder).inputFiles()) // 4)
    store = Store(spark, shared_folder(spark, "ledger"))
    work = lambda todo: todo.withColumn("status", F.when(k % 7 == 0, "failed").otherwise("success"))
    consume(spark.readStream.schema(items.schema).option("maxFilesPerTrigger", files).parquet(folder), store, work, shared_folder(spark, "checkpoint")).awaitTermination()
    return store.read("ledger", LEDGER)


@query("""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT outcome, count(*) AS n FROM (SELECT unnest(['claimed', CASE WHEN k % 40 >= 20 THEN 'claimed' ELSE 'refused' END, CASE WHEN k % 40 >= 20 THEN 'released' ELSE 'claimed' END]) AS outcome FROM c) GROUP BY outcome""")
def lease_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two owners ask for each capture, the second one after 0 to 39 minutes of the first one's 20; then the holder releases it or renews."""
    folder, k = shared_folder(spark, "requests"), F.col("c_custkey")
    start = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    at = lambda minutes: start + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))
    late = k % 40
    asked = F.array(
        F.struct(F.lit("x").alias("owner"), start.alias("at"), F.lit(False).alias("done")), F.struct(F.lit("y").alias("owner"), at(late).alias("at"), F.lit(False).alias("done")),
        F.struct(F.when(late >= 20, "y").otherwise("x").alias("owner"), at(late + 1).alias("at"), (late >= 20).alias("done")),
    )
    rows = load(spark, sf_dir, "customer").select(text("c", k).alias("id"), F.inline(asked))
    rows.write.parquet(folder)
    out, before = shared_folder(spark, "leases"), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        leases(spark.readStream.schema(rows.schema).parquet(folder), 20).writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(out).groupBy("outcome").agg(F.count("*").alias("n"))
