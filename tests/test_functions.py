"""Scalar expressions on literal values."""

import pytest
from pyspark.sql import functions as F

from claimspark.functions import text, times
from claimspark.operators import assess, claims, reconcile
from claimspark.sources.lines import lines
from claimspark.sources.store import Store
from claimspark.streaming.ledger import LEDGER, consume


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("21/08/2026", "2026-08-21"), ("21-08-26", "2026-08-21"), ("2026-08-21", "2026-08-21"), ("August 21, 2026", "2026-08-21"), ("1/1/1899", None), ("31/02/2026", None)])
def test_uk_date(spark, raw, want):
    got = value(spark, times.uk_date(F.lit(raw)))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize(("raw", "want"), [("9pm", ("21:00", False)), ("20:30", ("20:30", False)), ("8.30pm", ("20:30", False)), ("", ("21:00", True)), ("7:12", ("21:00", True)), ("8", ("20:00", False)), ("8pm to 11pm", ("20:00", False))])
def test_stage_time(spark, raw, want):
    assert tuple(value(spark, times.stage_time(F.lit(raw))))[:2] == want


@pytest.mark.parametrize(("cadence", "now", "want"), [("daily", "2026-10-23 23:00:00", "2026-10-24 04:00:00"), ("daily", "2026-10-24 23:00:00", "2026-10-25 05:00:00"), ("manual", "2026-10-24 23:00:00", None)])
def test_next_scan_over_a_clock_change(spark, cadence, now, want):
    row = spark.createDataFrame([("s", "Europe/London", cadence, "05:00")], "id string, timezone string, cadence string, local_time string").withColumn("next_scan_at", F.lit(None).cast("timestamp"))
    got = times.next_scan(row, F.to_timestamp(F.lit(now))).select(F.col("next_scan").cast("string")).first()[0]
    assert got == want


def test_text(spark):
    assert value(spark, text.slug(F.lit(" The King's  Arms! "))) == "the-kings-arms"
    assert value(spark, text.place_slug(F.lit("The King’s Arms, SK1 3XX"))) == "the-kings-arms"
    assert value(spark, text.act_name(F.lit("River Band"))) == "River"
    assert value(spark, text.canonical_url(F.lit("https://example.org/a/?utm_x=1&b=2&ref=z#top"))) == "https://example.org/a/?b=2"  # the slash is not at the end
    assert value(spark, text.plain_text(F.lit("<b>a</b>&amp;lt;"))) == "\na\n<"
    assert value(spark, text.target_kind(F.lit("https://www.facebook.com/events/12"))) == "facebook_event"
    assert not value(spark, text.safe_address(F.lit("http://192.168.1.4/x"))) and value(spark, text.safe_address(F.lit("https://example.org/")))


def test_diff_covers_all_keys(spark):
    b = spark.createDataFrame([("e1", "old", "2026-01-09"), ("e3", "gone", "2026-01-09"), ("e4", "gone", "2025-01-01")], "key string, print string, date string")
    a = spark.createDataFrame([("e1", "new", "2026-01-09"), ("e2", "new", "2026-01-09")], "key string, print string, date string")
    for complete, gone in ((True, "withdrawn"), (False, "ignoredAbsence")):
        got = {r["key"]: r["action"] for r in reconcile.snapshot_diff(b, a, F.lit("2026-01-01"), complete).collect()}
        assert got == {"e1": "updated", "e2": "added", "e3": gone, "e4": "pastDropped" if complete else gone}


def test_empty_denominators_give_one(spark):
    none = spark.createDataFrame([], "g string, k string")
    some = spark.createDataFrame([("x", "a")], "g string, k string")
    row = assess.precision_recall(none, some, ["g"]).first()
    assert (row["tp"], row["fn"], row["precision"], row["recall"]) == (0, 1, 1.0, 0.0)


def test_scores(spark):
    found = {(r["predicate"], r["authority"]): r["score"] for r in claims.authority_scores(spark).collect()}
    assert found["hasName", "artist-owned"] == 100 and found["hasAddress", "official-ticket"] == 65 and found["occursOn", "venue-owned"] == 95 and found["hasGenre", "capture"] == 35


def test_lines(spark):
    got = lines(spark.createDataFrame([(1, "a\r\n\n b ")], "id int, t string"), "id", "t").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 2, "b")]


def test_store_and_ledger(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", 1)], "id string, n int")
    assert store.put_once("t", rows, ["id"], "id string, n int").isEmpty()
    assert store.put_once("t", rows, ["id"], "id string, n int").count() == 1
    store.upsert("t", spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int"), ["id"], "id string, n int")
    assert sorted(map(tuple, store.read("t", "id string, n int").collect())) == [("a", 2), ("b", 3)]
    queue = f"file://{tmp_path}/queue"
    seen = []
    for batch in (["a", "a", "b"], ["a", "b", "c"]):
        spark.createDataFrame([(k,) for k in batch], "idempotency_key string").write.mode("append").parquet(queue)

        def work(items):
            seen.append(sorted(r[0] for r in items.collect()))
            return items.withColumn("status", F.when(F.col("idempotency_key") == "b", "failed").otherwise("success"))

        consume(spark.readStream.schema("idempotency_key string").parquet(queue), store, work, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert seen == [["a", "b"], ["b", "c"]]
    assert {r[0]: (r[1], r[2]) for r in store.read("ledger", LEDGER).collect()} == {"a": ("success", 1), "b": ("failed", 2), "c": ("success", 1)}


def test_schedules_are_worked_out_once_for_each_kind(spark):
    """Sources of one zone, cadence, time and weekday share the work: it is done on the rows of an aggregate."""
    rows = [(k, zone, cadence, time, f"2026-06-0{1 + k % 3} 05:00:00") for k in range(12) for zone, cadence, time in [("Europe/London", "weekly", "07:30"), ("Europe/London", "manual", "07:30"), (None, "daily", None), ("Asia/Tokyo", None, "09:00")]]
    sources = spark.createDataFrame(rows, "id int, timezone string, cadence string, local_time string, next_scan_at string").withColumn("next_scan_at", F.to_timestamp("next_scan_at"))
    out = times.next_scan(sources, F.to_timestamp(F.lit("2026-06-10 11:30:00")))
    assert out.columns == [*sources.columns, "next_scan"] and out.count() == len(rows)
    got = {(r["id"] % 3, str(r["next_scan"])) for r in out.where("cadence = 'weekly'").collect()}
    assert got == {(0, "2026-06-15 06:30:00"), (1, "2026-06-16 06:30:00"), (2, "2026-06-17 06:30:00")}
    assert out.where("cadence <> 'weekly' or cadence is null").where("next_scan is not null").isEmpty()
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString()
