"""Decision tables on small rows: authority, absence, parity, schedules, share targets, listings, store and streams."""

import pytest
from pyspark.sql import functions as F

from claimspark.functions import text, times
from claimspark.operators import assess, captures, claims, graph, listings, reconcile, runs, tabular
from claimspark.sources.store import Conflict, Store
from claimspark.streaming.ledger import STATE, track_runs
from claimspark.streaming.lease import leases


def value(spark, column):
    return spark.range(1).select(column).first()[0]


PROPOSAL = "authority string, proposed int, support int, owner_managed boolean, tombstoned boolean, destructive boolean, mutation boolean"


@pytest.mark.parametrize(("row", "want"), [
    (("curated", 65, None, True, False, True, False), "owner-managed"), (("curated", 65, None, True, False, False, True), "owner-managed"), (("curated", 65, None, True, False, False, False), "allow"),
    (("artist-owned", 92, 100, True, False, False, True), "allow"), (("curated", 65, None, False, True, False, True), "tombstone"), (("venue-owned", 95, None, False, True, False, True), "allow"),
    (("official-ticket", 88, None, False, True, False, True), "tombstone"), (("curated", 65, 95, False, False, True, False), "stronger-support"), (("curated", 65, 65, False, False, True, False), "allow"),
    (("capture", 35, None, False, True, True, False), "allow"),
])
def test_authority(spark, row, want):
    assert claims.decide(spark.createDataFrame([row], PROPOSAL)).first()["decision"] == want


@pytest.mark.parametrize(("complete", "mode", "semantics", "gone", "past"), [
    (True, "delta", "complete", "withdrawn", "pastDropped"), (False, "delta", "complete", "ignoredAbsence", "ignoredAbsence"), (True, "append-only", "complete", "ignoredAbsence", "ignoredAbsence"),
    (True, "delta", "incremental", "ignoredAbsence", "ignoredAbsence"), (True, "delta", "one_shot", "ignoredAbsence", "ignoredAbsence"),
])
def test_absence(spark, complete, mode, semantics, gone, past):
    b = spark.createDataFrame([("e1", "x", "2026-08-21"), ("e2", "x", "2026-08-01"), ("e3", "x", None)], "key string, print string, date string")
    a = spark.createDataFrame([], "key string, print string, date string")
    got = {r["key"]: r["action"] for r in reconcile.snapshot_diff(b, a, F.lit("2026-08-14"), complete, mode, semantics).collect()}
    assert got == {"e1": gone, "e2": past, "e3": gone}


def test_parity_has_one_difference_for_an_event_on_one_side(spark):
    schema = "key string, artist_name string, price string"
    e = spark.createDataFrame([("k1", "A", "5"), ("k2", "B", None), ("k3", "C", "1")], schema)
    a = spark.createDataFrame([("k1", "A!", "6"), ("k3", "C", "1"), ("k4", "D", None)], schema)
    allowed = spark.createDataFrame([("events.k1.price",), ("events.k9.price",)], "path string")
    got = {r["path"]: (r["classification"], r["material"]) for r in assess.parity(e, a, "key", allowed=allowed).collect()}
    assert got == {"events.k1.artist_name": ("IDENTITY_DIFFERENCE", True), "events.k1.price": ("EXPECTED_RULE_CHANGE", False), "events.k2": ("PROJECTION_DIFFERENCE", True), "events.k4": ("PROJECTION_DIFFERENCE", True)}
    artifact = "source_id string, evidence_sha256 string, parked_by_reason string, diff string"
    one, two = spark.createDataFrame([("s", "x", "{}", None)], artifact), spark.createDataFrame([("s", "y", '{"a":1}', None)], artifact)
    assert {(r["path"], r["classification"]) for r in assess.parity_artifacts(one, two).collect()} == {("evidenceSha256", "INPUT_DIFFERENCE"), ("parkedByReason", "DEFECT")}
    assert assess.parity_artifacts(one, one).isEmpty()


@pytest.mark.parametrize(("cadence", "anchor", "now", "want"), [
    ("weekly", "2026-08-12 04:00:00", "2026-08-14 12:00:00", "2026-08-19 04:00:00"), ("weekly", None, "2026-08-14 12:00:00", "2026-08-21 04:00:00"), ("twice-daily", None, "2026-08-14 05:00:00", "2026-08-14 16:00:00"),
    ("daily", None, "2026-01-14 05:00:00", "2026-01-15 05:00:00"),
])
def test_schedule(spark, cadence, anchor, now, want):
    row = spark.createDataFrame([("s", "Europe/London", cadence, "05:00", anchor)], "id string, timezone string, cadence string, local_time string, next_scan_at string").withColumn("next_scan_at", F.to_timestamp("next_scan_at"))
    assert times.next_scan(row, F.to_timestamp(F.lit(now))).select(F.col("next_scan").cast("string")).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.facebook.com/somevenue/events/12", "facebook_event"), ("https://facebook.com/share/1AbC/", "facebook_share"), ("https://m.facebook.com/act", "facebook_url"), ("https://fb.me/e/x1", "facebook_event_short"), ("ftp://x.org/a", "unknown"),
    ("https://instagram.com/p/1", "instagram_url"), ("https://x.org/events/1", "generic_url"), (None, "unknown"),
])
def test_share_targets(spark, url, want):
    assert value(spark, text.target_kind(F.lit(url).cast("string"))) == want


def test_share_refinement(spark):
    share, event = "https://facebook.com/share/1/", "https://facebook.com/events/9/"
    assert value(spark, text.refined_kind(F.lit("facebook_share"), F.lit(event))) == "facebook_event"
    assert value(spark, text.refined_kind(F.lit("facebook_event"), F.lit("https://facebook.com/login"))) == "facebook_event"
    assert value(spark, captures.resolved_share(F.lit(share), F.lit("https://x.org/"))) == share and value(spark, captures.resolved_share(F.lit(share), F.lit(event))) == event


@pytest.mark.parametrize(("raw", "want"), [("HTTPS://Example.ORG:443/a", "https://example.org/a"), ("https://example.org", "https://example.org"), ("https://e.org/?ref=1&b=2&utm_x=3#f", "https://e.org/?b=2"), (" not an address ", "not an address"), ("http://e.org:8080/x/", "http://e.org:8080/x")])
def test_canonical_url(spark, raw, want):
    assert value(spark, text.canonical_url(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("20:30:00", ("20:30", False)), ("(8pm)", ("20:00", False)), ("Matinee 3 - 6pm", ("15:00", False)), ("£5", ("21:00", True)), ("12am", ("00:00", False)), ("8.30pm, free entry", ("20:30", False)), ("21 August 2026", ("21:00", True)), ("nonsense", ("21:00", True))])
def test_stage_times(spark, raw, want):
    got = value(spark, times.stage_time(F.lit(raw)))
    assert (got["time"], got["defaulted"]) == want and (got["warning"] is not None) == want[1]


@pytest.mark.parametrize(("raw", "want"), [("2026-8-1", "2026-08-01"), ("21 Aug 2026", "2026-08-21"), ("Friday 21 August 2026", "2026-08-21"), ("2026-02-31", None), ("1/2/26", "2026-02-01"), ("1/1/2019", None)])
def test_dates(spark, raw, want):
    got = value(spark, times.uk_date(F.lit(raw)))
    assert (str(got) if got else None) == want


def test_listing(spark):
    page = """The Foos at early, 8pm
        Friday 21st August
        The Foos at The Bull, Marple, 8:30pm
        Ann Duo from 9pm - White Hart Woodley
        Reserved - Town Hall
        Blues Jam at The Mill
        Karaoke - The Mill
        DJ Ann - The Mill
        - The Mill
        The Mill, 8pm
        Band at looking for a venue
        Band - Club - branded
        8pm - The Mill
        contact: someone
        Monday 3rd Foo
        Lost Band at The Mill
        Saturday 22nd August
        Late Band - The Mill"""
    lines = spark.createDataFrame([(1, k, line.strip()) for k, line in enumerate(page.split("\n"))], "page int, line int, body string")
    found = listings.listed(lines, "page", "line", "body", 2026)
    got = [(r["line"], r["date"], r["artist"], r["venue"], r["time"], r["reason"]) for r in found.orderBy("line").collect()]
    assert [(x[0], x[5]) for x in got if x[5]] == [(4, "placeholder_performer"), (5, "jam_night"), (6, "generic_recurring"), (7, "generic_dj"), (8, "venue_only"), (9, "venue_only"), (10, "placeholder_venue"), (11, "placeholder_venue_booking"), (12, "time_not_artist")]
    events = {r["line"]: (r["date"], r["artist_name"], r["venue_name"], r["start_time"], r["time_defaulted"]) for r in listings.listed_events(found, keep=("line",)).collect()}
    assert events == {2: ("2026-08-21", "The Foos", "The Bull, Marple", "20:30", False), 3: ("2026-08-21", "Ann Duo", "White Hart Woodley", "21:00", False), 17: ("2026-08-22", "Late Band", "The Mill", "20:00", True)}
    assert {r["reason"]: r["n"] for r in assess.parked_counts(listings.parked(found)).collect()}["venue_only"] == 2
    keys = {r["source_event_key"] for r in listings.listed_events(found).collect()}
    assert "2026-08-21_ann_white-hart-woodley" in keys
    with pytest.raises(ValueError):
        listings.gate(found.where("false"))


def test_headers_are_carried_over_blocks(spark):
    rows = [(1, k, "2026-01-01" if k == 3 else "" if k == 17 else "2026-02-02" if k == 25 else None) for k in range(40)] + [(None, 0, "x"), (None, 9, None)]
    lines = spark.createDataFrame(rows, "d int, n int, h string")
    got = {(r["d"], r["n"]): r["v"] for r in assess.carry_forward(lines, "d", "n", F.col("h"), "v", block=4).collect()}
    assert got == {**{(1, k): "2026-01-01" for k in range(3, 17)}, **{(1, k): "2026-02-02" for k in range(25, 40)}, (None, 0): "x", (None, 9): "x"}


def test_towns_and_regions(spark):
    assert tuple(value(spark, tabular.town(F.lit("The Rose, Hanley")))) == ("Stoke-on-Trent", False) and tuple(value(spark, tabular.town(F.lit("Nowhere")))) == ("Stoke-on-Trent", True)
    assert tuple(value(spark, tabular.region(F.lit("X, Crewe")))) == ("Cheshire", "Crewe") and tuple(value(spark, tabular.region(F.lit("X, Othertown")))) == ("Staffordshire", "Othertown") and tuple(value(spark, tabular.region(F.lit("X")))) == ("Staffordshire", "")


def test_failures_in_a_row(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 1, True), ("c", 1, False)], "s string, t int, ok boolean")
    got = {r["s"]: r["consecutive_failures"] for r in runs.failures_in_a_row(rows, "s", "t", F.col("ok"), "t").collect()}
    assert got == {"a": 2, "b": 0, "c": 1}
    assert {(r["s"], r["t"]): r["failures"] for r in runs.islands(rows, "s", "t", F.col("ok")).collect()}["a", 4] == 2


def test_store_swaps_and_tells_conflicts(spark, tmp_path):
    store, schema = Store(spark, f"file://{tmp_path}/s", parts=4), "id string, at string"
    rows = spark.createDataFrame([(f"k{n}", "1") for n in range(20)], schema)
    store.put_once("t", rows.union(rows), ["id"], schema, strict=True)
    with pytest.raises(ValueError):
        store.put_once("t", rows, ["id"], schema, strict=True)
    moves = spark.createDataFrame([("k1", "1", "2"), ("k2", "0", "2"), ("none", "1", "2")], "id string, expected string, new string")
    assert {r["id"]: r["outcome"] for r in store.swap("t", moves, "id", "at", schema).collect()} == {"k1": "swapped", "k2": "stale", "none": "stale"}
    assert {r["id"] for r in store.read("t", schema).where("at = '2'").collect()} == {"k1"} and store.read("t", schema).count() == 20
    for n in range(5):
        store.upsert("t", spark.createDataFrame([("k3", str(n))], schema), ["id"], schema)
    assert len(store.commits()) == 3 and store.read("t", schema).where("id = 'k3'").first()["at"] == "4" and store.read("t", schema).count() == 20
    late = store.transaction()
    late.upsert("t", spark.createDataFrame([("k3", "late")], schema), ["id"], schema)
    store.upsert("t", spark.createDataFrame([("k4", "first")], schema), ["id"], schema)
    with pytest.raises(Conflict):
        late.commit()


def test_run_state_stream(spark, tmp_path):
    schema = "source_id string, started_at string, ok boolean, complete boolean, observation string, normalised string"
    store, queue = Store(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/q"
    for batch in ([("a", "1", True, True, "o1", "n1"), ("a", "2", False, None, None, None)], [("a", "3", False, None, None, None), ("b", "1", True, False, "p1", "m1"), ("a", "4", True, False, "o4", "n4"), ("a", "5", False, None, None, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(queue)
        track_runs(spark.readStream.schema(schema).parquet(queue), store, f"file://{tmp_path}/c").awaitTermination()
    got = {r["source_id"]: (r["last_observation"], r["last_complete_observation"], r["last_run_at"], r["last_success_at"], r["consecutive_failures"]) for r in store.read("source_state", STATE).collect()}
    assert got == {"a": ("o4", "o1", "5", "4", 1), "b": ("p1", None, "1", "1", 0)}


def test_leases(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, queue = "id string, owner string, at timestamp, done boolean", f"file://{tmp_path}/q"
    rows = [("c", "x", "2026-01-01 00:00:00", False), ("c", "y", "2026-01-01 00:05:00", False), ("c", "y", "2026-01-01 00:21:00", False), ("c", "y", "2026-01-01 00:30:00", True), ("c", "x", "2026-01-01 02:00:00", False)]
    spark.createDataFrame(rows, "id string, owner string, at string, done boolean").withColumn("at", F.to_timestamp("at")).write.parquet(queue)
    stream = leases(spark.readStream.schema(schema).parquet(queue), 20).writeStream.format("memory").queryName("leases").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    stream.awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert [r["outcome"] for r in spark.table("leases").orderBy("at").collect()] == ["claimed", "refused", "claimed", "released", "finished"]


def test_leases_of_requests_without_time_or_owner(spark, tmp_path):
    """Whole rows go through, and no call of the state's server for each capture: a request without a time is refused, not an error."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, queue = "id string, owner string, at timestamp, done boolean", f"file://{tmp_path}/q"
    rows = [("c", None, "2026-01-01 00:05:00.000001", None), ("c", "x", "2026-01-01 00:05:00.000001", False), ("c", "z", None, False), ("d", "x", None, True)]
    spark.createDataFrame(rows, "id string, owner string, at string, done boolean").withColumn("at", F.to_timestamp("at")).write.parquet(queue)
    out = leases(spark.readStream.schema(schema).parquet(queue), 20)
    assert "Pandas" in out._jdf.queryExecution().analyzed().toString() and "TransformWithState" not in out._jdf.queryExecution().analyzed().toString()
    out.writeStream.format("memory").queryName("odd_leases").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r["id"], r["owner"], str(r["at"]), r["outcome"], str(r["lease_until"])) for r in spark.table("odd_leases").collect()}
    assert got == {
        ("c", "x", "2026-01-01 00:05:00.000001", "claimed", "2026-01-01 00:25:00.000001"), ("c", None, "2026-01-01 00:05:00.000001", "refused", "None"),
        ("c", "z", "None", "refused", "None"), ("d", "x", "None", "refused", "None"),
    }


def test_claims_about_no_node_are_not_gathered(spark):
    made = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = spark.createDataFrame([("k2", "a", "p", "v"), ("k1", "a", "p", "v")] + [(f"n{i}", "nobody", "p", "v") for i in range(50)], "claim_id string, subject string, predicate string, value string")
    out = graph.with_claims(made, rows)
    assert {r["id"]: r["claims"] and [c["claim_id"] for c in r["claims"]] for r in out.collect()} == {"a": ["k1", "k2"], "b": None}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
