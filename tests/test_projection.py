"""The projection on a small world, item by item."""

import pytest
from pyspark.sql import functions as F

from claimspark.operators import projection, reconcile
from claimspark.sources.sinks import write_projection
from claimspark.sources.store import Store

NOW = "2026-08-14 00:00:00"
ITEM = "idempotency_key string, source_id string, observation_id string, candidate_key string, action string, claim_ids array<string>"


@pytest.fixture(scope="module")
def world(spark):
    make = spark.createDataFrame
    sources = make([("cur", "curated", False, "aws"), ("own", "artist-owned", False, "aws"), ("sha", "curated", True, "aws"), ("oth", "curated", False, "cowork"), ("cap", "capture", False, "aws")], "source_id string, authority string, shadow boolean, writer string")

    def claims(source, key, at="2026-08-01T00:00:00Z", **values):
        base = {"hasPerformer": '{"name":"The Foos"}', "occursAt": '{"name":"The Bull","location":"Town"}', "occursOn": "2026-09-01", "startsAt": "20:00", "hasStatus": "scheduled"}
        return [(f"{source}-{key}-{p}", source, f"event:{source}:{key}", p, v, at, "active") for p, v in (base | values).items() if v is not None]

    rows = claims("cur", "1") + claims("cur", "2", occursAt='{"name":"New Room","location":"Town"}', hasPerformer='{"name":"New Act"}') + claims("cur", "3", startsAt=None, occursAt='{"name":"X"}')
    rows += claims("sha", "1") + claims("oth", "1") + claims("cur", "4", occursOn="2026-09-04") + claims("own", "4", occursOn="2026-09-04") + claims("cur", "5", occursOn="2026-09-05") + claims("own", "9", occursOn="2026-09-09") + claims("cap", "9", occursOn="2026-09-09")
    rows += [("stale", "own", "x", "hasStatus", "s", "2026-01-01T00:00:00Z", "active")]
    all_claims = make(rows, "claim_id string, source_id string, subject string, predicate string, value string, observed_at string, status string")
    mappings = make([("cur", "event:cur:5", "a1", "v1", "e5"), ("cap", "event:cap:9", None, None, "e9"), ("own", "event:own:9", "a1", "v1", "e9")], "source_id string, candidate_key string, artist_id string, venue_id string, event_id string")
    artists, venues = make([("a1", "the  foos")], "id string, name string"), make([("v1", "The Bull")], "id string, name string")
    event = "id string, artist_id string, artist_ids array<string>, venue_id string, date string, cancelled boolean, is_public boolean, membership_id string, verified_by_artist boolean, external_ids array<struct<source:string,id:string>>"
    events = make([("e1", "a1", [], "v1", "2026-09-01", False, True, None, None, [("cur", "1")]), ("e5", "a1", [], "v1", "2026-09-05", False, True, "m", None, []), ("e9", "a1", [], "v1", "2026-09-09", False, True, None, False, [])], event)
    graves = make([("a1", "v1", "2026-09-04", "active")], "artist_id string, venue_id string, date string, status string")
    links = make([("event", "e9", "own-9-hasStatus"), ("event", "e1", "stale")], "entity_type string, entity_id string, claim_id string")
    ledger = make([("done", "success"), ("tried", "failed")], "idempotency_key string, status string")
    return projection.World(sources, all_claims, mappings, artists, venues, events, graves, links, ledger)


CASES = {
    "done": ("cur", "1", "create", ("idempotent", None, None)), "tried": ("cur", "1", "update", ("success", None, "e1")), "unknown": ("zzz", "1", "create", ("exception", "Unknown source zzz", None)),
    "empty": ("cur", "77", "create", ("exception", "Projection item has no readable Claims", None)), "gaps": ("cur", "3", "create", ("exception", "Projection candidate event:cur:3 missing venueLocation, startTime", None)),
    "shadow": ("sha", "1", "create", ("shadow", "source is in shadow mode", None)), "other": ("oth", "1", "create", ("shadow", "writerAuthority=cowork", None)), "match": ("cur", "1", "create", ("success", None, "e1")),
    "buried": ("cur", "4", "create", ("exception", "active tombstone requires explicit owner/artist/venue-owned reinstatement", None)), "owned": ("cur", "5", "update", ("success", "owner-managed event blocks curated mutation", "e5")),
    "cancel": ("cur", "1", "cancel", ("success", None, "e1")), "lost": ("cur", "2", "withdraw", ("exception", "No canonical event mapping for destructive projection", None)),
    "weak": ("cap", "9", "cancel", ("exception", "fresh higher-authority support (artist-owned) blocks destructive projection", None)), "strong": ("own", "9", "withdraw", ("success", None, "e9")), "ownercancel": ("cur", "5", "cancel", ("exception", "owner-managed event blocks curated mutation", None)),
}


def items(spark, names):
    return spark.createDataFrame([(n, CASES[n][0], "obs", f"event:{CASES[n][0]}:{CASES[n][1]}", CASES[n][2], [f"{CASES[n][0]}-{CASES[n][1]}-hasStatus"]) for n in names], ITEM)


def test_outcomes(spark, world):
    got = {r["idempotency_key"]: (r["status"], r["message"], r["event_id"]) for r in projection.project(items(spark, CASES), world, F.to_timestamp(F.lit(NOW))).collect()}
    assert got == {name: want for name, (_, _, _, want) in CASES.items()}


def test_new_entities_are_created_once(spark, world):
    rows = spark.createDataFrame([(k, "cur", "obs", "event:cur:2", "create", ["cur-2-hasStatus"]) for k in ("i1", "i2")], ITEM)
    got = {r["idempotency_key"]: r for r in projection.project(rows, world, F.to_timestamp(F.lit(NOW))).collect()}
    assert got["i1"]["event_created"] and got["i1"]["artist_created"] and got["i1"]["venue_created"] and not (got["i2"]["event_created"] or got["i2"]["artist_created"] or got["i2"]["venue_created"])
    assert got["i1"]["event_id"] == got["i2"]["event_id"] and got["i1"]["artist_id"].startswith("artist-")


def test_changes_of_a_run(spark, world, tmp_path):
    outcomes = projection.project(items(spark, ["match", "strong", "gaps", "shadow"]), world, F.to_timestamp(F.lit(NOW)))
    reinstating = spark.createDataFrame([("back", "own", "obs", "event:own:4", "create", ["own-4-hasStatus"])], ITEM)
    outcomes = outcomes.unionByName(projection.project(reinstating, world, F.to_timestamp(F.lit(NOW)))).cache()
    every = items(spark, ["match", "strong", "gaps", "shadow"]).union(reinstating)
    found = projection.item_claims(every, world.claims)
    dated = projection.event_candidates(found).join(every.select("idempotency_key", F.element_at("claim_ids", 1).alias("claim_id")), "idempotency_key")
    graves = projection.tombstone_rows(outcomes, dated, world, NOW).collect()
    assert [(g["canonical_event_id"], g["reason"], g["event_fingerprint"], g["claim_id"]) for g in graves] == [("e9", "absent from complete snapshot", "a1|v1|2026-09-09", "own-9-hasStatus")]
    assert [tuple(r)[:4] for r in projection.reinstated(world.tombstones, outcomes, dated, NOW).collect()] == [("a1", "v1", "2026-09-04", "reinstated")]
    links = {(r["entity_type"], r["claim_id"]) for r in projection.support_links(outcomes, found, world.links).where("entity_id in ('e1', 'a1', 'v1')").collect()}
    assert {("event", "cur-1-occursOn"), ("artist", "cur-1-hasPerformer"), ("venue", "cur-1-occursAt")} <= links and ("artist", "cur-1-occursOn") not in links
    store = Store(spark, f"file://{tmp_path}/s", parts=2)
    for n in range(2):  # a run that is repeated changes nothing more
        assert write_projection(store, outcomes, found, dated, world, NOW, ("runs", 0)) == (n == 0)
    assert len(store.commits()) == 1
    events = {r["id"]: r for r in store.read("event", "id string, artist_id string, venue_id string, date string, start_time string, cancelled boolean, is_public boolean, external_ids array<struct<source:string,id:string>>").collect()}
    back = events.pop(next(e for e in events if e.startswith("event-")))
    assert set(events) == {"e9"} and (events["e9"]["is_public"], events["e9"]["cancelled"], events["e9"]["artist_id"]) == (False, False, "a1")
    assert (back["artist_id"], back["venue_id"], back["date"], back["start_time"], back["is_public"], back["cancelled"]) == ("a1", "v1", "2026-09-04", "20:00", True, False) and [tuple(x) for x in back["external_ids"]] == [("own", "4")]
    assert store.read("projection_mapping", "source_id string, candidate_key string, event_id string").count() == 4
    assert {(r["status"], r["superseded_by_claim_id"]) for r in store.read("tombstone", "id string, status string, superseded_by_claim_id string").collect()} == {("active", None), ("reinstated", "own-4-hasStatus")}
    assert [r["prior_claim_id"] for r in store.read("source_withdrawal", "id string, prior_claim_id string").collect()] == ["own-9-hasPerformer"]
    assert {(r["idempotency_key"], r["status"]) for r in store.read("projection_item", "idempotency_key string, status string").collect()} == {("match", "success"), ("strong", "success"), ("gaps", "success"), ("shadow", "shadow"), ("back", "success")}
    assert store.read("projection_exception", "id string, idempotency_key string, reason string, created_at string").count() == 1 and store.read("tombstone", "id string, reason string").count() == 2
    problems = projection.verified(outcomes, dated, world.events).collect()
    assert {(r["idempotency_key"], r["problem"]) for r in problems} == {("back", "missing")}


def test_update_payload(spark):
    row = spark.createDataFrame([("cur", "7", "a", "v", "2026-09-01", "20:00", "", "T", None, None, "5", "PAID_CONFIRMED", [("x", "1"), ("x", "1"), ("", "2")])], "source_id string, source_event_key string, artist_id string, venue_id string, date string, start_time string, end_time string, title string, event_url string, ticket_url string, price string, admission_status string, ids array<struct<source:string,id:string>>")
    got = row.select(*projection.update_payload(F.col("ids"))).first()
    assert [tuple(x) for x in got["external_ids"]] == [("x", "1"), ("cur", "7")] and got["title"] == "T" and got["end_time"] is None and got["ticketed"] is True


def test_no_growing_table_of_a_run_is_sent_to_every_task(spark):
    """Small files are large in memory: claims and candidates are dealt by their keys, whatever their size is estimated at."""
    items = spark.createDataFrame([("i1", "e1", ["c9"]), ("i2", "e2", ["c9"])], "idempotency_key string, candidate_key string, claim_ids array<string>")
    rows = [("c1", "s", "e1", "occursOn", "2026-01-02", "2026-01-01", "active"), ("c0", "s", "e1", "occursOn", "2026-01-03", "2026-01-01", "active"), ("c9", "s", "other", "occursOn", "2026-02-01", "2026-01-01", "active")]
    found = projection.item_claims(items, spark.createDataFrame(rows, "claim_id string, source_id string, subject string, predicate string, value string, observed_at string, status string"))
    dates = projection.event_candidates(found).select("idempotency_key", "date")
    assert sorted(map(tuple, dates.collect())) == [("i1", "2026-01-03"), ("i2", "2026-02-01")]
    assert "Broadcast" not in dates._jdf.queryExecution().executedPlan().toString()


def test_best_rows_are_dealt_once(spark):
    """One row of each key leaves a task, in one exchange; a null tie comes last and costs no row."""
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 2, "y"), ("a", 2, "x"), (None, 5, None)], "k string, n int, t string").repartition(3)
    best = reconcile.best_per_key(rows, ["k"], F.struct("n"), F.col("t"))
    assert sorted(map(tuple, best.collect()), key=str) == [("a", 2, "x"), (None, 5, None)]
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning(")


def test_claims_are_dealt_by_item_once(spark):
    rows = [("i1", "c2", "hasStatus", "late", "2026-02-01", "active", True), ("i1", "c1", "hasStatus", "tie", "2026-02-01", "active", True), ("i1", "c0", "hasStatus", "gone", "2026-03-01", "dropped", False), ("i2", "c9", "occursOn", "2026-09-01", "2026-01-01", "active", False)]
    found = spark.createDataFrame(rows, "idempotency_key string, claim_id string, predicate string, value string, observed_at string, status string, named boolean")
    out = projection.event_candidates(found)
    assert shuffles(out) == 1
    got = {r["idempotency_key"]: (r["status"], r["date"], r["last_observed"], r["n_claims"], r["proposed_claim_id"]) for r in out.collect()}
    assert got == {"i1": ("tie", None, "2026-03-01", 3, "c1"), "i2": (None, "2026-09-01", "2026-01-01", 1, None)}


def test_gates_carry_no_column_that_none_reads(spark, world):
    seen = []
    projection.project(items(spark, CASES), world, F.to_timestamp(F.lit(NOW)), lambda df: seen.append(set(df.columns)) or df)
    assert not any({"venue_address", "price"} & columns for columns in seen)


def test_item_claims_say_which_are_named(spark, world):
    got = {r["claim_id"] for r in projection.item_claims(items(spark, ["match", "empty"]), world.claims).where("named").collect()}
    assert got == {"cur-1-hasStatus"}


def with_claim(candidates):
    return candidates.withColumn("claim_id", F.try_element_at("claim_ids", F.lit(1)))


def test_claims_meet_their_items_where_these_are_dealt_by_candidate(spark, world):
    """Candidates are the same as those of all items' claims; claims are dealt by their subject and never by item."""
    rows = items(spark, CASES).union(spark.createDataFrame([("looked", "cur", "obs", "event:cur:99", "create", [f"cur-4-{p}" for p in ("occursOn", "hasPerformer", "occursAt", "startsAt", "hasStatus")])], ITEM))
    stages = []
    got = projection.item_candidates(rows, world.claims, lambda df: stages.append(df) or df)
    want = projection.event_candidates(projection.item_claims(rows, world.claims))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and {r["idempotency_key"] for r in got.where("looked_up").collect()} == {"looked"}
    assert shuffles(stages[0]) == 2 and len(stages) == 2
    again = projection.item_claims(got.join(rows.select("idempotency_key", "candidate_key"), "idempotency_key"), world.claims)
    assert sorted(map(str, again.collect())) == sorted(map(str, projection.item_claims(rows, world.claims).collect()))
    assert projection.item_claims(items(spark, ["match"]).withColumn("looked_up", F.lit(False)), world.claims).count() == 5


def test_stages_that_are_read_once_are_not_kept(spark, world):
    seen, rows = [], items(spark, CASES)
    out = projection.project(rows, world, F.to_timestamp(F.lit(NOW)), lambda df: seen.append(df) or df, with_claim(projection.item_candidates(rows, world.claims)))
    assert {r["idempotency_key"]: (r["status"], r["message"], r["event_id"]) for r in out.collect()} == {name: want for name, (_, _, _, want) in CASES.items()}
    assert len(seen) == 3 and not any("claim_ids" in df.columns for df in seen)


def test_a_run_that_looks_for_claims_itself_writes_the_same_tables(spark, world, tmp_path):
    rows = items(spark, ["match", "strong", "gaps", "shadow", "owned"]).union(spark.createDataFrame([("looked", "own", "obs", "event:own:99", "create", [f"own-4-{p}" for p in ("occursOn", "hasPerformer", "occursAt", "startsAt", "hasStatus")]), ("back", "own", "obs", "event:own:4", "create", ["own-4-hasStatus"])], ITEM))
    found, put = projection.item_claims(rows, world.claims), with_claim(projection.item_candidates(rows, world.claims))
    tables = []
    for name, claims in (("given", found), ("sought", None)):
        store = Store(spark, f"file://{tmp_path}/{name}")
        write_projection(store, projection.project(rows, world, F.to_timestamp(F.lit(NOW)), candidates=put), claims, put, world, NOW)
        read = lambda t: spark.read.parquet(*(f"{store.root}/{t}/{p['folder']}" for p in store.transaction()._listed(t)["parts"].values()))  # noqa: B023, E731
        tables.append({t: sorted(map(str, read(t).collect())) for t in store.state()[1]["tables"]})
    assert tables[0] == tables[1] and len(tables[0]["source_withdrawal"]) == 1 and any("own-4-occursOn" in r for r in tables[0]["support_link"])


def test_items_without_a_key_or_a_source_are_stopped_too(spark, world):
    rows = spark.createDataFrame([("nokey", "cur", "obs", None, "create", ["cur-3-occursAt"]), ("nosource", None, "obs", "event:cur:1", "create", [])], ITEM)
    got = {r["idempotency_key"]: (r["status"], r["message"]) for r in projection.project(rows, world, F.to_timestamp(F.lit(NOW))).collect()}
    assert got == {"nokey": ("exception", "Projection candidate null missing artistName, venueLocation, date, startTime"), "nosource": ("exception", "Unknown source null")}
