"""As-of joins, folds, trust, footprints, circles and redelivery against rules stated anew; and what no query calls."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from claimspark.functions import geo, times
from claimspark.operators import access, captures, enrich, reconcile, runs, tabular, trust
from claimspark.operators.asof import as_of
from claimspark.sources import landed, sinks
from claimspark.sources.store import Store
from claimspark.streaming.ledger import STATE
from claimspark.streaming.redelivery import redelivered


def test_as_of_is_the_last_before(spark):
    r = random.Random(2)
    rows = [(r.choice("aaaab"), r.randrange(60), f"r{i}", r.random() < 0.4) for i in range(300)] + [(None, 3, "n", True), ("a", None, "n", True)]
    asked = [(r.choice("aabc"), r.randrange(65), i) for i in range(120)] + [(None, 50, 900), ("a", None, 901)]
    got = as_of(spark.createDataFrame(asked, "k string, t int, i int"), spark.createDataFrame(rows, "k string, t int, run string, whole boolean").repartition(5), "k", "t", {"any": "true", "full": "whole"}, ["run"]).collect()
    assert len(got) == len(asked)
    for k, t, i in asked:
        past = [(y, z, w) for x, y, z, w in rows if x is not None and x == k and y is not None and t is not None and y < t]
        row = next(x for x in got if x["i"] == i)
        for name, fits in (("any", past), ("full", [p for p in past if p[2]])):
            want = max(fits, default=None)
            assert (row[name] and (row[name]["t"], row[name]["run"])) == (want and want[:2]), (k, t, name)


def test_baselines_join_no_pairs(spark):
    rows = spark.createDataFrame([(1, "r1", 1, True), (1, "r2", 2, False), (2, "q", 1, False)], "source_id int, run_id string, started_at int, complete boolean")
    asked = spark.createDataFrame([(1, "delta", "complete", True, 3), (1, "append-only", "complete", True, 4), (1, "delta", "complete", False, 2), (2, "delta", "complete", True, 9), (3, "delta", "complete", True, 9)], "source_id int, mode string, semantics string, complete boolean, started_at int")
    out = runs.baselines(rows, asked)
    assert {(r["source_id"], r["started_at"]): r["baseline"] for r in out.collect()} == {(1, 3): "r1", (1, 4): "r2", (1, 2): "r1", (2, 9): None, (3, 9): None}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fold_is_one_run_after_the_other(spark):
    r = random.Random(6)
    schema = "source_id string, started_at string, ok boolean, complete boolean, observation string, normalised string"
    all_runs = [(f"s{r.randrange(6)}", f"{r.randrange(30):02d}", r.random() < 0.5, r.choice([True, False, None]), f"o{i}", r.choice([None, f"n{i}"])) for i in range(80)]
    state = [("s0", "o", "c", "n", "m", "00", "00", None, 4), ("s9", "o", None, None, None, "00", None, "00", 2)]
    want = {s[0]: dict(zip([f.split()[0] for f in STATE.split(", ")], s)) for s in state}
    for s, at, ok, whole, seen, norm in sorted(set(all_runs), key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or False, x[4])):
        x = want.setdefault(s, dict.fromkeys([f.split()[0] for f in STATE.split(", ")]) | {"source_id": s, "consecutive_failures": 0})
        x["last_run_at"] = at
        if ok:
            x |= {"last_observation": seen, "last_normalised": norm, "last_success_at": at, "consecutive_failures": 0}
            if whole:
                x |= {"last_complete_observation": seen, "last_complete_normalised": norm}
        else:
            x |= {"last_failure_at": at, "consecutive_failures": x["consecutive_failures"] + 1}
    got = runs.folded(spark.createDataFrame(state, STATE), spark.createDataFrame(all_runs + all_runs[:5], schema).repartition(4)).collect()
    assert {r["source_id"]: r.asDict() for r in got} == want


def test_trust_and_resolution(spark):
    said = [("good", "x", "p", "1"), ("good2", "x", "p", "1"), ("bad", "x", "p", "2"), ("good", "y", "p", "1"), ("bad", "y", "p", "3"), ("new", "y", "p", "3"), ("good", "z", "p", "9"), ("good", "z", "p", None), ("good", "x", "p", "1")]
    made = spark.createDataFrame(said, "source string, subject string, predicate string, value string")
    sources = spark.createDataFrame([("good", 60), ("good2", 60), ("bad", 60)], "source string, score int")
    scores, held = trust.trust_scores(made, sources, 8)
    level = {r["source"]: r["trust"] for r in scores.collect()}
    assert level["good"] > level["bad"] and set(level) == {"good", "good2", "bad", "new"}
    got = {r["subject"]: (r["value"], r["contested"]) for r in trust.resolved(held).collect()}
    assert got["x"] == ("1", True) and got["z"] == ("9", False)
    # Authority goes before agreement.
    strong = sources.unionByName(spark.createDataFrame([("new", 90)], "source string, score int"))
    assert {r["subject"]: r["value"] for r in trust.resolved(trust.trust_scores(made, strong, 8)[1]).collect()}["y"] == "3"
    assert trust.trust_scores(made.where("false"), sources)[1].isEmpty()


def test_footprints_against_all_pairs(spark):
    r = random.Random(8)
    base = [set(r.sample(range(40), r.randint(1, 12))) for _ in range(8)]
    sets = {i: {t for t in base[i % 8] if r.random() < 0.8} | {r.randrange(40)} for i in range(50)}
    items = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s] + [(1, None), (None, 1)], "entity int, token int")
    for percent in (50, 75, 100):
        want = {(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert {tuple(x) for x in trust.footprint_pairs(items, percent).collect()} == want


def plain_geohash(lat, lon, length):
    box, out, even, bits = [[-90.0, 90.0], [-180.0, 180.0]], "", True, 0
    while len(out) < length:
        n = 0
        for _ in range(5):
            side, x = (box[1], lon) if even else (box[0], lat)
            mid = sum(side) / 2
            n = n * 2 + (x >= mid)
            side[x < mid] = mid
            even = not even
        out += geo.DIGITS[n]
    return out


def test_geohash_and_covers(spark):
    r = random.Random(9)
    places = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)] + [(900, 53.07, -2.52), (901, 90.0, 180.0), (902, -90.0, -180.0), (903, None, 0.0), (904, 91.0, 0.0)]
    rows = spark.createDataFrame(places, "id int, lat double, lon double")
    got = {x["id"]: (x["a"], x["b"]) for x in rows.select("id", geo.geohash(F.col("lat"), F.col("lon"), 4).alias("a"), geo.geohash(F.col("lat"), F.col("lon"), 5).alias("b")).collect()}
    assert all(got[i] == (plain_geohash(a, b, 4), plain_geohash(a, b, 5)) for i, a, b in places[:401]) and got[903] == got[904] == (None, None)
    circles = [(i, r.uniform(-89, 89), r.uniform(-180, 180), r.uniform(1, 3000)) for i in range(12)] + [(50, 89.5, 10.0, 400.0), (51, 10.0, 179.9, 500.0), (52, 0.0, -179.9, 900.0)]
    found = {(x["circle"], x["id"]) for x in geo.within(rows, spark.createDataFrame(circles, "circle int, lat double, lon double, radius double"), 3).collect()}

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH * math.asin(min(1, math.sqrt(h)))

    assert found == {(c, i) for c, a, b, q in circles for i, x, y in places[:403] if km(a, b, x, y) <= q}


def test_items_come_back_and_die_by_the_clock(spark, tmp_path):
    """No message comes after the first ones: timers deliver again, and the third lapse is the last."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    queue = f"file://{tmp_path}/q"
    spark.createDataFrame([("lost", False), ("fine", False), ("lost", False)], "id string, done boolean").coalesce(1).write.parquet(queue)
    stream = redelivered(spark.readStream.schema("id string, done boolean").parquet(queue), lease_ms=4000).writeStream.format("memory").queryName("again").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        seen = lambda: {(r["id"], r["outcome"], r["attempt"]) for r in spark.table("again").collect()}
        until = time.time() + 120
        while ("fine", "delivered", 1) not in seen() and time.time() < until:
            time.sleep(0.3)
        spark.createDataFrame([("fine", True)], "id string, done boolean").coalesce(1).write.mode("append").parquet(queue)
        while ("lost", "dead", 3) not in seen() and time.time() < until:
            time.sleep(0.3)
    finally:
        stream.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = seen()
    assert {("lost", "delivered", 1), ("lost", "delivered", 2), ("lost", "delivered", 3), ("lost", "dead", 3)} <= got
    assert any(x[:2] == ("fine", "done") for x in got) and ("fine", "dead", 3) not in got


def test_what_no_query_calls(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert [value(tabular.several_acts(F.lit(x))) for x in ("the-rigger-leek", "the-bull")] == [True, False]
    assert value(times.local_day(F.to_timestamp(F.lit("2026-06-01 23:30:00")), F.lit("Europe/London"), 1)).isoformat() == "2026-06-03"
    sources = spark.createDataFrame([("a", "browser"), ("b", None), ("c", "x")], "source_id string, runtime string")
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("zz",)], "source_id string")
    assert sorted(map(tuple, runs.dispatch_manual(sources, asked).collect())) == [("a", "browser", "manual"), ("b", "standard", "manual")]
    assert access.due(spark.createDataFrame([("a", True, 1), ("b", False, 1), ("c", True, 9), ("d", True, 0)], "source_id string, enabled boolean, next_scan int"), F.lit(5)).select("source_id").collect() == [("d",), ("a",)]
    assert sorted(r["n"] for r in access.newest(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 4)], "s string, at int, n int"), "s", "at", "n", 2).collect()) == [2, 3, 4]
    at = F.to_timestamp(F.lit("2026-06-01 23:30:00"))
    assert [x.isoformat() for x in value(times.date_window(at, 30))] == ["2026-06-01", "2026-07-01"] and str(value(times.horizon(at, 1, 45))) == "2026-06-03 00:15:00"
    assert tuple(value(times.zoned_parts(at, F.lit("Europe/London")))) == (2026, 6, 2, 0, 30, 0, 2)
    work = spark.createDataFrame([("event:s:1", "withdraw"), ("event:s:2", "create")], "candidate string, work string")
    gone = reconcile.withdrawal_claims(work, "s", "obs", "2026-01-01T00:00:00Z").collect()
    key = hashlib.sha256("\x1f".join(("obs", "event:s:1", "hasStatus", f'"{reconcile.ABSENT}"')).encode()).hexdigest()[:32]
    assert [(r["claim_id"], r["subject"], r["value"], r["status"]) for r in gone] == [(f"claim-{key}", "event:s:1", reconcile.ABSENT, "active")]
    held = spark.createDataFrame([(1, "old", None, "2026-01-01"), (2, "unprocessed", None, "2026-01-02"), (3, "unprocessed", "2026-02-01", "2026-01-01"), (4, "unprocessed", None, None)], "id int, status string, received_at string, captured_at string")
    assert [r["id"] for r in captures.unprocessed(held, 0).collect()] == [3] and [r["id"] for r in captures.unprocessed(held, 500).collect()] == [3, 2, 4]
    urls = F.array(F.lit("a"))
    assert value(captures.with_canonical_url(urls, F.lit("https://facebook.com/events/1"))) == ["https://facebook.com/events/1", "a"] and value(captures.with_canonical_url(urls, F.lit("b"))) == ["a"]
    named = enrich.named_by(spark.createDataFrame([("The Foos",), (" the bull ",), ("Other",)], "name string"), spark.createDataFrame([("the foos", "The Bull"), (None, None)], "artist_name string, venue_name string"))
    assert sorted(r[0] for r in named.collect()) == [" the bull ", "The Foos"]
    found = enrich.discovery_results(spark.createDataFrame([(["https://E.org/a?b", "x"],)], "evidence_urls array<string>")).first()["evidence"]
    assert [(e["source_url"], e["source_domain"]) for e in found] == [("https://E.org/a?b", "e.org"), ("x", "")] and found[0]["id"] == "ev_" + hashlib.sha1(b"https://E.org/a?b").hexdigest()[:12]
    texts = {c: "string" for c in ("v_bio", "x_bio", "v_artist_type", "x_artist_type")} | {c: "array<string>" for c in ("v_genres", "x_genres", "v_act_types", "x_act_types")} | {"v_confidence": "double", "x_confidence": "double"}
    row = spark.createDataFrame([("", "told", None, next(iter(enrich.ARTIST_TYPES)), [], [next(iter(enrich.GENRES)), "nonsense"], None, [next(iter(enrich.ACT_TYPES))], 0.2, None)], ", ".join(f"{c} {t}" for c, t in texts.items()))
    merged = row.select(*(v.alias(c) for c, v in enrich.merged_enrichment().items())).first()
    assert tuple(merged) == ("told", [next(iter(enrich.GENRES))], next(iter(enrich.ARTIST_TYPES)), [next(iter(enrich.ACT_TYPES))], 0.2)
    columns = {c: "string" for c, _ in captures.ARTIST_FIELDS} | {"act_types": "array<string>", "classification": "string", "n_events": "int", "cancelled": "boolean", "event_artist": "string", "venue_name": "string", "town": "string", "date": "string", "start_time": "string"}
    full = {c: ("x" if t == "string" else ["x"] if t.startswith("array") else 1 if t == "int" else False) for c, t in columns.items()} | {"classification": "event"}
    rows = [tuple(full.values()), tuple((full | {"town": "", "act_types": []}).values()), tuple((full | {"n_events": 2}).values())]
    ready = captures.readiness(spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in columns.items()))).collect()
    assert [(r["exact"], r["missing"], r["ready"]) for r in ready] == [(True, "", True), (True, "artist.actTypes, event.town", False), (False, "", False)]


def test_images_and_artifacts(spark, tmp_path):
    (tmp_path / "a.JPG").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "c.png").write_bytes(b"x" * 50)
    assert [(r["mime"], r["base64"]) for r in landed.images(spark, f"file://{tmp_path}/*", 20).collect()] == [("image/jpeg", "YWJj")]
    (tmp_path / "rows.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert [r["a"] for r in landed.artifact(spark, f"file://{tmp_path}/rows.json", "a int").collect()] == [1, 2] and landed.artifact(spark, None, "a int").isEmpty()
    with pytest.raises(ValueError):
        sinks.write_artifacts(spark.range(1), f"{tmp_path}", "other")


def test_discoveries_and_sheet_report(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    schema = "type string, id string, retrieved_at string, run_id string, class string, suppressed boolean, suppressed_until string"
    sinks.put_discoveries(store, spark.createDataFrame([("artist", "1", "2026-01-01", "r", "weak", False, None), ("artist", "1", "2026-01-02", "r", "strong", True, "2026-09-01")], schema))
    assert [(r["class"], r["suppressed"]) for r in store.read("eligibility", "type string, id string, class string, suppressed boolean").collect()] == [("strong", True)] and store.read("discovery_result", schema).count() == 2
    made = spark.createDataFrame([("create",), ("create",), ("update",)], "action string")
    assert dict(map(tuple, tabular.run_report(made, made.limit(1)).collect())) == {"create": 2, "update": 1, "exception": 1}


def test_cells_of_circles_are_not_sent_to_every_task(spark):
    """The estimate of a table of circles knows nothing of their cells: a join that trusts it sends millions of rows through the driver."""
    places = spark.range(4).select(F.col("id").alias("place"), (F.col("id") * 1.0).alias("lat"), (F.col("id") * 1.0).alias("lon"))
    circles = spark.range(2).select(F.col("id").alias("circle"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(160.0).alias("radius"))
    found = geo.within(places, circles, 3)
    assert sorted((r["place"], r["circle"]) for r in found.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
