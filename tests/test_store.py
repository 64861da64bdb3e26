"""The store: transactions over several tables, growth, and lookups that open few files."""

import time

import pytest
from pyspark.sql import functions as F

from claimspark.sources import store as stores
from claimspark.sources.shared import SWEEP, kept
from claimspark.sources.store import Conflict, Store

CLAIM = "claim_id string, subject string, n int"


def claims(spark, ids):
    return spark.createDataFrame([(f"c{i}", f"s{i // 3}", i) for i in ids], CLAIM)


def test_a_transaction_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.upsert("a", claims(spark, [1]), ["claim_id"], CLAIM)
    before = store.read("a", CLAIM)
    with pytest.raises(RuntimeError, match="lost"), store.transaction() as t:
        t.upsert("a", claims(spark, [1, 2]), ["claim_id"], CLAIM)
        assert t.read("a", CLAIM).count() == 2 and store.read("a", CLAIM).count() == 1
        raise RuntimeError("lost between two puts")
    assert store.read("a", CLAIM).count() == 1 and store.read("b", CLAIM).isEmpty() and len(store.commits()) == 1
    with store.transaction() as t:
        t.upsert("a", claims(spark, [2]), ["claim_id"], CLAIM)
        t.put_once("b", claims(spark, [3]), ["claim_id"], CLAIM)
        assert store.read("b", CLAIM).isEmpty()
    assert len(store.commits()) == 2 and store.read("a", CLAIM).count() == 2 and store.read("b", CLAIM).count() == 1 and before.count() == 1


def test_writers_of_unlike_tables_go_on_side_by_side(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one, two, three = store.transaction(), store.transaction(), store.transaction()
    one.upsert("a", claims(spark, [1]), ["claim_id"], CLAIM)
    two.upsert("b", claims(spark, [2]), ["claim_id"], CLAIM)
    three.read("a", CLAIM)
    three.upsert("c", claims(spark, [3]), ["claim_id"], CLAIM)
    one.commit()
    two.commit()
    with pytest.raises(Conflict):
        three.commit()
    assert store.read("a", CLAIM).count() == 1 == store.read("b", CLAIM).count() and store.read("c", CLAIM).isEmpty()


def test_a_batch_is_committed_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for batch in (0, 1, 1, 0, 2):
        with store.transaction() as t:
            if not t.once("query", batch):
                t.writer = None
                continue
            now = t.read("a", CLAIM)
            t.upsert("a", now.selectExpr("claim_id", "subject", "n + 1 as n") if not now.isEmpty() else claims(spark, [0]), ["claim_id"], CLAIM)
    assert store.read("a", CLAIM).first()["n"] == 2
    first, second = store.transaction(), store.transaction()
    assert first.once("query", 3) and second.once("query", 3)
    first.commit()
    with pytest.raises(Conflict):
        second.commit()


def test_tables_grow_and_lookups_open_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PART_ROWS", 50)
    store = Store(spark, f"file://{tmp_path}/s", indexes={"claim": ["subject", "n"]})
    store.upsert("claim", claims(spark, range(40)), ["claim_id"], CLAIM)
    assert len(store.transaction()._listed("claim")["parts"]) == 1
    store.upsert("claim", claims(spark, range(30, 600)), ["claim_id"], CLAIM)
    listed = store.transaction()._listed("claim")
    assert listed["n"] == 16 and len(listed["parts"]) == 16 and store.read("claim", CLAIM).count() == 600
    folders = lambda df: {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    by_key = store.lookup("claim", CLAIM, "claim_id", ["c77"])
    assert len(folders(by_key)) == 1 and [r["n"] for r in by_key.collect()] == [77]
    for s in (0, 50, 199):
        found = store.lookup("claim", CLAIM, "subject", [f"s{s}"])
        assert sorted(r["n"] for r in found.collect()) == [3 * s, 3 * s + 1, 3 * s + 2] and len(folders(found)) <= 5
    assert store.lookup("claim", CLAIM, "subject", ["nobody"]).isEmpty() and [r["claim_id"] for r in store.lookup("claim", CLAIM, "n", [5]).collect()] == ["c5"]
    assert {r["n"] for r in store.lookup("claim", CLAIM, "claim_id", ["c1", "c2", "c900"]).collect()} == {1, 2}
    # A change of one key rewrites one part, and its index follows.
    before = {p["folder"] for p in listed["parts"].values()}
    store.upsert("claim", spark.createDataFrame([("c77", "moved", 77)], CLAIM), ["claim_id"], CLAIM)
    after = {p["folder"] for p in store.transaction()._listed("claim")["parts"].values()}
    assert len(after - before) == 1 and store.lookup("claim", CLAIM, "subject", ["moved"]).first()["claim_id"] == "c77"
    assert sorted(r["n"] for r in store.lookup("claim", CLAIM, "subject", ["s25"]).collect()) == [75, 76]


def test_old_commits_are_forgotten_but_not_what_is_being_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", indexes={"a": ["subject"]})
    slow = store.transaction()
    slow.upsert("b", claims(spark, [9]), ["claim_id"], CLAIM)
    for i in range(6):
        store.upsert("a", claims(spark, [0, i]).distinct(), ["claim_id"], CLAIM)
    assert len(store.commits()) == stores.VERSIONS
    runs = [p for p in (tmp_path / "s" / "a").iterdir() if p.is_dir() and not p.name.endswith(".index")]
    assert len(runs) == stores.VERSIONS
    slow.commit()
    assert store.read("b", CLAIM).count() == 1 and store.read("a", CLAIM).count() == 6


def test_keys_of_a_table_are_not_sent_to_every_task(spark, tmp_path):
    plans, store = [], Store(spark, f"file://{tmp_path}/s")
    store.upsert("t", spark.range(5).select("id", F.lit("a").alias("v")), ["id"], "id long, v string")
    with store.transaction() as change:
        real = change.change
        change.change = lambda name, keys, schema, touched, made: real(name, keys, schema, touched, lambda now: plans.append(made(now)) or made(now))
        change.upsert("t", spark.range(3, 7).select("id", F.lit("b").alias("v")), ["id"], "id long, v string")
        change.put_once("t", spark.range(6, 9).select("id", F.lit("c").alias("v")), ["id"], "id long, v string")
    assert sorted(map(tuple, store.read("t", "id long, v string").collect())) == [(0, "a"), (1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, "b"), (7, "c"), (8, "c")]
    assert len(plans) == 2 and not any("Broadcast" in p._jdf.queryExecution().sparkPlan().toString() for p in plans)


def test_rows_whose_keys_are_taken_leave_untouched_parts_as_they_are(spark, tmp_path):
    store, make = Store(spark, f"file://{tmp_path}/s", parts=8), lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    store.put_once("t", make(range(50), "old"), ["id"], "id long, v string")
    taken = store.put_once("t", make([*range(9), 100], "new"), ["id"], "id long, v string")
    rows = {r["id"]: r["v"] for r in store.read("t", "id long, v string").collect()}
    assert rows == {**dict.fromkeys(range(50), "old"), 100: "new"} and sorted(map(tuple, taken.collect())) == [(i, "new") for i in range(9)]


def test_a_table_that_is_not_there_costs_no_exchange(spark, tmp_path):
    none = Store(spark, f"file://{tmp_path}/s").read("t", "id long, v string")
    plan = spark.range(5).join(none.hint("merge"), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert none.isEmpty() and "Exchange" not in plan


def test_what_is_kept_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles().toList()) if f.getName().startswith("shuffle_")}
    before, setting = held(), spark.conf.get(SWEEP)
    rows = kept(spark.range(1000).repartition(3, "id"))
    ends = time.time() + 3
    while held() - before and time.time() < ends:
        time.sleep(0.1)
    assert not held() - before and rows.count() == 1000 and spark.conf.get(SWEEP) == setting
