"""Landed listings and sheets as data sources, queues with whole batches, and the adapters above them."""

import pytest
from pyspark.sql import functions as F

from claimspark.operators import tabular
from claimspark.sources import adapters, formats, sinks


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_bytes(body.encode())


def read(spark, kind, folder, **options):
    return spark.read.format(kind).options(path=f"file://{folder}", **options).load()


def test_listing_lines_and_shares(spark, tmp_path):
    put(tmp_path / "in", a__txt="one\r\n\r\n two \rthree", b__txt="", c__txt="é\n" * 50)
    (tmp_path / "in" / "_temporary").mkdir()
    (tmp_path / "in" / "_temporary" / "x.txt").write_text("no")
    (tmp_path / "in" / ".hidden").write_text("no")
    rows = read(spark, "listing", tmp_path / "in", sharebytes=10)
    assert [tuple(r) for r in rows.where("document = 'a'").orderBy("line").collect()] == [("a", 0, "one"), ("a", 2, "two"), ("a", 3, "three")]
    assert rows.where("document = 'c'").count() == 50 and rows.rdd.getNumPartitions() == 3
    assert read(spark, "listing", tmp_path / "none").isEmpty()


def test_sheets(spark, tmp_path):
    put(tmp_path / "in", a__csv='date,artist,venue,time,genre,url\n1/1/26,"A, ""B""",V,8pm,,x\n,,,,,\n2/1/26,"two\nlines",V', b__csv=',date,artist,venue,time,genre,url\n,3/1/26, C ,V,,Rock,u\n')
    rows = {(r["document"], r["row_index"]): tuple(r)[2:] for r in read(spark, "sheet", tmp_path / "in").collect()}
    assert rows == {("a", 2): ("1/1/26", 'A, "B"', "V", "8pm", "", "x"), ("a", 3): ("2/1/26", "two\nlines", "V", "", "", ""), ("b", 2): ("3/1/26", "C", "V", "", "Rock", "u")}
    lines = spark.createDataFrame([(",a,b",), ('"",a',), ("a,,b",), ("",)], "x string")
    assert [r[0] for r in lines.select(tabular.misaligned(F.col("x"))).collect()] == [True, True, False, False]
    wide = spark.createDataFrame([("", "1", "2", "3", "4", "5", "6", "7")], "z string, a string, b string, c string, d string, e string, f string, g string")
    assert tabular.realigned(wide).columns == list("abcdef")
    none = wide.where("false")
    assert tabular.preferred(none, wide, none).count() == 1 and tabular.preferred(none, none).isEmpty()


def test_listing_stream_reads_each_file_once(spark, tmp_path):
    folder, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"

    def run():
        spark.readStream.format("listing").option("path", f"file://{folder}").load().writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r["body"] for r in spark.read.parquet(out).collect())

    put(folder, f1__txt="a\nb", f2__txt="c")
    assert run() == ["a", "b", "c"]
    put(folder, f3__txt="d")
    assert run() == ["a", "b", "c", "d"] == run()


def test_a_batch_is_sent_once_and_whole(spark, tmp_path):
    queue = f"file://{tmp_path}/q"
    items = spark.range(100).selectExpr("concat('i', id) as idempotency_key", "if(id % 10 = 0, null, 's') as source_id")
    for _ in range(2):
        left = sinks.publish(items.repartition(4), queue, ["idempotency_key", "source_id"], "b0")
    assert left.count() == 10 and read(spark, "queue", tmp_path / "q").count() == 90
    # A task that is lost halfway: the batch isn't seen, what was staged goes, and the repeated sending is whole.
    lost = F.udf(lambda i: 1 // (i != "i77") and i, "string")
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        items.repartition(4).withColumn("idempotency_key", lost("idempotency_key")).write.format("queue").option("path", queue).option("batch", "b1").mode("append").save()
    assert read(spark, "queue", tmp_path / "q").count() == 90
    sinks.publish(items, queue, ["idempotency_key"], "b1")
    got = read(spark, "queue", tmp_path / "q")
    assert got.count() == 190 and got.columns == ["idempotency_key", "source_id"]
    with pytest.raises(Exception, match="appended"):
        items.write.format("queue").option("path", queue).mode("overwrite").save()


def test_queue_streams(spark, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    for n in range(2):
        sinks.publish(spark.range(5 * n, 5 * n + 5).toDF("id"), f"file://{first}", ["id"], f"{n:04d}")

    def run(check="c"):
        stream = spark.readStream.format("queue").option("path", f"file://{first}").load()
        stream.writeStream.format("queue").option("path", f"file://{second}").option("writer", "copy").option("checkpointLocation", f"{tmp_path}/{check}").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in read(spark, "queue", second).collect())

    assert run() == list(range(10))
    sinks.publish(spark.range(10, 12).toDF("id"), f"file://{first}", ["id"], "0002")
    assert run() == list(range(12)) == run()
    # A lost checkpoint replays batch 0 under its old name: nothing is sent again.
    assert run("new") == list(range(12))


def test_adapters(spark, tmp_path):
    put(tmp_path / "in", a__txt="Friday 21st August\nThe Foos at The Bull, Marple\nBlues Jam at The Mill")
    found = adapters.run(spark, "somewhere", f"file://{tmp_path}/in", "2026-08-01", "listing")
    assert [(r["document"], r["artist_name"], r["date"], r["time_defaulted"]) for r in found.events.collect()] == [("a", "The Foos", "2026-08-21", True)]
    assert [tuple(r) for r in found.parked.collect()] == [("a", "jam_night", "Blues Jam at The Mill")] and found.warnings.first()["n"] == 1
    put(tmp_path / "s", a__csv="date,artist,venue,time,genre,url\n21/8/2026,Ann,\"The Rose, Hanley\",8pm,Rock,\n1/1/2020,Bob,V,,,")
    events = adapters.run(spark, "sheet", f"file://{tmp_path}/s", "2026-08-01").events.collect()
    assert [(r["document"], r["artist_name"], r["venue_location"], r["start_time"]) for r in events] == [("a", "Ann", "Stoke-on-Trent", "20:00")] and tuple(events[0].asDict()) == adapters.EVENT
    with pytest.raises(LookupError):
        adapters.adapter_of("nobody")
    with pytest.raises(ValueError):
        adapters.register("sheet", adapters.sheet())
    with pytest.raises(ValueError):
        put(tmp_path / "n", a__txt="nothing here")
        adapters.run(spark, "listing", f"file://{tmp_path}/n", "2026-08-01")
