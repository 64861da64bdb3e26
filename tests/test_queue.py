"""The queue's batches are dealt to tasks, and each is still one sending."""

from collections import Counter
from pathlib import Path

from claimspark.plans import stream_queries


def test_a_sending_of_several_files_is_one_batch(spark, monkeypatch):
    named, real = {}, stream_queries.shared_folder
    monkeypatch.setattr(stream_queries, "shared_folder", lambda s, name: named.setdefault(name, real(s, name)))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = Counter((r["status"], r["attempts"]) for r in stream_queries.queue_consume(spark, "/root/testdata/sf0.001").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert set(got) == {("success", 1), ("dead", 3)}
    files = len(list(Path(named["queue"].removeprefix("file://")).glob("*.parquet")))
    assert files > 4 and files % 4 == 0
