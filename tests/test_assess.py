"""Assessment operators on small tables."""

from pyspark.sql import functions as F

from claimspark.operators import assess
from claimspark.plans import catalogue


def test_capture_dedupe_by_url(spark, tmp_path):
    """Pages of one host are no duplicates; the same page with a fragment or tracking keys is, and pages without url are none."""
    urls = ["http://e.org/a", "http://e.org/b", "http://e.org/a/?utm_source=x#top", "http://e.org/a?id=1", None, None, "", " "]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["id"]: (r["identity"], r["duplicate_of"]) for r in catalogue.QUERIES["capture_dedupe_url"](spark, str(tmp_path)).collect()}
    assert got == {0: ("http://e.org/a", 2), 1: ("http://e.org/b", None), 2: ("http://e.org/a", None), 3: ("http://e.org/a?id=1", None), **{k: (None, None) for k in (4, 5, 6, 7)}}


def test_capture_dedupe_deals_no_identity_to_one_task(spark):
    captures = spark.range(100).select("id", F.lit("x").alias("url"))
    got = assess.capture_dedupe(captures, F.col("url"), F.col("id"))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["duplicate_of"] for r in got.where("id < 99").collect()} == {99} and got.where("id = 99").collect()[0]["duplicate_of"] is None
