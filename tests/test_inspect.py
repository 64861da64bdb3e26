"""Titles and descriptions of pages."""

from claimspark.plans import catalogue


def test_page_inspect(spark, tmp_path):
    pages = [
        ("<TITLE lang='en'> a &amp; b\n</TITLE><meta name='Description' content=' x &lt; y '>", ("a & b", "x < y")),
        ("<title>t</title><meta property=\"og:title\" content=\"o &#39;\"><meta name='description' content='d'><meta content='e' property='og:description'>", ("o '", "e")),
        ("<title>t</title><meta property='og:title' content=''>", ("t", None)),
        ("<p>", (None, None)),
        (None, (None, None)),
    ]
    rows = [(k, "http://e.org/", html) for k, (html, _) in enumerate(pages)] + [(9, "ftp://e.org/", "<title>t</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["title"], r["description"]) for r in catalogue.QUERIES["page_inspect"](spark, str(tmp_path)).collect()}
    assert got == {**{k: want for k, (_, want) in enumerate(pages)}, 9: (None, None)}
