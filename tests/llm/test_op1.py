"""Fixed texts inside and outside of articles."""

from tessera.llm import html


def test_headings_that_all_articles_have_stay(spark):
    page = "<div><p>Fixed line of the site</p></div><article><h1>Title {0}</h1><h2>Overview</h2><p>Words of {0} and more of them.</p><h2>Summary</h2><p>End of {0} here.</p></article><div><p>All rights kept</p></div>"
    pages = spark.createDataFrame([(k, f"https://site.example/{k}", page.format(f"w{k}x")) for k in range(6)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert found == {k: f"Title w{k}x Overview Words of w{k}x and more of them. Summary End of w{k}x here." for k in range(6)}


def test_fixed_blocks_outside_of_articles_go(spark):
    page = "<div><p>Fixed line of the site</p></div><div><p>Words of {0} and more of them, {0} again.</p></div><div><p>All rights kept</p></div>"
    pages = spark.createDataFrame([(k, f"https://site.example/{k}", page.format(f"w{k}x")) for k in range(6)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert found == {k: f"Words of w{k}x and more of them, w{k}x again." for k in range(6)}
