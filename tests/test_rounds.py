"""Crawl rounds against a site of a test server or table, and what follows them: files, index, search."""

import collections
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.__main__ import main
from tessera.functions import markdown
from tessera.operators import crawl, rounds
from tessera.sources import files, http as source

LONG = "word " * 60


@pytest.fixture()
def site():
    """A server of pages by path (status, headers, html) that counts requests and answers 304 to a known etag."""
    pages: dict = {}
    asked = collections.Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            status, headers, body = pages.get(self.path, (404, {}, ""))
            if headers.get("ETag") and self.headers.get("If-None-Match") == headers["ETag"]:
                status, body = 304, ""
            self.send_response(status)
            for k, v in {"Content-Type": "text/html", **headers}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", pages, asked
    server.shutdown()


def round_of(spark, site, previous, **kw):
    seeds = spark.createDataFrame([(f"{site}/docs/",)], "url string")
    silent = lambda urls: urls.where("false").select("url", F.lit("").alias("page"))
    rows, state = rounds.web_round(seeds, source.fetched, kw.pop("read", silent), previous, "docs", [site.split("//")[1]], ["/docs"], **kw)
    return {r["url"][len(site) :]: r for r in rows.collect()}, state


def test_each_address_is_asked_once(spark, site):
    at, pages, asked = site
    links = "".join(f"<a href='/docs/{n}'>x</a>" for n in ("a", "b", "old", "gone", "file", "a"))
    pages["/docs"] = (200, {"ETag": "e0"}, f"<title>Home</title><main><p>{LONG}</p>{links}<a href='http://other.example/docs'>o</a></main>")
    pages["/docs/a"] = (200, {"ETag": "e1", "Last-Modified": "now"}, f"<title>A</title><main>{LONG}<a href='/docs'>back</a><a href='/docs/deep'>d</a></main>")
    pages["/docs/b"] = (200, {}, f"<main>{LONG} b</main>")
    pages["/docs/old"] = (302, {"Location": "/docs/older"}, "")
    pages["/docs/older"] = (302, {"Location": "/docs/new"}, "")
    pages["/docs/new"] = (200, {"ETag": "e3"}, f"<main>{LONG} new</main>")
    pages["/docs/file"] = (200, {"Content-Type": "application/pdf"}, "x")
    pages["/docs/deep"] = (200, {}, f"<main>{LONG} deep</main><a href='/docs/deeper'>d</a>")
    got, state = round_of(spark, at, spark.createDataFrame([], schemas.CRAWL_STATE), crawled_at="1")
    assert {k: (r["depth"], r["status"]) for k, r in got.items()} == {"/docs": (0, "fetched"), "/docs/a": (1, "fetched"), "/docs/b": (1, "fetched"), "/docs/new": (1, "fetched"), "/docs/gone": (1, "failed"), "/docs/file": (1, "skipped"), "/docs/deep": (2, "fetched")}
    assert set(asked.values()) == {1} and got["/docs/new"]["asked"].endswith("/docs/old")
    kept = {r["url"][len(at) :]: r for r in state.collect()}
    assert (kept["/docs/a"]["etag"], kept["/docs/a"]["last_modified"], kept["/docs/b"]["etag"]) == ("e1", "now", None) and "/docs/gone" not in kept
    # the next round: pages with a known etag answer 304 and stay as they were, so the links behind them aren't followed
    pages["/docs"] = (200, {"ETag": "e9"}, pages["/docs"][2])
    asked.clear()
    again, after = round_of(spark, at, state, crawled_at="2")
    assert {k: r["change"] for k, r in again.items() if r["status"] == "fetched"} == {"/docs": "unchanged", "/docs/a": "unchanged", "/docs/b": "unchanged", "/docs/new": "unchanged"}
    assert again["/docs/a"]["markdown"] is None and again["/docs/a"]["hash"] == got["/docs/a"]["hash"] and set(asked.values()) == {1}
    kept = {r["url"][len(at) :]: r for r in after.collect()}
    assert (kept["/docs/a"]["etag"], kept["/docs/a"]["last_crawled"], kept["/docs/deep"]["last_crawled"]) == ("e1", "2", "1")


def test_budget_counts_pages_not_failures(spark, site):
    at, pages, asked = site
    pages["/docs"] = (200, {}, f"<main>{LONG}</main>" + "".join(f"<a href='/docs/{n}'>x</a>" for n in ("a", "b", "c", "d")))
    for n in "cd":
        pages[f"/docs/{n}"] = (200, {}, f"<main>{LONG} {n}</main>")
    got, _ = round_of(spark, at, spark.createDataFrame([], schemas.CRAWL_STATE), max_pages=2)
    assert sorted(k for k, r in got.items() if r["status"] == "fetched") == ["/docs", "/docs/c"] and "/docs/d" not in asked
    none, _ = round_of(spark, at + "/elsewhere", spark.createDataFrame([], schemas.CRAWL_STATE))
    assert none == {}


def test_thin_pages_are_read_elsewhere(spark, site):
    at, pages, _ = site
    pages["/docs"] = (200, {}, "<title>Thin</title><main>few</main>")
    read = lambda urls: urls.withColumn("page", F.lit(f"Title: Read\n\nMarkdown Content:\n# Read\n{LONG}"))
    got, _ = round_of(spark, at, spark.createDataFrame([], schemas.CRAWL_STATE), read=read)
    assert got["/docs"]["title"] == "Read" and "# Read" in got["/docs"]["markdown"]


def test_thin_without_a_heading(spark):
    df = spark.createDataFrame([(LONG * 9,), (f"menu\n# T\n{LONG}",), (f"a # b {LONG}",), (None,)], "t string")
    assert [tuple(r) for r in df.select(markdown.is_thin(F.col("t")), F.length(markdown.main_markdown(F.col("t"))) > 0).collect()] == [(True, False), (False, True), (True, False), (True, False)]


def test_crawl_build_search(spark, site, tmp_path):
    at, pages, asked = site
    pages["/docs"] = (200, {"ETag": "h1"}, f"<title>Home</title><main><p>{LONG} zebra</p></main><a href='/docs/a'>a</a>")
    pages["/docs/a"] = (200, {}, f"<title>A</title><main><p>{LONG} giraffe</p></main>")
    host = at.split("//")[1]
    (tmp_path / "sources.json").write_text(json.dumps([{"name": n, "seeds": [f"{at}/docs"], "hosts": [host], "prefixes": ["/docs"]} for n in ("docs", "other")]))
    crawl_it = ["crawl", "--config", str(tmp_path / "sources.json"), "--sources", "docs", "--output", str(tmp_path / "raw"), "--state", str(tmp_path / "state")]
    main(crawl_it)
    found = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "raw") for f in fs]
    assert len(found) == 2 and all("/raw/docs/" in f and f.endswith(".md") for f in found)
    pages["/docs/a"] = (200, {}, f"<title>A</title><main><p>{LONG} giraffe okapi</p></main>")
    pages["/docs"] = (200, {}, pages["/docs"][2])
    times = {f: os.stat(f).st_mtime_ns for f in found}
    main([*crawl_it, "--loop", "--rounds", "2", "--interval", "0"])
    changed = [f for f in found if os.stat(f).st_mtime_ns != times[f]]
    assert len(changed) == 1 and "okapi" in open(changed[0]).read()
    main(["build", "--raw", str(tmp_path / "raw"), "--index", str(tmp_path / "index")])
    from tessera.__main__ import search

    asked_for = spark.createDataFrame([(1, "okapi"), (2, "zebra")], "q int, query string")
    hits = {r["query_id"]: r["source_url"] for r in search(spark, str(tmp_path / "index"), asked_for, "q", 1).collect()}
    assert hits == {1: f"{at}/docs/a", 2: f"{at}/docs"}
    assert spark.read.json(str(tmp_path / "state" / "docs" / "links" / "links")).count() == 2


def test_redirects(spark):
    hops = [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self"), ("two", "b"), ("two", "a"), (None, "q")]
    got = {r["url"]: (r["final"], r["cyclic"]) for r in crawl.resolved_redirects(spark.createDataFrame(hops, "url string, target string")).collect()}
    assert got == {f"c{i}": ("c37", False) for i in range(37)} | {u: (None, True) for u in ("x", "y", "z", "into", "self")} | {"two": ("a", False)}
    assert crawl.resolved_redirects(spark.createDataFrame([], "url string, target string")).count() == 0


def test_documentation_round(spark, tmp_path):
    """Pages of the map and of links; texts at the first place that holds one; what is missing is told apart by the two sets."""
    host = "d.example"
    page = lambda p: f"https://{host}/docs/{p}"
    text = f"# Title of it\n{LONG}"
    html = {
        page("start"): "<a href='/docs/a/b'>b</a><a href='/docs/old.md'>o</a><a href='/docs/only-linked'>l</a><a href='https://no.example/docs/x'>x</a>",
        page("a/b"): "<a href='/docs/start'>s</a>",
    }
    files_at = {f"https://{host}/base/a/b/b_CN.md": text, f"https://{host}/base/a/b_CN.md": "too late " * 20, f"https://{host}/base/moved_CN.md": text, f"https://{host}/base/start_CN.md": "# short"}
    final = {page("old.md"): page("moved")}
    asked = collections.Counter()

    def fetch(urls):
        rows = urls.collect()
        asked.update(r["url"] for r in rows)
        out = [(r["url"], 200 if r["url"] in html or r["url"] in files_at or r["url"] in final else 404, "text/html", html.get(r["url"]) or files_at.get(r["url"]) or "", final.get(r["url"], r["url"])) for r in rows]
        return spark.createDataFrame(out, "url string, status int, content_type string, html string, final_url string")

    seeds = spark.createDataFrame([(page("start"),)], "url string")
    discovered, links = rounds.documentation_origins(seeds, fetch, [host], host, "/docs", 2, 50)
    assert [r["origin"] for r in discovered.orderBy("position").collect()] == [page(p) for p in ("start", "a/b", "moved", "only-linked")]
    assert {r["url"] for r in links.collect()} >= {page("old.md"), "https://no.example/docs/x"}
    mapped = spark.createDataFrame([(page(p), k) for k, p in enumerate(("a", "a/b", "start", "orphan"))], "origin string, position int")
    asked.clear()
    previous = spark.createDataFrame([], schemas.CRAWL_STATE)
    rows, state = rounds.documentation_round(mapped, discovered, fetch, "base", previous, crawled_at="1")
    got = {r["url"].split("/docs/")[1]: (r["status"], r["reason"]) for r in rows.collect()}
    assert got == {"a/b": ("fetched", "ok"), "moved": ("fetched", "ok"), "a": ("skipped", "index_node_no_docdata"), "orphan": ("skipped", "title_mapping_orphan"), "only-linked": ("skipped", "discovered_unmapped"), "start": ("failed", "docdata_not_found")}
    assert set(asked.values()) == {1}
    one = rows.where(F.col("url") == page("a/b")).first()
    assert one["path"] == "docs/a/b.md" and one["title"] == "Title of it" and one["docdata_url"].endswith("/a/b/b_CN.md") and one["change"] == "new"
    again, _ = rounds.documentation_round(mapped, discovered, fetch, "base", state, crawled_at="2")
    assert {r["change"] for r in again.where("status = 'fetched'").collect()} == {"unchanged"}
    assert files.write_pages(rows, str(tmp_path / "out")) == 2 and (tmp_path / "out" / "docs" / "a" / "b.md").exists()
