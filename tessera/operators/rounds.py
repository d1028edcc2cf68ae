"""Rounds of crawling: web sites level by level, and a documentation whose pages' texts lie at places of their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, urls
from ..functions.text import blank_to_null
from ..session import kept
from . import crawl

#: What ``fetch`` gives of each address; columns that a source lacks are null.
ANSWER = {"url": "string", "status": "int", "content_type": "string", "html": "string", "etag": "string", "last_modified": "string", "final_url": "string"}
Fetch = Callable[[DataFrame], DataFrame]


def asked_once(asked: DataFrame, fetch: Fetch) -> DataFrame:
    """The answers to (url, etag, last_modified), written down before anything reads them: an address is asked once, and all
    that follows sees one answer. Adds ``state``: unchanged, failed, skipped or fetched.
    """
    got = fetch(asked)
    got = got.select(*((F.col(c) if c in got.columns else F.lit(None)).cast(t).alias(c) for c, t in ANSWER.items()))
    return kept(got.withColumn("state", crawl.fetch_status(F.col("status"), F.col("content_type"))), "answers")


def known_answers(asked: DataFrame, previous: DataFrame) -> DataFrame:
    """Addresses with the etag and time of change of the last snapshot, which make a request conditional."""
    return asked.select("url").join(previous.select("url", "etag", "last_modified"), "url", "left")


def page_links(fetched: DataFrame, base: str = "url", body: str = "body") -> DataFrame:
    """(url) of all links of pages and of their markdown, resolved and normalised, each once."""
    of_page = F.transform(urls.resolved_all(F.col(base), urls.anchors(F.col("html"))), lambda x: urls.normalize_url(x))
    return fetched.select(F.explode(of_page).alias("url")).union(fetched.select(F.explode(markdown.markdown_links(F.col(body), F.col(base))).alias("url"))).distinct()


def _texts(got: DataFrame, read: Fetch) -> DataFrame:
    """``title`` and ``body`` of answers; a page whose markdown is thin is asked of the reader, whose text, if there is any, counts."""
    title = F.coalesce(blank_to_null(markdown.page_title(F.col("html"))), F.col("url"))
    fetched = F.col("state") == "fetched"
    got = got.withColumn("title", title).withColumn("body", F.when(fetched, markdown.rendered(F.col("html"))))
    thin = got.where(fetched & markdown.is_thin(F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")))
    shown = markdown.reader_fields(F.col("page"))
    better = read(thin.select("url")).select("url", shown[0].alias("reader_title"), blank_to_null(markdown.clean_reader_page(shown[1])).alias("reader_body"))
    got = got.join(kept(better, "reader"), "url", "left")
    told = F.col("reader_body").isNotNull()
    return got.withColumn("title", F.when(told, F.coalesce("reader_title", F.lit("Untitled"))).otherwise(F.col("title"))).withColumn("body", F.when(told, F.col("reader_body")).otherwise(F.col("body")))


def web_round(
    seeds: DataFrame,
    fetch: Fetch,
    read: Fetch,
    previous: DataFrame,
    source: str,
    hosts: Sequence[str],
    prefixes: Sequence[str],
    max_depth: int = 2,
    max_pages: int = 120,
    crawled_at: str = "",
) -> tuple[DataFrame, DataFrame]:
    """One crawl of a web source: its pages (url, asked, depth, status, change, hash, path, title, markdown, etag, last_modified)
    and the next state.

    A level of the frontier is fetched as one table: ``fetch`` takes (url, etag, last_modified), the latter two of the last
    snapshot, and gives ANSWER. A page that a redirect leads to counts under its own address, once, unless that was met
    before. An answer 304 leaves a page as it was; its links aren't followed. ``read`` (url) -> (url, page) is a reader
    service for thin pages. Allowed links of fetched pages are the next level. At most ``max_pages`` pages count as fetched
    or unchanged, the first by depth and address; failed and skipped ones cost nothing of them.
    """
    allowed = lambda c: urls.is_allowed(F.col(c), hosts, prefixes)
    met = seeds.select(urls.normalize_url(F.col("url")).alias("url")).where(allowed("url")).distinct()
    frontier, pages, left = met, [], max_pages
    for depth in range(max_depth + 1):
        rest, level = frontier, []
        while left > 0:
            some = kept(rest.orderBy("url").limit(left), "frontier")
            if some.isEmpty():
                break
            got = asked_once(known_answers(some, previous), fetch).withColumnRenamed("url", "asked")
            final = urls.normalize_url(F.coalesce("final_url", "asked"))
            got = got.withColumn("to", final).join(met.select(F.col("url").alias("to"), F.lit(True).alias("seen")).distinct(), "to", "left")
            got = got.withColumn("url", F.when(F.col("seen") | (F.col("state") != "fetched"), F.col("asked")).otherwise(F.col("to"))).drop("to", "seen")
            first = got.groupBy("url").agg(F.min("asked").alias("asked"))
            got = got.join(first, ["url", "asked"]).withColumn("depth", F.lit(depth))
            level.append(kept(_texts(got, read), "level"))
            met = met.unionByName(level[-1].select("url"))
            left -= level[-1].where("state in ('fetched', 'unchanged')").count()
            rest = rest.join(some, "url", "left_anti")
        pages += level
        if left <= 0 or depth == max_depth or not level:
            break
        links = page_links(reduce(DataFrame.unionByName, level).where("state = 'fetched'"))
        frontier = kept(links.where(allowed("url")).join(met, "url", "left_anti"), "frontier")
        met = met.unionByName(frontier)
    if not pages:
        pages = [_texts(asked_once(known_answers(met.limit(0), previous), fetch).withColumn("asked", F.col("url")).withColumn("depth", F.lit(0)), read)]
    rows = reduce(DataFrame.unionByName, pages).withColumn("status", F.when(F.col("state") == "unchanged", "fetched").otherwise(F.col("state")))
    return _closed(rows, previous, source, crawled_at, urls.slug_path(F.col("url"), source))


def _closed(rows: DataFrame, previous: DataFrame, source: str, crawled_at: str, path: Column) -> tuple[DataFrame, DataFrame]:
    """Documents, changes and the next state of a round's rows (url, state, status, title, body, etag, last_modified, ...)."""
    old = previous.select("url", F.col("hash").alias("old_hash"), F.col("file").alias("old_file"), F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"))
    text = markdown.page_document(F.col("url"), F.col("title"), F.lit(source), F.lit(crawled_at), F.col("body"))
    same = F.col("state") == "unchanged"
    rows = rows.withColumn("markdown", F.when(F.col("state") == "fetched", text)).withColumn("source", F.lit(source)).join(old, "url", "left")
    rows = rows.withColumn("hash", F.when(same, F.col("old_hash")).otherwise(F.sha2("body", 256))).withColumn("path", F.when(same, F.coalesce("old_file", path)).otherwise(path))
    for c, o in (("etag", "old_etag"), ("last_modified", "old_modified")):
        rows = rows.withColumn(c, F.when(same, F.coalesce(c, o)).otherwise(F.col(c)))
    rows = crawl.changes(rows, previous).drop("html", "body", "old_hash", "old_file", "old_etag", "old_modified", "final_url", "content_type")
    rows = kept(rows, "round")
    now = rows.where("status = 'fetched'").select("url", "hash", F.col("path").alias("file"), "etag", "last_modified", F.lit(crawled_at).alias("last_crawled"), "source")
    return rows, crawl.next_state(now, previous)


def documentation_origins(seeds: DataFrame, fetch: Fetch, hosts: Sequence[str], allowed_host: str, root: str = "/docs", max_depth: int = 2, max_pages: int = 120) -> tuple[DataFrame, DataFrame]:
    """(origin, position) of a documentation's pages that links lead to, in order of depth and address, and all links met (url).

    Links that name a page are taken as they are. Odd ones (files, escaped or foreign letters) are asked for, and the page
    that their redirects end at counts; those that run in a circle lead nowhere.
    """
    found = kept(seeds.select(urls.normalize_url(F.col("url")).alias("origin")).where(urls.is_valid_origin(F.col("origin"), allowed_host, root)).distinct().withColumn("depth", F.lit(0)), "origins")
    frontier, links = found.select(F.col("origin").alias("url")), found.select(F.col("origin").alias("url"))
    none = lambda df: df.select("url", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    for depth in range(1, max_depth + 1):
        got = asked_once(none(frontier.orderBy("url").limit(max_pages)), fetch)
        new = kept(page_links(got.where("state = 'fetched'").withColumn("body", F.col("html"))).join(links, "url", "left_anti"), "links")
        links = links.unionByName(new)
        action = urls.link_action(F.col("url"), hosts, allowed_host, root)
        odd = asked_once(none(new.where(action == "resolve")), fetch)
        ends = crawl.resolved_redirects(odd.where("final_url is not null and final_url <> url").select("url", F.col("final_url").alias("target")))
        plain = new.where(action == "fetch").select(F.col("url").alias("origin"))
        told = ends.where("final is not null").select(urls.normalize_url(F.col("final")).alias("origin")).where(urls.is_valid_origin(F.col("origin"), allowed_host, root))
        level = kept(plain.unionByName(told).distinct().join(found.select("origin"), "origin", "left_anti").withColumn("depth", F.lit(depth)), "origins")
        if level.isEmpty():
            break
        found = found.unionByName(level)
        frontier = level.select(F.col("origin").alias("url"))
    first = found.orderBy("depth", "origin").limit(max_pages)
    return crawl.numbered_by(first.withColumn("__by", F.concat_ws(" ", F.lpad(F.col("depth").cast("string"), 6, "0"), "origin")), "__by", name="position").select("origin", "position"), links


def documentation_round(mapped: DataFrame, discovered: DataFrame, fetch: Fetch, base: str, previous: DataFrame, source: str = "docs", max_pages: int = 120, crawled_at: str = "") -> tuple[DataFrame, DataFrame]:
    """A documentation's round: pages named by its map of titles (origin, position), then those that links led to, each with
    the text of the first place below ``base`` that holds one; and the next state.

    Rows are (url, status, reason, docdata_url, change, hash, path, title, markdown, ...). All places of all pages are asked
    for as one table. A page without a text is told apart by the two sets: one with pages below it is skipped, so is one
    that only the map names or only links lead to; the rest failed. ``max_pages`` of the pages with a text count, in order.
    """
    origins = kept(crawl.merged_origins(mapped, discovered), "origins")
    sites = F.concat(urls.scheme(F.col("origin")), F.lit("://"), urls.host(F.col("origin")), F.lit("/"))
    places = F.transform(urls.data_candidates(F.col("origin"), base), lambda c: F.concat(sites, c))
    asked = origins.select(F.explode(places).alias("url")).distinct()
    none = [F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")]
    got = asked_once(asked.select("url", *none), fetch)
    best = crawl.first_candidate(origins, places, got.select("url", "status", F.col("html").alias("body")))
    order = origins.join(best, "origin")
    kept_rows = order.orderBy("source", "position", "origin").limit(max_pages)
    title = F.coalesce("title", F.lit("Untitled"))
    good = kept_rows.select(F.col("origin").alias("url"), F.lit("fetched").alias("state"), F.lit("fetched").alias("status"), F.lit("ok").alias("reason"), "docdata_url", title.alias("title"), "body", F.lit(None).cast("string").alias("html"), *none)
    missing = crawl.with_children(origins).join(best.select("origin"), "origin", "left_anti")
    flags = missing.join(mapped.select("origin").distinct().withColumn("mapped", F.lit(True)), "origin", "left").join(discovered.select("origin").distinct().withColumn("discovered", F.lit(True)), "origin", "left").fillna(False, ["mapped", "discovered"])
    bad = crawl.classify_missing(flags.select("origin", "has_child", "mapped", "discovered"))
    bad = bad.select(F.col("origin").alias("url"), F.col("status").alias("state"), "status", "reason", F.lit(None).cast("string").alias("docdata_url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("html"), *none)
    both = good.unionByName(bad).withColumns({"content_type": F.lit(None).cast("string"), "final_url": F.lit(None).cast("string")})
    return _closed(both, previous, source, crawled_at, urls.route_path(F.col("url")))
