"""Crawling as table operations: discovery, first match, classification and change detection between snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import kept
from .evalset import numbered_by


def fetch_status(status: Column, content_type: Column) -> Column:
    """What an answer's status and type mean: unchanged, failed, skipped (no text) or fetched."""
    text = F.coalesce(F.lower(content_type), F.lit(""))
    return F.when(status == 304, "unchanged").when(status >= 400, "failed").when((text != "") & ~text.rlike("html|markdown|text/plain"), "skipped").otherwise("fetched")


def mapping_origins(mapping: DataFrame, titles: str, allowed_host: str) -> DataFrame:
    """(origin, position) of a map from titles to addresses: valid, normalised, each once, in order."""
    rows = mapping.select(F.posexplode(F.map_values(titles)).alias("position", "url"))
    rows = rows.select("position", urls.normalize_url(F.col("url")).alias("origin")).where(urls.is_valid_origin(F.col("origin"), allowed_host))
    return rows.groupBy("origin").agg(F.min("position").alias("position"))


def merged_origins(*sources: DataFrame) -> DataFrame:
    """(origin, source, position) of several discoveries: each origin once, the first source's."""
    rows = None
    for n, df in enumerate(sources):
        part = df.select("origin", F.lit(n).alias("source"), "position")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("origin").agg(F.min(F.struct("source", "position")).alias("m")).select("origin", "m.source", "m.position")


def first_candidate(origins: DataFrame, candidates: Column, pages: DataFrame, least: int = 80) -> DataFrame:
    """(origin, docdata_url, body, title): the first of an origin's candidates that was fetched and holds ``least``
    characters besides white space.
    """
    tried = origins.select("origin", F.posexplode(candidates).alias("place", "docdata_url"))
    good = pages.where((F.col("status") == 200) & (F.length(F.regexp_replace("body", r"\s+", "")) >= least)).select(F.col("url").alias("docdata_url"), "body")
    best = tried.join(good, "docdata_url").groupBy("origin").agg(F.min_by(F.struct("docdata_url", "body"), "place").alias("b"))
    title = F.regexp_extract("b.body", r"(?m)^# (.*)$", 1)
    return best.select("origin", "b.docdata_url", "b.body", F.when(title != "", F.trim(title)).alias("title"))


def path_prefixes(url: Column) -> Column:
    """The addresses of all pages above a page."""
    steps = F.split(urls.path(url), "/")
    site = F.concat(urls.scheme(url), F.lit("://"), urls.host(url))
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps) - 1, F.lit(2))), lambda n: F.concat(site, F.array_join(F.slice(steps, 1, n), "/")))


def with_children(origins: DataFrame, column: str = "origin") -> DataFrame:
    """Origins with ``has_child``: whether another lies below. Pages name the pages above them, so this is an equi-join, not a prefix comparison of all pairs."""
    above = origins.select(F.explode(path_prefixes(F.col(column))).alias("above"), F.col(column).alias("below")).where("above <> below").select(F.col("above").alias(column)).distinct()
    return origins.join(above.withColumn("has_child", F.lit(True)), column, "left").withColumn("has_child", F.coalesce("has_child", F.lit(False)))


def classify_missing(missing: DataFrame) -> DataFrame:
    """Status and reason of origins without a document, from has_child, mapped and discovered; the first that holds."""
    skipped = lambda reason: F.struct(F.lit("skipped").alias("status"), F.lit(reason).alias("reason"))
    outcome = F.when(F.col("has_child"), skipped("index_node_no_docdata")).when(F.col("mapped") & ~F.col("discovered"), skipped("title_mapping_orphan")).when(~F.col("mapped"), skipped("discovered_unmapped"))
    outcome = outcome.otherwise(F.struct(F.lit("failed").alias("status"), F.lit("docdata_not_found").alias("reason")))
    return missing.withColumn("o", outcome).select(*missing.columns, "o.status", "o.reason")


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``current`` (url, hash, ...) with ``change``: new, updated or unchanged against the previous snapshot, by a null-safe comparison of hashes."""
    old = previous.select("url", F.col("hash").alias("__old"), F.lit(True).alias("__known"))
    joined = current.join(old, "url", "left")
    change = F.when(F.col("__known").isNull(), "new").when(F.col("hash").eqNullSafe(F.col("__old")), "unchanged").otherwise("updated")
    return joined.withColumn("change", change).drop("__old", "__known")


def crawl_statistics(rows: DataFrame, by: str = "source") -> DataFrame:
    """Counts of fetched, updated, skipped and failed pages of each source."""
    return rows.groupBy(by).agg(F.count("*").alias("fetched"), F.count_if(F.col("change") != "unchanged").alias("updated"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("errors"))


def next_state(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The snapshot after a round: this round's pages, and those of before that it didn't meet."""
    return current.unionByName(previous.join(current.select("url"), "url", "left_anti"), allowMissingColumns=True)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of all anchors, resolved and normalised, in page order without loss of repeats."""
    links = pages.select(F.col(url).alias("page"), F.posexplode(urls.anchors(F.col(html))).alias("place", "href"))
    return links.select(urls.normalize_url(F.col("page")).alias("source"), "place", urls.normalize_url(urls.resolved(F.col("page"), F.col("href"))).alias("target"))


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None, saved=None) -> DataFrame:
    """(url, depth) of pages met from the seeds (url), level by level. A level is one join against the edges and one
    anti-join against what was met; ``saved`` may write a level down to cut its lineage. With ``max_pages`` the first by
    depth and address stay.
    """
    saved = saved or (lambda df: kept(df, "level"))
    edges = saved(edges.select("source", "target"))  # every level joins them
    met = seeds.select("url", F.lit(0).alias("depth")).distinct()
    frontier = met
    for depth in range(1, max_depth + 1):
        found = edges.join(frontier.select(F.col("url").alias("source")), "source", "left_semi").select(F.col("target").alias("url")).distinct()
        frontier = saved(found.join(met.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        met = met.unionByName(frontier)
    if max_pages is not None:
        met = met.orderBy("depth", "url").limit(max_pages)
    return met


def repository_files(tree: DataFrame, limit: int = 200) -> DataFrame:
    """Markdown files of repositories (repo, path, position, and type if there is one) under docs/ or doc/, and those at the
    root whose name starts with readme: the first ``limit`` of each in the order of the tree, ``position``.
    """
    low = F.lower("path")
    files = tree.where(F.col("type") == "blob") if "type" in tree.columns else tree
    w = Window.partitionBy("repo").orderBy("position")
    wanted = files.where(low.endswith(".md") & (low.startswith("docs/") | low.startswith("doc/") | low.startswith("readme")))
    return wanted.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def selected_sources(sources: DataFrame, names: str | None) -> DataFrame:
    """The sources (name, ...) of a list of names parted by commas; all of them for a blank list."""
    chosen = [n.strip() for n in (names or "").split(",") if n.strip()]
    return sources.where(F.col("name").isin(chosen)) if chosen else sources


def link_report(links: DataFrame, name: str = "link") -> DataFrame:
    """(name, position): each link once, sorted by code points, numbered from 1 within the whole report."""
    return numbered_by(links.select(name).where(F.col(name).isNotNull()).distinct(), name, name="position")


def resolved_redirects(hops: DataFrame) -> DataFrame:
    """(url, final, cyclic) of redirects (url, target): where a chain ends, and whether it runs in a circle, which has no end.

    A round lets each address point where its target points, so a chain of n hops takes log2 n rounds; an address that
    still points to a redirect after all rounds that a chain could need leads into a circle. Of several targets of an
    address the least counts.
    """
    now = kept(hops.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target")), "hops")
    ends, rounds = now.select(F.col("url").alias("end")), math.ceil(math.log2(max(2, now.count()))) + 1
    for _ in range(rounds):
        on = now.select(F.col("url").alias("__via"), F.col("target").alias("__next"))
        far = now.join(on, F.col("target") == F.col("__via"), "left")
        now = kept(far.select("url", F.coalesce("__next", "target").alias("target"), F.col("__next").isNotNull().alias("moved")), "hops")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    told = now.join(ends, F.col("target") == F.col("end"), "left")
    return told.select("url", F.when(F.col("end").isNull(), F.col("target")).alias("final"), F.col("end").isNotNull().alias("cyclic"))
