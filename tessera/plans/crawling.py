"""Queries of pages, addresses, link graphs, crawl rounds and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, urls
from ..functions import text as tx
from ..operators import crawl, fusion
from .retrieval import read

HOST = "docs.example.com"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages")


def url_normalize(spark, sf_dir):
    u = urls.normalize_url(F.col("url"), {"m.thther.example.org": "thther.example.org"})
    return _pages(spark, sf_dir).select("page_id", u.alias("url"))


_RFC = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


def _norm(u: str, alias: bool = False) -> str:
    h = f"lower(regexp_extract({u}, {_RFC}, 4))"
    h = f"case when {h} = 'm.thther.example.org' then 'thther.example.org' else {h} end" if alias else h
    p, q = f"regexp_extract({u}, {_RFC}, 5)", f"regexp_extract({u}, {_RFC}, 6)"
    return f"(case when regexp_extract({u}, {_RFC}, 2) = '' then 'https' else lower(regexp_extract({u}, {_RFC}, 2)) end || '://' || {h} || case when {p} = '' then '/' when length({p}) > 1 and {p}[-1] = '/' then left({p}, length({p}) - 1) else {p} end || case when {q} = '?' then '' else {q} end)"


def _doc_urls(spark, sf_dir):
    """Addresses of a documentation site, good and bad, made of the documents' sources and numbers."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    tail = F.when(n % 10 == 0, "").when(n % 10 == 1, "/").when(n % 10 == 2, "/a%20b").when(n % 10 == 3, "/x.md").when(n % 10 == 4, "/_resources/x").when(n % 10 == 5, "/index").when(n % 10 == 6, "/Quick-started").when(n % 10 == 7, "/b/c").when(n % 10 == 8, "/ü").otherwise("/home")
    site = F.when(n % 7 == 0, "http://docs.example.com").when(n % 7 == 1, "https://other.example.com").otherwise("https://docs.example.com")
    return d.select("doc_id", F.concat(site, F.when(n % 9 == 0, "/docsx/").otherwise("/docs/"), "source", tail).alias("url"))


DOC_URLS = """u as (select doc_id, case doc_id % 7 when 0 then 'http://docs.example.com' when 1 then 'https://other.example.com' else 'https://docs.example.com' end || case when doc_id % 9 = 0 then '/docsx/' else '/docs/' end || source ||
case doc_id % 10 when 0 then '' when 1 then '/' when 2 then '/a%20b' when 3 then '/x.md' when 4 then '/_resources/x' when 5 then '/index' when 6 then '/Quick-started' when 7 then '/b/c' when 8 then '/ü' else '/home' end url from documents)"""


def url_valid(spark, sf_dir):
    u = _doc_urls(spark, sf_dir)
    return u.select("doc_id", urls.is_valid_origin(F.col("url"), HOST).alias("valid"), urls.is_allowed(F.col("url"), [HOST], ["/docs"]).alias("allowed"), F.coalesce(urls.link_action(F.col("url"), [HOST], HOST), F.lit("drop")).alias("action"))


def url_slug_path(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.slug_path(F.col("url"), "web").alias("path"))


def url_route_path(spark, sf_dir):
    u = _doc_urls(spark, sf_dir)
    return u.select("doc_id", urls.rest_path(F.col("url")).alias("rest"), urls.route_path(F.col("url")).alias("path"))


def url_candidates(spark, sf_dir):
    u = _doc_urls(spark, sf_dir)
    return u.select("doc_id", F.posexplode(urls.data_candidates(F.col("url"), "b/v1/dist")).alias("place", "candidate"))


def data_routes(spark, sf_dir):
    c = url_candidates(spark, sf_dir)
    return c.select("doc_id", "place", urls.route_of_data(F.concat(F.lit("https://docs.example.com/"), "candidate"), "https://docs.example.com").alias("route"))


def html_links(spark, sf_dir):
    links = _pages(spark, sf_dir).select("page_id", F.posexplode(urls.anchors(F.col("html"))).alias("place", "href"))
    return links.select("page_id", F.col("place").cast("long").alias("place"), "href")


def html_title(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", markdown.page_title(F.col("html")).alias("title"))


def html_main_text(spark, sf_dir):
    m = markdown.rendered(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", F.length(m).alias("n_chars"), F.sha2(m, 256).alias("hash"))


def title_from_url(spark, sf_dir):
    t = tx.title_from_url(F.regexp_replace("url", r"[?#].*$", ""))
    return _pages(spark, sf_dir).select("page_id", t.alias("title"), tx.normalize_title(F.when(F.col("page_id") % 2 == 0, "Untitled").otherwise(F.concat(F.lit(" T"), F.col("page_id").cast("string"))), F.col("url")).alias("normal"))


def thin_pages(spark, sf_dir):
    """Each text as a page: under a heading, below a menu for even ids; and bare, where only a heading of its own counts."""
    d = read(spark, sf_dir, "documents")
    page = F.concat(F.when(F.col("doc_id") % 2 == 0, "menu\n# ").otherwise("# "), "text")
    known = lambda c: F.when(F.col("text").isNotNull(), c)
    measured = lambda t, thin, n: (known(markdown.is_thin(t)).alias(thin), known(F.length(markdown.main_markdown(t))).cast("long").alias(n))
    return d.select("doc_id", *measured(page, "thin", "n_chars"), *measured(F.col("text"), "bare_thin", "bare_chars"))


def front_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    head = F.concat(F.lit("> Source URL: https://docs.example.com/"), "source", F.lit(" \n> Title: T"), F.col("doc_id").cast("string"), F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, "> Data Type: guide\n").otherwise(""), F.lit("\n"), "text")
    c = markdown.front_columns(head)
    return d.select("doc_id", c["source_url"].alias("source_url"), c["title"].alias("title"), c["data_type"].alias("data_type"), tx.source_docid(c["source_url"], c["docdata_url"], F.lit("f.md")).alias("docid"))


def docid_build(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("page_id", tx.source_docid(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 0, F.col("url")), F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("docid"))


def docid_eval(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", tx.content_docid(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("given-"), F.col("doc_id").cast("string"))), F.col("source"), F.col("doc_id"), F.col("text")).alias("docid"))


def docid_generate(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select("doc_id", tx.stable_docid(F.when(n % 4 == 0, F.concat(F.lit("g"), n.cast("string"))), F.when(n % 4 == 1, F.col("source")), F.when(n % 4 == 2, F.col("lang")), n).alias("docid"))


def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


def slugs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", tx.slugify(F.left("text", F.lit(60))).alias("slug"))


def snippets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(tx.snippet(F.col("text")), 256).alias("snippet_hash"), F.sha2(tx.normalize_query(F.concat("text", F.lit(" ？？"))), 256).alias("query_hash"))


def _edges(spark, sf_dir):
    """The links of all pages, resolved and normalised."""
    return crawl.link_edges(_pages(spark, sf_dir))


def link_edges(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("source", "target").agg(F.count("*").alias("n"))


def _next_links(spark, sf_dir):
    """(source, target): the path of a link and that of the link after it on some page."""
    ps = F.transform(urls.anchors(F.col("html")), lambda h: urls.path(h))
    pairs = _pages(spark, sf_dir).select(F.explode(F.arrays_zip(ps.alias("a"), F.slice(ps, 2, F.greatest(F.size(ps), F.lit(1))).alias("b"))).alias("p"))
    return pairs.select(F.col("p.a").alias("source"), F.col("p.b").alias("target")).where("target is not null").distinct()


def link_bfs(spark, sf_dir):
    edges = _next_links(spark, sf_dir)
    seeds = edges.where("source like '/t%' or source like '/d%'").select(F.col("source").alias("url")).distinct()
    return crawl.breadth_first(edges, seeds, max_depth=4)


def redirect_finals(spark, sf_dir):
    hops = _next_links(spark, sf_dir).select(F.col("source").alias("url"), "target")
    return crawl.resolved_redirects(hops)


def _snapshots(spark, sf_dir):
    p = _pages(spark, sf_dir)
    now = p.where("page_id % 10 <> 9").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("url"), F.sha2("html", 256).alias("hash"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"), "page_id")
    before = p.where("page_id % 10 <> 8").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("url"), F.when(F.col("page_id") % 4 == 0, "old").when(F.col("page_id") % 4 == 1, F.lit(None).cast("string")).otherwise(F.sha2("html", 256)).alias("hash"))
    return now, before


SNAPSHOTS = """no as (select 'p/' || page_id url, sha256(html) hash, regexp_extract(url, '^https?://([^/]+)', 1) source, page_id from pages where page_id % 10 <> 9),
be as (select 'p/' || page_id url, case page_id % 4 when 0 then 'old' when 1 then null else sha256(html) end hash, true known from pages where page_id % 10 <> 8),
ch as (select no.*, case when known is null then 'new' when no.hash is not distinct from be.hash then 'unchanged' else 'updated' end change from no left join be using (url))"""


def crawl_change_detect(spark, sf_dir):
    return crawl.changes(*_snapshots(spark, sf_dir)).select("url", "change")


def crawl_next_state(spark, sf_dir):
    now, before = _snapshots(spark, sf_dir)
    return crawl.next_state(now.select("url", "hash"), before).select("url", F.coalesce("hash", F.lit("")).alias("hash"))


def _classified(spark, sf_dir):
    p = _pages(spark, sf_dir)
    n = F.col("page_id")
    place = F.when(n % 3 == 0, F.concat(F.lit("https://docs.example.com/docs/"), (n / 3).cast("long").cast("string"))).otherwise(F.concat(F.lit("https://docs.example.com/docs/"), (n / 6).cast("long").cast("string"), F.lit("/"), n.cast("string")))
    return crawl.classify_missing(crawl.with_children(p.select("page_id", place.alias("origin"), (n % 4 != 0).alias("mapped"), (n % 5 != 0).alias("discovered"))))


def crawl_classify(spark, sf_dir):
    return _classified(spark, sf_dir).select("page_id", "origin", "has_child", "status", "reason")


def crawl_reports(spark, sf_dir):
    return _classified(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"), F.count_distinct("origin").alias("origins"))


CLASSIFIED = """pl as (select page_id, case when page_id % 3 = 0 then 'https://docs.example.com/docs/' || (page_id // 3) else 'https://docs.example.com/docs/' || (page_id // 6) || '/' || page_id end origin, page_id % 4 <> 0 mapped, page_id % 5 <> 0 discovered from pages),
hc as (select *, exists (select 1 from pl o where starts_with(o.origin, pl.origin || '/')) has_child from pl),
cl as (select *, case when has_child then 'index_node_no_docdata' when mapped and not discovered then 'title_mapping_orphan' when not mapped then 'discovered_unmapped' else 'docdata_not_found' end reason from hc),
st as (select page_id, origin, has_child, case when reason = 'docdata_not_found' then 'failed' else 'skipped' end status, reason from cl)"""


def crawl_stats(spark, sf_dir):
    rows = crawl.changes(*_snapshots(spark, sf_dir)).withColumn("status", F.when(F.col("page_id") % 6 == 0, "skipped").when(F.col("page_id") % 6 == 1, "failed").otherwise("fetched"))
    return crawl.crawl_statistics(rows)


def fetch_decision(spark, sf_dir):
    p = _pages(spark, sf_dir)
    n = F.col("page_id")
    status = F.when(n % 5 == 0, 304).when(n % 5 == 1, 404).otherwise(200)
    kind = F.when(n % 3 == 0, "text/html; charset=utf-8").when(n % 3 == 1, "image/png").otherwise(F.lit(None).cast("string"))
    return p.select("page_id", crawl.fetch_status(status, kind).alias("decision"))


def first_candidates(spark, sf_dir):
    """Which of an origin's candidates was fetched; of the fetched pages every third is missing or too short."""
    u = _doc_urls(spark, sf_dir).select(F.col("url").alias("origin")).distinct()
    made = url_candidates(spark, sf_dir).select(F.col("candidate").alias("url")).distinct()
    h = F.length("url") % 3
    fetched = made.select("url", F.when(h == 0, 404).otherwise(200).alias("status"), F.concat(F.lit("# Title "), "url", F.lit("\n"), F.when(h == 1, F.repeat(F.lit("word "), 40)).otherwise("short")).alias("body"))
    out = crawl.first_candidate(u, urls.data_candidates(F.col("origin"), "b/v1/dist"), fetched)
    return out.select("origin", "docdata_url", "title")


def merged_origins(spark, sf_dir):
    u = _doc_urls(spark, sf_dir).select(urls.normalize_url(F.col("url")).alias("origin"), F.col("doc_id").alias("position"))
    a, b = u.where("position % 2 = 0").groupBy("origin").agg(F.min("position").alias("position")), u.groupBy("origin").agg(F.min("position").alias("position"))
    return crawl.merged_origins(a, b).select("origin", F.col("source").cast("long").alias("source"), "position")


def reader_clean(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    page = F.concat(F.lit("[Home](/)\nmenu\n# Head\nCommunity\n"), "text", F.lit("\n\n\n\nend  \n用户协议 x\nafter"))
    return d.select("doc_id", F.sha2(markdown.clean_reader_page(page), 256).alias("hash"))


def keep_first_urls(spark, sf_dir):
    rows = _edges(spark, sf_dir)
    return fusion.keep_first(rows, ["target"], ["place", "source"]).select("target", "source", F.col("place").cast("long").alias("place"))


def json_objects(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Answer: "), "props", F.lit(" done"))).when(n % 4 == 2, "none").otherwise(F.col("props"))
    return e.select("event_id", F.coalesce(tx.json_object(raw), F.lit("")).alias("object"))


QUERIES = {
    f.__name__: f
    for f in (url_normalize, url_valid, url_slug_path, url_route_path, url_candidates, data_routes, html_links, html_title, html_main_text, title_from_url, thin_pages, front_lines, docid_build, docid_eval, docid_generate, content_hash, slugs, snippets, link_edges, link_bfs, redirect_finals, crawl_change_detect, crawl_next_state, crawl_classify, crawl_reports, crawl_stats, fetch_decision, first_candidates, merged_origins, reader_clean, keep_first_urls, json_objects)
}

_PATH, _HOSTS, _SCHEME = f"regexp_extract(url, {_RFC}, 5)", f"lower(regexp_extract(url, {_RFC}, 4))", f"lower(regexp_extract(url, {_RFC}, 2))"
_VALID = f"""({_SCHEME} = 'https' and {_HOSTS} = '{HOST}' and ({_PATH} = '/docs' or starts_with({_PATH}, '/docs/')) and not contains({_PATH}, '%') and not contains(lower({_PATH}), '/_resources/')
and not regexp_matches(lower({_PATH}), '\\.(png|jpg|jpeg|gif|svg|webp|bmp|ico|pdf|zip|md)$') and regexp_full_match(trim(substr({_PATH}, 6), '/'), '([A-Za-z0-9_-]+(/+[A-Za-z0-9_-]+)*)?'))"""
_REST = f"trim(case when starts_with({_PATH}, '/docs') then substr({_PATH}, 6) else {_PATH} end, '/')"
_LINKS = "ln as (select page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), 1) - 1 place from pages)"
_TARGETS = f"{_LINKS}, ed as (select {_norm('url')} source, place, {_norm('absolute')} target from (select *, regexp_extract(url, '^https?://[^/?#]+') || href absolute from ln))"
_NEXT = f"""{_LINKS}, ne as (select distinct source, target from (select regexp_extract(href, {_RFC}, 5) source, lead(regexp_extract(href, {_RFC}, 5)) over (partition by page_id order by place) target from ln) where target is not null)"""
_CANDIDATES = f"""rs as (select doc_id, {_REST} r from u), pt as (select doc_id, r, list_filter(string_split(r, '/'), lambda x: x <> '') p, array_to_string(list_filter(string_split(r, '/'), lambda x: x <> ''), '/') rel from rs),
pv as (select *, coalesce(p[-1], '') leaf, array_to_string(p[1:len(p)-1], '/') parent, case when len(p) > 1 then p[-2] else p[-1] end pl from pt),
cs as (select doc_id, case when r = '' then ['home/home_CN.md', 'overview/overview_CN.md'] when r = 'home' then ['home/home_CN.md', 'overview/overview_CN.md', 'home_CN.md'] else list_filter([
rel || '/' || leaf || '_CN.md', rel || '_CN.md', case when leaf = 'index' and len(p) > 1 then parent || '/index_CN.md' end, case when len(p) > 1 then parent || '/' || pl || '_CN.md' end,
case when lower(rel) <> rel then lower(rel) || '/' || lower(leaf) || '_CN.md' end, case when lower(rel) <> rel then lower(rel) || '_CN.md' end,
case when suffix(leaf, '-started') then case when len(p) > 1 then parent || '/' else '' end || left(leaf, length(leaf) - 2) || '/' || left(leaf, length(leaf) - 2) || '_CN.md' end,
case when suffix(leaf, '-started') then case when len(p) > 1 then parent || '/' else '' end || left(leaf, length(leaf) - 2) || '_CN.md' end], lambda x: x is not null) end c from pv),
un as (select doc_id, unnest(c) x, generate_subscripts(c, 1) i from cs), dd as (select doc_id, x, min(i) i from un group by 1, 2),
ca as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int place, 'b/v1/dist/' || x candidate from dd)"""

ORACLES = {
    "url_normalize": f"select page_id, {_norm('url', True)} url from pages",
    "url_valid": f"""with {DOC_URLS} select doc_id, {_VALID} valid, ({_SCHEME} in ('http', 'https') and {_HOSTS} = '{HOST}' and starts_with({_PATH}, '/docs')) allowed,
case when {_HOSTS} <> '{HOST}' or not starts_with({_PATH}, '/docs') then 'drop' when suffix(lower({_PATH}), '.md') or contains({_PATH}, '%') or regexp_matches({_PATH}, '[^\\x00-\\x7F]') then 'resolve' when {_VALID} then 'fetch' else 'drop' end action from u""",
    "url_slug_path": f"""with s as (select page_id, url, regexp_extract(url, {_RFC}, 4) || {_PATH} || case when regexp_extract(url, {_RFC}, 7) = '' then '' else '-' || regexp_extract(url, {_RFC}, 7) end raw from pages),
k as (select page_id, url, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '-') s from s) select page_id, 'web/' || case when s = '' then 'index' else s end || '-' || left(md5(url), 10) || '.md' path from k""",
    "url_route_path": f"""with {DOC_URLS}, r as (select doc_id, {_REST} rest from u) select doc_id, rest, case when rest = '' or string_split(rest, '/')[-1] = 'home' then 'docs/home.md' else 'docs/' || case when contains(string_split(rest, '/')[-1][2:], '.') then regexp_replace(rest, '\\.[^./]+$', '') else rest end || '.md' end path from r""",
    "url_candidates": f"with {DOC_URLS}, {_CANDIDATES} select doc_id, place, candidate from ca",
    "data_routes": f"""with {DOC_URLS}, {_CANDIDATES}, q as (select doc_id, place, string_split(substr(candidate, 11), '/') p from ca), s as (select doc_id, place, p[1:len(p)-1] pa, regexp_replace(regexp_replace(p[-1], '\\.md$', ''), '_(CN|EN)$', '') stem from q)
select doc_id, place, 'https://docs.example.com/docs/' || array_to_string(case when len(pa) > 0 and pa[-1] = stem then pa else list_append(pa, stem) end, '/') route from s""",
    "html_links": f"with {_LINKS} select page_id, place, href from ln",
    "html_title": "select page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g') title from pages",
    "title_from_url": """with t as (select page_id, regexp_replace(url, '[?#].*$', '') u, url from pages), s as (select page_id, left(trim(translate(string_split(rtrim(u, '/'), '/')[-1], '-_', '  ')), 40) title, left(trim(translate(string_split(rtrim(url, '/'), '/')[-1], '-_', '  ')), 40) whole from t)
select page_id, title, case when page_id % 2 = 0 then case when whole = '' then 'Untitled' else whole end else 'T' || page_id end normal from s""",
    "thin_pages": """with m as (select doc_id, case when doc_id % 2 = 0 then 'menu' || chr(10) else '' end || '# ' || text t, text from documents), b as (select doc_id, regexp_replace(regexp_extract(t, '(?ms)^# .*'), '^\\s+|\\s+$', '', 'g') s, regexp_replace(regexp_extract(text, '(?ms)^# .*'), '^\\s+|\\s+$', '', 'g') bare from m)
select doc_id, length(regexp_replace(s, '\\s+', '', 'g')) < 120 thin, length(s) n_chars, length(regexp_replace(bare, '\\s+', '', 'g')) < 120 bare_thin, length(bare) bare_chars from b""",
    "front_lines": "select doc_id, 'https://docs.example.com/' || source source_url, 'T' || doc_id title, case when doc_id % 3 = 0 then 'guide' else 'doc' end data_type, 'doc-' || left(sha1('https://docs.example.com/' || source), 12) docid from documents",
    "docid_build": "select page_id, 'doc-' || left(sha1(case when page_id % 2 = 0 or page_id % 3 = 0 then url else 'p' || page_id end), 12) docid from pages",
    "docid_eval": "select doc_id, case when doc_id % 5 = 0 then 'given-' || doc_id else 'doc_' || left(sha1(trim(regexp_replace(source, '\\s+', ' ', 'g')) || '|' || doc_id || '|' || trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), 16) end docid from documents",
    "docid_generate": "select doc_id, case doc_id % 4 when 0 then 'g' || doc_id else 'doc-' || left(sha1(case doc_id % 4 when 1 then source when 2 then lang else 'doc-' || doc_id end), 12) end docid from documents",
    "content_hash": "select doc_id, sha256(coalesce(text, '')) hash from documents",
    "slugs": "with s as (select doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(left(text, 60), '^\\s+|\\s+$', '', 'g')), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '-') s from documents) select doc_id, case when s = '' then 'index' else s end slug from s",
    "snippets": "select doc_id, sha256(left(regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 280)) snippet_hash, sha256(replace(trim(regexp_replace(coalesce(text || ' ？？', ''), '\\s+', ' ', 'g')), '？？', '？')) query_hash from documents",
    "link_edges": f"with {_TARGETS} select source, target, count(*) n from ed group by 1, 2",
    "link_bfs": f"""with recursive {_NEXT}, b as (select source url, 0 depth from ne where source like '/t%' or source like '/d%' union select t.target, depth + 1 from b join ne t on t.source = url where depth < 4)
select url, min(depth)::int depth from b group by url""",
    "redirect_finals": f"""with recursive {_NEXT}, ho as (select source url, min(target) target from ne group by source),
w as (select url, target from ho union select w.url, ho.target from w join ho on ho.url = w.target),
en as (select url, target from w where target not in (select url from ho))
select ho.url, en.target final, en.target is null cyclic from ho left join en on en.url = ho.url""",
    "crawl_change_detect": f"with {SNAPSHOTS} select url, change from ch",
    "crawl_next_state": f"with {SNAPSHOTS} select url, hash from no union all select url, coalesce(hash, '') from be where url not in (select url from no)",
    "crawl_classify": f"with {CLASSIFIED} select page_id, origin, has_child, status, reason from st",
    "crawl_reports": f"with {CLASSIFIED} select status, reason, count(*) n, count(distinct origin) origins from st group by 1, 2",
    "crawl_stats": f"with {SNAPSHOTS} select source, count(*) fetched, count(*) filter (change <> 'unchanged') updated, count(*) filter (page_id % 6 = 0) skipped, count(*) filter (page_id % 6 = 1) errors from ch group by 1",
    "fetch_decision": "select page_id, case when page_id % 5 = 0 then 'unchanged' when page_id % 5 = 1 then 'failed' when page_id % 3 = 1 then 'skipped' else 'fetched' end decision from pages",
    "first_candidates": f"""with {DOC_URLS}, {_CANDIDATES} select distinct url origin, candidate docdata_url, 'Title ' || candidate title from u join ca using (doc_id) where length(candidate) % 3 = 1 qualify row_number() over (partition by doc_id order by place) = 1""",
    "merged_origins": f"""with {DOC_URLS}, n as (select {_norm('url')} origin, doc_id from u) select origin, case when min(doc_id) filter (doc_id % 2 = 0) is null then 1 else 0 end source, coalesce(min(doc_id) filter (doc_id % 2 = 0), min(doc_id)) as position from n group by 1""",
    "reader_clean": """with t as (select doc_id, string_split(text || chr(10) || chr(10) || chr(10) || chr(10) || 'end', chr(10)) ls from documents),
s as (select doc_id, '# Head' || chr(10) || array_to_string(list_transform(list_filter(ls, lambda x: trim(x) not in ('Community', '分享')), lambda x: rtrim(x)), chr(10)) b from t)
select doc_id, sha256(regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')) hash from s""",
    "keep_first_urls": f"with {_TARGETS} select target, source, place from ed qualify row_number() over (partition by target order by place, source) = 1",
    "json_objects": "select event_id, case when event_id % 4 = 2 then '' else props end \"object\" from events",
}
