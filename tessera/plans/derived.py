"""Queries of small operators over whole tables: their inputs (links, images, CSV rows, search answers) are derived from the tables' columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, urls
from ..functions import text as tx
from ..operators import chunking, context, crawl, evalset, fusion, metrics
from ..session import shared_folder
from ..sources import files, index
from . import flow
from .crawling import _norm
from .retrieval import BM25, WORDS, bm25, bm25_sql, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def text(template: str) -> Column:
    """A template with columns in braces as a text column; null columns count as empty."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def sql_text(template: str) -> str:
    """The same in SQL."""
    parts, rest = [], template
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [quoted(before), f"coalesce({name}::varchar, '')"]
    return ("(" + " || ".join([*parts, quoted(rest)]) + ")").replace("\n", "' || chr(10) || '")


def listed(c: Column) -> Column:
    return F.array_join(c, "|", "null")


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

# --- links and pages ------------------------------------------------------------------------------------------------

LINKED = "[{source}](/docs/{source}/{doc_id}/) see [x](rel.md) [m](mailto:a@b.example) and https://H.example/{doc_id}#f) {text}"


@query(f"""with t as (select doc_id, {sql_text(LINKED)} t from documents), l as (select doc_id, regexp_extract_all(t, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1) || regexp_extract_all(t, 'https?://[^\\s)>\\]]+') l from t),
f as (select doc_id, list_distinct(list_transform(list_filter(list_transform(l, lambda x: {STRIP.format('x')}), lambda x: x <> '' and not regexp_matches(x, '^(javascript|mailto|data):') and (not suffix(x, '.md') or regexp_matches(x, '^(https?://|/)'))), lambda x: case when starts_with(x, '/') then 'https://docs.example.com' || x else x end)) u from l),
o as (select distinct doc_id, url from (select doc_id, unnest(u) x from f), lateral (select {_norm('x')} url)) select doc_id, url from o""")
def markdown_links_rows(spark, sf_dir):
    found = markdown.markdown_links(text(LINKED), F.lit("https://docs.example.com/docs/a"))
    return documents(spark, sf_dir).select("doc_id", F.explode(found).alias("url"))


@query("select page_id, coalesce(array_to_string(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1), '|'), '') hrefs from pages")
def anchor_rows(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", listed(urls.anchors(F.col("html"))).alias("hrefs"))


IMAGED = "![{lang}](img/{doc_id}.png) {text} ![b](https://z.example/{source}.png)"


@query(f"""select doc_id, sha256({sql_text(IMAGED)}.replace('](img/', case when doc_id % 3 = 0 then '](https://data.example/x/img/' when doc_id % 3 = 1 then '](https://docs.example.com/docs/img/' else '](img/' end)) hash from documents""")
def image_link_rows(spark, sf_dir):
    n = F.col("doc_id") % 3
    data, source = F.when(n == 0, "https://data.example/x/doc.md"), F.when(n < 2, "https://docs.example.com/docs/page")
    return documents(spark, sf_dir).select("doc_id", F.sha2(markdown.absolute_images(text(IMAGED), data, source), 256).alias("hash"))


ALT = "case when coalesce({0}, '') <> '' then '图片内容与“' || {0} || '”相关。' else '文档配图，建议结合上下文理解。' end"


@query(f"""select doc_id, sha256('![' || coalesce(lang, '') || '](u/' || doc_id || '.png)' || chr(10) || chr(10) || '[Image idx=1]' || chr(10) || 'placeholder: [[IMG:d' || doc_id || ':1]]' || chr(10) || 'caption: ' || {ALT.format('lang')} || chr(10) || ' ' || coalesce(text, '')) hash,
'1=u/' || doc_id || '.png' images from documents""")
def image_rows(spark, sf_dir):
    made = markdown.enriched_images(text("![{lang}](u/{doc_id}.png) {text}"), text("d{doc_id}"))
    pairs = F.transform(F.map_entries(F.col("e.image_map")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return documents(spark, sf_dir).select("doc_id", made.alias("e")).select("doc_id", F.sha2("e.text", 256).alias("hash"), F.array_join(pairs, ",").alias("images"))


@query(f"select doc_id, {ALT.format('case when doc_id % 4 > 0 then source end')} caption from documents")
def caption_fallback_rows(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.fallback_caption(F.when(F.col("doc_id") % 4 > 0, F.col("source"))).alias("caption"))


@query(f"select doc_id, left({COLLAPSE.format(sql_text('{text} {source}'))}, 120) caption from documents")
def caption_rows(spark, sf_dir):
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    parts = F.array(part("text", text("{text}")), part("image", F.col("source")), part("text", text("{source}")))
    return documents(spark, sf_dir).select("doc_id", tx.caption_text(parts).alias("caption"))


@query(f"select page_id, sha256('> Source URL: ' || url || chr(10) || '> Title: T' || page_id || chr(10) || '> Data Type: doc' || chr(10) || '> Source Group: web' || chr(10) || '> Crawled At: now' || chr(10) || chr(10) || '# T' || page_id || chr(10) || chr(10) || {STRIP.format('html')} || chr(10)) hash from pages")
def page_document_rows(spark, sf_dir):
    doc = markdown.page_document(F.col("url"), text("T{page_id}"), F.lit("web"), F.lit("now"), F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.sha2(doc, 256).alias("hash"))


@query(f"""select doc_id, case when doc_id % 2 = 0 then source end title, sha256(case when doc_id % 2 = 0 then {STRIP.format("regexp_replace(coalesce(text, ''), '^\\s+', '') || chr(10) || 'end'")} else coalesce(text, '') end) hash from documents""")
def reader_field_rows(spark, sf_dir):
    page = F.when(F.col("doc_id") % 2 == 0, text("Title: {source}\n\nURL Source: u\n\nMarkdown Content:\n{text}\nend")).otherwise(text("{text}"))
    title, body = markdown.reader_fields(page)
    return documents(spark, sf_dir).select("doc_id", title.alias("title"), F.sha2(body, 256).alias("hash"))


@query("""with m as (select 'https://docs.example.com/docs/' || source || '/p' || (doc_id % 50) origin, case when doc_id % 2 = 0 then 1 else 0 end place from documents) select origin, min(place)::int "position" from m group by origin""")
def title_mapping_rows(spark, sf_dir):
    page, other = text("https://Docs.example.com/docs/{source}/p{slot}/"), text("https://x.example/docs/{source}")
    titles = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("other"), other, F.lit("page"), page)).otherwise(F.create_map(F.lit("page"), page, F.lit("other"), other))
    return crawl.mapping_origins(documents(spark, sf_dir).withColumn("slot", F.col("doc_id") % 50).select(titles.alias("titles")), "titles", "docs.example.com")


@query("""with f as (select source, doc_id, case doc_id % 6 when 0 then 'README.md' when 1 then 'docs/' || doc_id || '.md' when 2 then 'src/readme.md' when 3 then 'Doc/' || lang || '.MD' when 4 then 'docs/x.txt' else 'readme_' || lang || '.md' end path from documents where lang is not null)
select source repo, path, doc_id "position" from f where regexp_matches(lower(path), '^(docs/|doc/|readme).*\\.md$') qualify row_number() over (partition by source order by doc_id) <= 40""")
def repository_rows(spark, sf_dir):
    n = F.col("doc_id") % 6
    path = F.when(n == 0, "README.md").when(n == 1, text("docs/{doc_id}.md")).when(n == 2, "src/readme.md").when(n == 3, text("Doc/{lang}.MD")).when(n == 4, "docs/x.txt").otherwise(text("readme_{lang}.md"))
    tree = documents(spark, sf_dir).where("lang is not null").select(F.col("source").alias("repo"), path.alias("path"), F.col("doc_id").alias("position"))
    return crawl.repository_files(tree, 40)


@query("with l as (select distinct unnest([url, 'u/' || page_id % 7]) link from pages) select link, (row_number() over (order by link))::int \"position\" from l")
def link_report_rows(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select(F.explode(F.array("url", F.concat(F.lit("u/"), (F.col("page_id") % 7).cast("string")))).alias("link"))
    return crawl.link_report(links)


# --- images and contexts --------------------------------------------------------------------------------------------


@query(f"select doc_id, sha256('![](https://x/' || doc_id || ') ' || coalesce(text, '') || ' [[IMG:none:2]]![](https://x/' || doc_id || ')') hash from documents")
def placeholder_rows(spark, sf_dir):
    mark = text("[[IMG:{source}:1]]")
    registry = F.create_map(mark, text("https://x/{doc_id}"), F.lit("[[IMG:other:1]]"), F.lit("no"))
    shown = context.rendered(F.concat(mark, text(" {text} [[IMG:none:2]]"), mark), registry)
    return documents(spark, sf_dir).select("doc_id", F.sha2(shown, 256).alias("hash"))


@query("select doc_id, case when doc_id % 3 = doc_id % 2 then (doc_id % 2) || '=l' || coalesce(lang, '') else (doc_id % 3) || '=s' || source || ',' || (doc_id % 2) || '=l' || coalesce(lang, '') end images from documents")
def image_map_rows(spark, sf_dir):
    entry = lambda idx, url: F.struct(idx.cast("int").alias("idx"), url.alias("url"))
    entries = F.array(entry(F.col("doc_id") % 3, text("s{source}")), entry(F.lit(None), F.lit("c")), entry(F.col("doc_id") % 2, text("l{lang}")), entry(F.lit(7), F.lit(" ")))
    pairs = F.transform(F.map_entries(context.image_map_of(entries)), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return documents(spark, sf_dir).select("doc_id", F.array_join(pairs, ",").alias("images"))


@query("select doc_id, case when doc_id % 3 = 0 then '' when lang is null then '1=' || source else '1=' || source || ',3=' || lang end images from documents")
def image_registry_rows(spark, sf_dir):
    given = F.create_map(F.lit("1"), F.col("source"), F.lit("2"), F.lit(" "), F.lit("3"), F.col("lang"))
    pairs = F.transform(F.map_entries(context.filled_images(F.when(F.col("doc_id") % 3 > 0, given))), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return documents(spark, sf_dir).select("doc_id", F.array_join(pairs, ",").alias("images"))


@query("select doc_id, '【来源: ' || case when doc_id % 2 = 0 then source else 'f.md' end || case when doc_id % 3 = 0 then ' (https://x/' || doc_id || ')' else '' end || case when doc_id % 5 > 0 then ' | 章节: A' || doc_id || case when lang is not null then ' > ' || lang else '' end else '' end || '】' || chr(10) || chr(10) header from documents")
def source_header_rows(spark, sf_dir):
    n = F.col("doc_id")
    headers = F.when(n % 5 > 0, F.create_map(F.lit("h2"), F.col("lang"), F.lit("h1"), text("A{doc_id}"))).otherwise(F.create_map().cast("map<string,string>"))
    return documents(spark, sf_dir).select("doc_id", chunking.source_header(F.when(n % 2 == 0, F.col("source")), F.lit("f.md"), F.when(n % 3 == 0, text("https://x/{doc_id}")), headers).alias("header"))


# --- case sets and metrics ------------------------------------------------------------------------------------------


@query("select doc_id, case when doc_id % 4 = 0 then 'z' when doc_id % 4 = 1 then source || '|b|c' else source end ids from documents")
def linked_docid_rows(spark, sf_dir):
    n = F.col("doc_id") % 4
    batch = F.when(n == 0, F.array(F.lit("none"))).when(n == 1, F.array(F.lit("d"), F.lit("c"), F.col("source"), F.lit("b"))).otherwise(F.array("source"))
    proposed = F.array(F.lit("x"), F.col("source"), F.lit("b"), F.lit("c"), F.lit("d"))
    return documents(spark, sf_dir).select("doc_id", listed(evalset.linked_docids(proposed, batch, F.lit("z"))).alias("ids"))


@query("select item_id, greatest(0, least(30, (select count(*) from documents) - item_id * 30)) questions from benchmark")
def questions_per_call_rows(spark, sf_dir):
    total = documents(spark, sf_dir).agg(F.count("*").alias("total"))
    items = read(spark, sf_dir, "benchmark").crossJoin(F.broadcast(total))  # one row
    return items.select("item_id", evalset.questions_per_call(F.col("item_id") + 1, 30, F.col("total")).cast("long").alias("questions"))


@query("select doc_id, case doc_id % 3 when 0 then 'web' when 1 then source end chosen from documents")
def rerank_source_rows(spark, sf_dir):
    n, none = F.col("doc_id") % 3, F.array().cast("array<string>")
    d = documents(spark, sf_dir).select("doc_id", F.when(n == 0, F.array(F.lit("web"))).otherwise(none).alias("w"), F.when(n < 2, F.array("source")).when(F.col("doc_id") % 2 == 0, none).alias("r"))
    return d.select("doc_id", F.get(fusion.first_filled("w", "r"), 0).alias("chosen"))


def _by_url(spark, sf_dir):
    n, s = F.col("doc_id") % 3, F.col("source")
    want = F.when(n == 0, F.array(F.lit("b"), F.lit("c"))).when(n == 1, F.array().cast("array<string>")).otherwise(F.array(s, F.lit("")))
    d = documents(spark, sf_dir).select("doc_id", F.array(F.lit(""), s, F.lit("b")).alias("predicted_urls"), want.alias("expected_urls"), F.when(F.col("doc_id") % 5 == 0, "docid").otherwise("url").alias("matched_by"))
    return metrics.url_items(d)


_URLS = "i as (select doc_id, doc_id % 3 = 1 skipped, case doc_id % 3 when 1 then 0.0::double else 1.0 end hit, case doc_id % 3 when 0 then 0.5::double when 1 then 0.0 else 1.0 end recall, case doc_id % 3 when 0 then 0.5::double when 1 then 0.0 else 1.0 end mrr, case when doc_id % 5 = 0 then 'docid' else 'url' end m from documents)"


@query(f"with {_URLS} select doc_id, skipped, hit, recall, mrr from i")
def url_metrics_rows(spark, sf_dir):
    return _by_url(spark, sf_dir).select("doc_id", "skipped", "hit", "recall", "mrr")


@query(f"""with {_URLS} select round(avg(hit) filter (not skipped), 6) hit, round(avg(recall) filter (not skipped), 6) recall, round(avg(mrr) filter (not skipped), 6) mrr, count(*) filter (not skipped)::double evaluated_count, count(*) filter (skipped)::double skipped_count,
count(*) filter (m = 'url') url_match_count, count(*) filter (m = 'docid') docid_fallback_count from i""")
def url_summary_rows(spark, sf_dir):
    return metrics.url_summary(_by_url(spark, sf_dir))


@query("select round(coalesce(avg((doc_id % 9) / 8.0::double) filter (lang = 'en'), 0), 6) text_similarity, count(*) filter (lang = 'en') evaluated_count, count(*) filter (lang is distinct from 'en') skipped_count from documents")
def similarity_summary_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.when(F.col("lang") == "en", F.col("source")).alias("reference_answer"), ((F.col("doc_id") % 9) / F.lit(8.0)).alias("similarity"))
    return metrics.similarity_summary(d)


@query(f"""select case when doc_id % 3 = 0 then 'c' || doc_id else 'qa_' || (doc_id + 1) end case_id, case when doc_id % 2 = 0 then source else 'q' || doc_id end query, sha256(case when doc_id % 2 = 0 then {STRIP.format(sql_text('a {text}'))} else coalesce(lang, '') end) answer_hash, source || ',' || coalesce(lang, 'no') docids from documents""")
def qa_case_rows(spark, sf_dir):
    n = F.col("doc_id")
    even = n % 2 == 0
    csv = documents(spark, sf_dir).select((n + 1).alias("line"), F.when(n % 3 == 0, text("c{doc_id}")).alias("case_id"), F.when(even, text("{source}，a {text}")).alias("问题，答案"), F.when(~even, text("q{doc_id}")).alias("query"), F.when(~even, F.col("lang")).alias("answer"), F.concat(F.col("source"), F.lit("| "), F.coalesce("lang", F.lit("no")), F.lit("|")).alias("docids"))
    d = evalset.qa_cases(csv)
    return d.select("case_id", "query", F.sha2("reference_answer", 256).alias("answer_hash"), F.array_join("expected_docids", ",").alias("docids"))


@query("select case when turn % 2 = 0 then 'f' || conv_id || '-' || turn else 'feedback_' || (conv_id * 1000 + turn) end case_id, coalesce(text, '') query, coalesce(role, '') bot_answer, (turn % 5)::double user_rating from conversations")
def feedback_case_rows(spark, sf_dir):
    csv = turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("line"), F.when(F.col("turn") % 2 == 0, text("f{conv_id}-{turn}")).alias("case_id"), F.col("text").alias("问题"), F.col("role").alias("答疑机器人回答"), (F.col("turn") % 5).cast("string").alias("用户评分"))
    return evalset.feedback_cases(csv).select("case_id", "query", "bot_answer", F.col("user_rating").cast("double").alias("user_rating"))


@query("select doc_id, case when doc_id % 3 = 1 then '' else source end title, case when doc_id % 3 = 0 then 'https://x/' || doc_id else '' end url, sha256('c ' || coalesce(text, '')) hash, case when doc_id % 3 = 0 then 0.5::double else 0.0 end score from documents")
def web_result_rows(spark, sf_dir):
    hit = F.to_json(F.array(F.struct(F.col("source").alias("title"), text("https://x/{doc_id}").alias("url"), text("c {text}").alias("content"), F.lit(0.5).alias("score")), F.struct(F.lit("empty").alias("title"), F.lit("u").alias("url"), F.lit(" ").alias("content"), F.lit(1.0).alias("score"))))
    boxed = F.to_json(F.struct(F.array(F.struct(F.col("source").alias("title"), text("c {text}").alias("content"))).alias("results")))
    n = F.col("doc_id") % 3
    raw = documents(spark, sf_dir).select("doc_id", F.when(n == 0, hit).when(n == 1, text("c {text}")).otherwise(boxed).alias("raw"))
    return files.web_results(raw).select("doc_id", "title", "url", F.sha2("content", 256).alias("hash"), "score")


@query("select 'llm_question_only' mode, 40::bigint n, 0::bigint llm_success, 2::bigint fallback, (select count(*) from documents) docs")
def generation_counter_rows(spark, sf_dir):
    docs = documents(spark, sf_dir).select(text("d{doc_id}").alias("docid"), F.col("source").alias("title"), text("https://x/{doc_id}").alias("url"), tx.snippet(F.col("text")).alias("snippet"))
    made, counters = evalset.generated_cases(docs, 40, 42, 5, 30)
    one = made.agg(F.min("metadata.generation_mode").alias("mode"), F.count("*").alias("n")).crossJoin(counters).crossJoin(docs.agg(F.count("*").alias("docs")))  # a row each
    return one.select("mode", "n", F.col("llm_success").cast("long").alias("llm_success"), F.col("fallback").cast("long").alias("fallback"), "docs")


# --- texts and the question flow ------------------------------------------------------------------------------------


@query("select doc_id, sha256(case when regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F]*') then '你好 ' else '浣犲ソ ' end || coalesce(text, '')) hash from documents")
def mojibake_rows(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(tx.repair_mojibake(text("浣犲ソ {text}")), 256).alias("hash"))


@query("select doc_id, doc_id % 3 < 2 weak from documents")
def weak_question_rows(spark, sf_dir):
    n = F.col("doc_id") % 3
    return documents(spark, sf_dir).select("doc_id", tx.is_weak_question(F.when(n == 0, text("本页主要介绍了什么{text}")).when(n == 1, text("{text}如何快速理解它")).otherwise(F.col("text"))).alias("weak"))


GREETED = "case when turn % 4 = 0 then 'Hello!' when turn % 4 = 1 then '你好，' || coalesce(text, '') else text end"


@query(f"""with q as (select conv_id, turn, {GREETED} q from conversations) select conv_id, turn, case when regexp_full_match(coalesce(q, ''), '(?i)\\s*(hi|hello|hey|thanks?|thank you|bye|你好|您好|谢谢|再见)[\\s!.,。！，]*') or length({STRIP.format("coalesce(q, '')")}) < 2 then 'chat' else 'docs' end route from q""")
def router_rows(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", flow.datasource_route(flow.default_router(F.expr(GREETED))).alias("route"))


@query(f"""with p as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array({sql_text('{text}? {role}; ')}, '[?？;；]'), lambda x: {STRIP.format('x')}), lambda x: x <> '') p from conversations)
select conv_id, turn, case when len(p) > 1 then 'parallel' else 'simple' end route, case when len(p) > 1 then sha256(array_to_string(p, '|')) end hash from p""")
def decompose_rows(spark, sf_dir):
    parts = flow.default_decompose(text("{text}? {role}; "))
    return turns(spark, sf_dir).select("conv_id", "turn", flow.complexity_route(parts).alias("route"), F.sha2(listed(parts), 256).alias("hash"))


_SAID = "".join(["regexp_replace("] * len(flow.STOP_PHRASES)) + sql_text("Could you {text}") + "".join(f", '(?i){p}', '', 'g')" for p in flow.STOP_PHRASES)


@query(f"with q as (select conv_id, turn, {COLLAPSE.format(_SAID)} q, {sql_text('Could you {text}')} whole from conversations) select conv_id, turn, sha256(case when q = '' then whole else q end) hash from q")
def rewrite_rows(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", F.sha2(flow.default_rewrite(text("Could you {text}")), 256).alias("hash"))


_NAME = r"\b[A-Z][A-Za-z0-9_-]*[A-Za-z0-9]"
_NOT = "('How', 'What', 'Why', 'When', 'Where', 'Who', 'Which', 'The', 'This', 'That', 'It', 'They', 'And', 'But', 'Can', 'Could', 'Do', 'Does', 'Is', 'Are', 'Hello', 'Please')"
_REFERS = r"(?i)\b(it|this|that|they|them)\b|它|这个|那个|该框架"


@query(f"""with t as (select conv_id, turn, role, {sql_text('Tell of this: {text}')} said from conversations),
n as (select *, list_filter(regexp_extract_all(said, '{_NAME}'), lambda x: x not in {_NOT})[-1] own from t),
b as (select *, last_value(own ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) name from n),
q as (select conv_id, turn, case when name is not null then regexp_replace(said, '{_REFERS}', name) else said end question from b where role = 'user')
select conv_id, turn, sha256(question) question_hash, case when regexp_full_match(question, '(?i)\\s*(hi|hello|hey|thanks?|thank you|bye|你好|您好|谢谢|再见)[\\s!.,。！，]*') then 'chat' else 'docs' end datasource from q""")
def standalone_questions(spark, sf_dir):
    said = turns(spark, sf_dir).withColumn("text", text("Tell of this: {text}"))
    return flow.standalone(said).select("conv_id", "turn", F.sha2("question", 256).alias("question_hash"), "datasource")


@query(f"""with q as (select item_id, {WORDS.format("coalesce(b.text, '')")} r, {WORDS.format("coalesce(d.text, '')")} w from benchmark b join documents d on doc_id = item_id)
select item_id, case when len(r) > 0 and len(list_intersect(w, r)) / len(r)::double >= 1 / 3::double then 'yes' else 'no' end grade from q""")
def grade_rows(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("text").alias("shown"))
    return read(spark, sf_dir, "benchmark").join(d, "item_id").select("item_id", flow.default_grade(F.col("text"), F.col("shown")).alias("grade"))


@query("select doc_id, case when length(coalesce(text, '')) % 7 = 0 then 'failed' else 'ok' end status, case when length(coalesce(text, '')) % 7 > 0 then length(coalesce(text, ''))::float end size from documents")
def embed_salvage_rows(spark, sf_dir):
    def embed(texts):
        """A model that fails a whole batch for one text of it."""
        if any(len(t) % 7 == 0 for t in texts):
            raise RuntimeError("no answer")
        return [[float(len(t))] for t in texts]

    out = files.embedded(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("page_content")), embed)
    return out.select("doc_id", "status", F.get("embedding", 0).alias("size"))


@query("select conv_id, turn, case when coalesce(text, '') = '' or turn % 2 = 0 then 1.0::double else 0.0 end similarity from conversations")
def similarity_rows(spark, sf_dir):
    other = F.when((F.col("turn") % 2 == 0) | (F.coalesce("text", F.lit("")) == ""), F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", tx.text_similarity(F.col("text"), other).alias("similarity"))


@query(f"with {bm25_sql(5)} select query_id, id, rank from bm")
def hybrid_rows(spark, sf_dir):
    """Without a vector index the words' order holds."""
    return fusion.hybrid([None, bm25(spark, sf_dir, 5)], [0.5, 0.5]).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


# --- grouped metrics and index updates ------------------------------------------------------------------------------


def _tagged(spark, sf_dir):
    d = documents(spark, sf_dir)
    n = F.col("doc_id")
    return d.select("doc_id", F.when(n % 3 == 0, "easy").when(n % 3 == 1, "medium").otherwise("hard").alias("difficulty"), F.when(n % 4 == 0, "feedback").otherwise("qa").alias("dataset_type"), F.array_distinct(F.array(F.col("source"), F.coalesce("lang", F.lit("none")), F.lit("all"))).alias("tags"), (n % 11 == 0).alias("skipped"), ((n % 2).cast("double")).alias("hit"), ((n % 5) / 4.0).alias("recall"), (1.0 / (n % 7 + 1)).alias("mrr"))


_TAGGED = """t as (select doc_id, case doc_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end difficulty, case when doc_id % 4 = 0 then 'feedback' else 'qa' end dataset_type, list_distinct([source, coalesce(lang, 'none'), 'all']) tags, doc_id % 11 = 0 skipped, (doc_id % 2)::double hit, (doc_id % 5) / 4.0::double recall, 1.0::double / (doc_id % 7 + 1) mrr from documents),
x as (select t.*, null::varchar tag from t union all select t.*, unnest(tags) from t)"""


@query(f"""with {_TAGGED} select difficulty, dataset_type, tag, round(coalesce(avg(hit) filter (not skipped), 0), 6) hit, round(coalesce(avg(recall) filter (not skipped), 0), 6) recall, round(coalesce(avg(mrr) filter (not skipped), 0), 6) mrr, count(*) filter (not skipped)::double evaluated_count, count(*) filter (skipped)::double skipped_count
from x where tag is null group by grouping sets ((difficulty), (dataset_type), (difficulty, dataset_type), ()), tag
union all select null, null, tag, round(coalesce(avg(hit) filter (not skipped), 0), 6), round(coalesce(avg(recall) filter (not skipped), 0), 6), round(coalesce(avg(mrr) filter (not skipped), 0), 6), count(*) filter (not skipped)::double, count(*) filter (skipped)::double from x where tag is not null group by tag""")
def grouped_metrics(spark, sf_dir):
    return metrics.grouped_summary(_tagged(spark, sf_dir))


_UPDATED = BM25.replace("@k", "5").replace("from documents)", "from documents where doc_id % 10 <> 9)", 1)


@query(f"with {_UPDATED} select query_id, id, score, rank from bm")
def lexical_update_topk(spark, sf_dir):
    """The kept index of all documents after a change: some texts were other ones and are put right, some are removed."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    was = docs.where("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit("old text "), F.reverse(F.coalesce("text", F.lit(""))))).otherwise(F.col("text")))
    first = index.write_lexical(was, "doc_id", "text", f"{shared_folder(spark)}/updated-{uuid.uuid4().hex}")
    now = index.updated(first, docs.where("doc_id % 10 in (3, 7)"), "doc_id", "text", docs.where("doc_id % 10 = 9").select(F.col("doc_id").alias("id")))
    return now.search(read(spark, sf_dir, "benchmark"), "item_id", "text", 5).withColumn("rank", F.col("rank").cast("long"))
