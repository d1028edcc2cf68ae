"""Queries that cut texts: sections by window frames, chunks by a table function, words by a dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sections, segmentation
from .retrieval import read

BLOCK = "</?(?:p|li|ul|div|article|section|h[1-6])[^>]*>"


def page_markdown(html: Column) -> Column:
    """Headings as header lines, blocks as lines, other tags gone."""
    for k in (1, 2, 3):
        html = F.regexp_replace(html, f"<h{k}[^>]*>", "\n" + "#" * k + " ")
    return F.regexp_replace(F.regexp_replace(html, BLOCK, "\n"), "<[^>]*>", "")


def header_sections(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", page_markdown(F.col("html")).alias("text"))
    return sections.header_sections(pages, "text").select("page_id", "section", *(F.coalesce(h, F.lit("")).alias(h) for h in ("h1", "h2", "h3")), F.sha2("content", 256).alias("hash"))


def section_chunks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", page_markdown(F.col("html")).alias("text"))
    found = sections.split_sections(sections.header_sections(pages, "text").select("page_id", "section", "content"))
    return found.select("page_id", "section", "chunk_index", F.length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("hash"))


def segmented_items(spark, sf_dir):
    """The benchmark's texts without what isn't a letter or digit, segmented by the words of all documents."""
    words = segmentation.dictionary(read(spark, sf_dir, "documents"), "text")
    items = read(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.tokens(F.col("text")), "").alias("text"))
    return segmentation.segmented(items, "text", words).select("item_id", F.size("words").alias("n_words"), F.array_join("words", " ").alias("words"))


_MARKDOWN = "html"
for _k in (1, 2, 3):
    _MARKDOWN = f"regexp_replace({_MARKDOWN}, '<h{_k}[^>]*>', chr(10) || '{'#' * _k} ', 'g')"
_MARKDOWN = f"regexp_replace(regexp_replace({_MARKDOWN}, '{BLOCK}', chr(10), 'g'), '<[^>]*>', '', 'g')"
_BARE = "regexp_replace({}, '^[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"

SECTIONS_SQL = f"""with m as (select page_id, string_split({_MARKDOWN}, chr(10)) t from pages where html is not null),
l as (select page_id, unnest(t) raw, generate_subscripts(t, 1) pos from m),
k as (select page_id, pos, {_BARE.format('raw')} line from l),
g as (select *, case when starts_with(line, '# ') then 1 when starts_with(line, '## ') then 2 when starts_with(line, '### ') then 3 end level from k where line <> ''),
v as (select *, {_BARE.format('substr(line, level + 2)')} title from g),
r as (select *, {', '.join(f"max(case when level = {k} then pos end) over w a{k}, last_value(case when level = {k} then title end ignore nulls) over w t{k}" for k in (1, 2, 3))}
  from v window w as (partition by page_id order by pos rows between unbounded preceding and current row)),
c as (select page_id, pos, line, t1 h1, case when a2 > coalesce(a1, 0) then t2 end h2, case when a3 > coalesce(a1, 0) and a3 > coalesce(a2, 0) then t3 end h3 from r where level is null),
n as (select *, case when lag(pos) over o is null or h1 is distinct from lag(h1) over o or h2 is distinct from lag(h2) over o or h3 is distinct from lag(h3) over o then 1 else 0 end fresh from c window o as (partition by page_id order by pos)),
s as (select *, (sum(fresh) over (partition by page_id order by pos rows between unbounded preceding and current row) - 1)::int section from n)
select page_id, section, coalesce(h1, '') h1, coalesce(h2, '') h2, coalesce(h3, '') h3, sha256(string_agg(line, '  ' || chr(10) order by pos)) hash from s group by page_id, section, s.h1, s.h2, s.h3"""

QUERIES = {f.__name__: f for f in (header_sections, section_chunks, segmented_items)}
#: Greedy merging and the best path are not in SQL: tests hold them against plain versions.
ORACLES = {"header_sections": SECTIONS_SQL}
