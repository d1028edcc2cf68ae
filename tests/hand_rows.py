"""Hand-written rows for operators, and the results to be had, written by hand too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markdown, urls
from tessera.functions import text as tx
from tessera.operators import chunking, context, crawl, evalset, fusion, metrics
from tessera.sources import files
from tessera.plans import flow

#: name -> (a function of the session that gives (place, result) rows, the results in the order of places)
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], list[str | None]]] = {}


def case(*wanted: str | None):
    def put(f):
        CASES[f.__name__.strip("_")] = (f, list(wanted))
        return f

    return put


def rows(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values, 1)], f"place int, {schema}")


def shown(df: DataFrame, result: Column) -> DataFrame:
    return df.select(F.col("place").cast("long").alias("place"), result.cast("string").alias("result"))


def listed(c: Column) -> Column:
    return F.array_join(c, "|", "null")


@case("https://d.example/a|https://d.example/docs/x.md|https://d.example/docs/c", "https://e.example/|https://f.example/y", "")
def markdown_links_rows(spark):
    d = rows(spark, "t string, b string", ("[a](/a/) [m](mailto:x) [r](x.md) [k](/docs/x.md#f) [u](../c)", "https://D.example/docs/g/p"), ("https://e.example https://f.example/y) [e](https://E.example/)", "https://d.example"), (None, None))
    return shown(d, listed(markdown.markdown_links(F.col("t"), F.col("b"))))


@case("/one|two|/q?a=1&b=2", "", "")
def anchor_rows(spark):
    d = rows(spark, "h string", "<!-- <a href='no'> --><A HREF='/one'>1</A><a class=c href=two>2</a><a href=\"/q?a=1&amp;b=2\">3</a><a name=n></a>", "", None)
    return shown(d, listed(urls.anchors(F.col("h"))))


@case("![a](https://d.example/i/x.png)", "![a](https://s.example/p/x.png)", "![a](https://z.example/x.png)", "![](x.png) [l](y)", None)
def image_link_rows(spark):
    d = rows(spark, "t string, d string, s string", ("![a](x.png)", "https://d.example/i/doc.md", "https://s.example/p/"), ("![a](x.png)", None, "https://s.example/p/q"), ("![a](https://z.example/x.png)", "https://d.example/", None), ("![](x.png) [l](y)", None, None), (None, None, None))
    return shown(d, markdown.absolute_images(F.col("t"), F.col("d"), F.col("s")))


@case("x ![alt](u)\n\n[Image idx=1]\nplaceholder: [[IMG:doc-a:1]]\ncaption: 图片内容与“alt”相关。\n y 1=u", "![](v)\n\n[Image idx=1]\nplaceholder: [[IMG:doc-b:1]]\ncaption: 文档配图，建议结合上下文理解。\n 1=v", "none ")
def image_rows(spark):
    d = rows(spark, "t string, i string", ("x ![alt](u) y", "doc-a"), ("![](v)", "doc-b"), ("none", "doc-c"))
    e = markdown.enriched_images(F.col("t"), F.col("i"))
    pairs = F.transform(F.map_entries(e["image_map"]), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return shown(d, F.concat(e["text"], F.lit(" "), F.array_join(pairs, ",")))


@case("图片内容与“chart”相关。", "文档配图，建议结合上下文理解。", "文档配图，建议结合上下文理解。")
def caption_fallback_rows(spark):
    return shown(rows(spark, "a string", "chart", "", None), tx.fallback_caption(F.col("a")))


@case("a b c", "", "x" * 120)
def caption_rows(spark):
    d = rows(spark, "p array<struct<type:string,text:string>>", ([("text", " a  b"), ("image", "no"), ("text", "c\n")],), ([],), ([("text", "x" * 200)],))
    return shown(d, tx.caption_text(F.col("p")))


@case("你好", "plain", "é", None)
def mojibake_rows(spark):
    return shown(rows(spark, "t string", "浣犲ソ", "plain", "é", None), tx.repair_mojibake(F.col("t")))


@case("true", "true", "false")
def weak_question_rows(spark):
    return shown(rows(spark, "q string", "本页主要介绍了什么", "如何快速理解它", "怎样安装"), tx.is_weak_question(F.col("q")))


@case("see ![](https://x/1) and [[IMG:b:2]]", "none", "![](u)![](u)")
def placeholder_rows(spark):
    registry = F.create_map(F.lit("[[IMG:a:1]]"), F.lit("https://x/1"), F.lit("[[IMG:c:3]]"), F.lit("u"))
    return shown(rows(spark, "t string", "see [[IMG:a:1]] and [[IMG:b:2]]", "none", "[[IMG:c:3]][[IMG:c:3]]"), context.rendered(F.col("t"), registry))


@case("1=b", "", "2=x")
def image_map_rows(spark):
    d = rows(spark, "e array<struct<idx:int,url:string>>", ([(1, "a"), (1, "b"), (None, "c"), (3, " ")],), ([],), ([(2, "x")],))
    return shown(d, F.array_join(F.transform(F.map_entries(context.image_map_of(F.col("e"))), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ","))


@case("1=a", "", "")
def image_registry_rows(spark):
    d = rows(spark, "m map<string,string>", ({"1": "a", "2": " ", "3": None},), ({},), (None,))
    return shown(d, F.array_join(F.transform(F.map_entries(context.filled_images(F.col("m"))), lambda p: F.concat(p["key"], F.lit("="), p["value"])), ","))


@case("【来源: T (https://x) | 章节: A > B】\n\n", "【来源: f.md】\n\n")
def source_header_rows(spark):
    d = rows(spark, "t string, f string, u string, h map<string,string>", ("T", "f.md", "https://x", {"h1": "A", "h2": "B"}), (None, "f.md", None, {}))
    return shown(d, chunking.source_header(F.col("t"), F.col("f"), F.col("u"), F.col("h")))


@case("a|b|c", "z", "b")
def linked_docid_rows(spark):
    d = rows(spark, "p array<string>, b array<string>", (["x", "a", "b", "c", "d"], ["a", "b", "c", "d"]), ([], ["a"]), (["b"], ["b"]))
    return shown(d, listed(evalset.linked_docids(F.col("p"), F.col("b"), F.lit("z"))))


@case("10", "10", "5", "0")
def questions_per_call_rows(spark):
    return shown(rows(spark, "k int", 1, 2, 3, 4), evalset.questions_per_call(F.col("k"), 10, 25))


@case("w", "r", None)
def rerank_source_rows(spark):
    d = rows(spark, "w array<string>, r array<string>", (["w"], ["r"]), ([], ["r"]), ([], None))
    return shown(d, F.get(fusion.first_filled("w", "r"), 0))


@case("1.0|0.5|0.5", "0.0|0.0|0.0", "1.0|1.0|1.0")
def url_metrics_rows(spark):
    d = rows(spark, "predicted_urls array<string>, expected_urls array<string>", (["", "a", "b"], ["b", "c"]), (["a"], []), (["a"], ["a"]))
    return shown(metrics.url_items(d), F.concat_ws("|", "hit", "recall", "mrr"))


@case("0.75|2|1")
def similarity_summary_rows(spark):
    d = rows(spark, "reference_answer string, similarity double", ("a", 1.0), ("b", 0.5), (None, 0.1))
    return shown(metrics.similarity_summary(d).withColumn("place", F.lit(1)), F.concat_ws("|", "text_similarity", "evaluated_count", "skipped_count"))


@case("0.5|2.0|1.0|2|1")
def url_summary_rows(spark):
    d = rows(spark, "predicted_urls array<string>, expected_urls array<string>, matched_by string", (["a"], ["a"], "url"), (["a"], ["b"], "url"), (["a"], [], "docid"))
    s = metrics.url_summary(metrics.url_items(d)).withColumn("place", F.lit(1))
    return shown(s, F.concat_ws("|", "hit", "evaluated_count", "skipped_count", "url_match_count", "docid_fallback_count"))


@case("qa_1|问|答，案|a,b", "c|q|r|")
def qa_case_rows(spark):
    csv = spark.createDataFrame([(1, "", "问，答，案", "a| b|", None, None), (2, "c", "", None, "q", "r")], "line int, case_id string, `问题，答案` string, docids string, query string, answer string")
    d = evalset.qa_cases(csv).withColumn("place", F.when(F.col("case_id") == "c", 2).otherwise(1))
    return shown(d, F.concat_ws("|", "case_id", "query", "reference_answer", F.array_join("expected_docids", ",")))


@case("feedback_1|问|答|4.0", "f2|q|a|")
def feedback_case_rows(spark):
    csv = spark.createDataFrame([(1, None, "问", "答", "4"), (2, "f2", "q", "a", None)], "line int, case_id string, `问题` string, `答疑机器人回答` string, `用户评分` string")
    d = evalset.feedback_cases(csv).withColumn("place", F.when(F.col("case_id") == "f2", 2).otherwise(1))
    return shown(d, F.concat_ws("|", "case_id", "query", "bot_answer", F.coalesce(F.col("user_rating").cast("double").cast("string"), F.lit(""))))


@case("T|u|c|0.5|web", "||plain words|0.0|web", "A||x|0.0|web")
def web_result_rows(spark):
    d = rows(spark, "raw string", '[{"title":"T","url":"u","content":"c","score":0.5},{"title":"E","content":" "}]', "plain words", '{"results":[{"title":"A","content":"x"}]}')
    return shown(files.web_results(d), F.concat_ws("|", "title", "url", "content", "score", "source_type"))


@case("README.md", "docs/a.md", "readme_cn.md")
def repository_rows(spark):
    names = ["README.md", "docs/a.md", "src/readme.md", "docs/b.txt", "readme_cn.md", "doc/late.md"]
    tree = spark.createDataFrame([("r", p, n) for n, p in enumerate(names)], "repo string, path string, position int")
    kept = crawl.repository_files(tree, 3)
    return shown(kept.withColumn("place", F.when(F.col("position") == 0, 1).when(F.col("position") == 1, 2).otherwise(3)), F.col("path"))


@case("u/", "u/a", "u/b")
def link_report_rows(spark):
    links = spark.createDataFrame([(x,) for x in ("u/b", "u/a", "u/b", "u/", None)], "link string")
    return shown(crawl.link_report(links).withColumn("place", F.col("position")), F.col("link"))


@case("chat", "chat", "docs", "docs")
def router_rows(spark):
    return shown(rows(spark, "q string", "Hello!", "x", "How do I install it?", "你好，怎么安装"), flow.datasource_route(flow.default_router(F.col("q"))))


@case("parallel:a|b", "simple:", "simple:")
def decompose_rows(spark):
    d = rows(spark, "q string", "a? b?", "a?", None).withColumn("parts", flow.default_decompose(F.col("q")))
    return shown(d, F.concat(flow.complexity_route(F.col("parts")), F.lit(":"), F.coalesce(F.array_join("parts", "|"), F.lit(""))))


@case("install it", "please", "怎么安装")
def rewrite_rows(spark):
    return shown(rows(spark, "q string", "Could you install   it", "please", "请问怎么安装"), flow.default_rewrite(F.col("q")))


@case("yes", "no", "no")
def grade_rows(spark):
    d = rows(spark, "q string, d string", ("red green blue", "a red thing"), ("red green blue cyan", "a red thing"), ("red", None))
    return shown(d, flow.default_grade(F.col("q"), F.col("d")))


@case("a|a", "a|a", "b|ok", "|failed")
def embed_salvage_rows(spark):
    def embed(texts):
        if "bad" in texts and len(texts) > 1 or texts == ["bad"]:
            raise RuntimeError("no answer")
        return [[float(len(t))] for t in texts]

    d = rows(spark, "page_content string", "a", "a", "b", "bad").coalesce(1)
    out = files.embedded(d, embed)
    known = F.when(F.col("status") == "ok", F.col("page_content")).otherwise("")
    return shown(out, F.concat_ws("|", known, F.when(F.col("place") < 3, F.col("page_content")).otherwise(F.col("status"))))


@case("1.0", "0.0", "0.5", "1.0")
def similarity_rows(spark):
    d = rows(spark, "a string, b string", ("abc", "abc"), ("abc", "xyz"), ("ab", "bc"), (None, ""))
    return shown(d, tx.text_similarity(F.col("a"), F.col("b")))


@case("> Source URL: https://x\n> Title: T\n> Data Type: doc\n> Source Group: g\n> Crawled At: now\n\n# T\n\nbody\n")
def page_document_rows(spark):
    d = rows(spark, "u string, t string, b string", ("https://x", "T", " body\n"))
    return shown(d, markdown.page_document(F.col("u"), F.col("t"), F.lit("g"), F.lit("now"), F.col("b")))


@case("T|# T\ntext", "|only text")
def reader_field_rows(spark):
    d = rows(spark, "p string", "Title: T\n\nURL Source: u\n\nMarkdown Content:\n# T\ntext", "only text")
    title, body = markdown.reader_fields(F.col("p"))
    return shown(d, F.concat_ws("|", F.coalesce(title, F.lit("")), body))


@case("https://d.example/docs/a", "https://d.example/docs/b")
def title_mapping_rows(spark):
    d = spark.createDataFrame([({"A": "https://d.example/docs/a/", "B": "https://D.example/docs/b", "C": "https://x.example/docs/c", "D": "https://d.example/docs/a"},)], "m map<string,string>")
    found = crawl.mapping_origins(d, "m", "d.example")
    return shown(found.withColumn("place", F.when(F.col("origin").endswith("a"), 1).otherwise(2)), F.col("origin"))


@case("llm_question_only:5:0:1")
def generation_counter_rows(spark):
    docs = spark.createDataFrame([(f"d{n}", f"T{n}", f"https://x/{n}", "s") for n in range(3)], "docid string, title string, url string, snippet string")
    made, counters = evalset.generated_cases(docs, 5, 42, 2, 30)
    one = made.agg(F.min("metadata.generation_mode").alias("mode"), F.count("*").alias("n")).crossJoin(counters)  # a row each
    return shown(one.withColumn("place", F.lit(1)), F.concat_ws(":", "mode", "n", "llm_success", "fallback"))


@case("b|a", "a|b|c")
def hybrid_rows(spark):
    words = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, id string, rank int")
    vectors = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "query_id int, id string, rank int")
    one = fusion.hybrid([None, words], [0.5, 0.5]).withColumn("place", F.lit(1))
    both = fusion.hybrid([vectors, words], [0.5, 0.5]).withColumn("place", F.lit(2))
    found = one.unionByName(both).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    return shown(found, listed(F.transform("r", lambda x: x["id"])))
