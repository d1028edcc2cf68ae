import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import chunking, context, crawl, evalset, fusion, lexical, metrics, topk, vector
from tessera.plans import config, flow


def test_header_sections():
    s = chunking.header_sections("intro\n# A\n\ntext\n```\n# code\n```\n## B\nx\n# C\ny")
    assert s == [({}, "intro"), ({"h1": "A"}, "text  \n```  \n# code  \n```"), ({"h1": "A", "h2": "B"}, "x"), ({"h1": "C"}, "y")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n`#", max_size=400), st.integers(8, 60))
def test_recursive_split_covers(text, size):
    parts = chunking.recursive_split(text, size, size // 4)
    assert all(0 < len(p) <= size for p in parts)
    assert set("".join(text.split())) <= set("".join(parts))
    at = 0
    for p in parts:  # pieces come in order
        found = text.find(p, max(0, at - size))
        assert found >= 0
        at = found


def test_corpus_chunks(spark):
    body = "> Source URL: https://a.example/p\n> Title: T\n\n# H\n" + "word " * 500 + "![i](x.png)"
    files = spark.createDataFrame([("/d/a.md", body), ("/d/blank.md", " \n")], "path string, body string")
    rows = sorted(chunking.corpus_chunks(files).collect(), key=lambda r: r["chunk_index"])
    assert len(rows) >= 3 and {r["docid"] for r in rows} == {rows[0]["docid"]} and rows[0]["docid"].startswith("doc-")
    assert all(len(r["page_content"]) <= 2000 for r in rows) and rows[-1]["page_content"].startswith("【来源: T (https://a.example/p) | 章节: H】\n\n")
    assert rows[0]["image_count"] == 1 and rows[0]["image_map"] == {"1": "https://a.example/x.png"}


def test_metrics(spark):
    cases = spark.createDataFrame([("a", ["d2", "d9"], ["d1", "d2", "d3"]), ("b", [], ["d1"]), ("c", ["d1"], None)], "case_id string, expected_docids array<string>, predicted array<string>")
    items = {r["case_id"]: r for r in metrics.retrieval_items(cases).collect()}
    assert (items["a"]["hit"], items["a"]["recall"], items["a"]["mrr"]) == (1.0, 0.5, 0.5)
    assert items["b"]["skipped"] and items["c"]["hit"] == 0
    s = metrics.retrieval_summary(metrics.retrieval_items(cases)).first()
    assert (s["hit"], s["evaluated_count"], s["skipped_count"]) == (0.5, 2.0, 1.0)
    u = spark.createDataFrame([("a", ["", "u1", "u2"], ["u2", "u2"], "url")], "case_id string, predicted_urls array<string>, expected_urls array<string>, matched_by string")
    r = metrics.url_items(u).first()
    assert (r["hit"], r["recall"], r["mrr"]) == (1.0, 0.5, 0.5)
    assert metrics.url_summary(metrics.url_items(u)).first()["url_match_count"] == 1
    f = spark.createDataFrame([(3.0,), (None,)], "user_rating double")
    assert metrics.feedback_summary(f).first()[:2] == (3.0, 0.5)
    t = spark.createDataFrame([("r", 1.0), (None, 0.2)], "reference_answer string, similarity double")
    assert metrics.similarity_summary(t).first()[:] == (1.0, 1, 1)


def test_judge_slot(spark):
    answers = spark.createDataFrame([("q1", "a1", "r"), ("q2", None, None)], "query string, answer string, reference_answer string")
    judge = lambda q, a, r: F.concat(F.lit('{"relevance": 0.8, "groundedness": "0.7", "completeness": 0.9, "reason": "'), q, a, r, F.lit('"}'))
    items = metrics.judged(answers, judge)
    assert {r["reason"] for r in items.collect()} == {"q1a1r", "q2"}
    summary = metrics.judge_summary(items).first()
    assert (summary["judge_score"], summary["relevance"], summary["cases"]) == (0.8, 0.8, 2)


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query_id int, id int, rank int")
    rows = fusion.reciprocal_rank_fusion([a, b], [0.5, 0.5]).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [10, 12, 11]
    c = spark.createDataFrame([(1, p, None if p % 2 else float(p)) for p in range(12)], "query_id int, position int, s double")
    assert [r["position"] for r in fusion.rerank(c, F.col("s"), 3).orderBy("rerank_rank").collect()] == [10, 8, 6]
    assert [r["position"] for r in fusion.rerank(c, None, 3).orderBy("rerank_rank").collect()] == [0, 1, 2]
    m = spark.createDataFrame([(1, 0, 1, " x"), (1, 1, 1, "x "), (1, 1, 2, "y")], "query_id int, sub_index int, rank int, t string")
    assert [r["t"] for r in fusion.merge_queries(m, "t").orderBy("position").collect()] == [" x", "y"]
    d = spark.createDataFrame([([], ["a"])], "w array<string>, r array<string>")
    assert d.select(fusion.first_filled("w", "r").alias("o")).first()["o"] == ["a"]


def test_vector_blocks(spark, monkeypatch):
    base = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(99, None)], "id int, v array<float>")
    whole = sorted(map(tuple, vector.vector_topk(base.where("id < 6"), base, "id", "v", 3).collect()))
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(vector, "PASS", 4)
    assert sorted(map(tuple, vector.vector_topk(base.where("id < 6"), base, "id", "v", 3).collect())) == whole
    assert vector.vector_topk(base.where("id < 0"), base, "id", "v", 3).count() == 0


def test_context(spark):
    docs = spark.createDataFrame([(1, 2, "b", "u2", "d2", {"1": "i1"}), (1, 1, "a", None, "d1", {"1": " "})], "query_id int, position int, page_content string, source_url string, docid string, image_map map<string,string>")
    r = context.context(docs).first()
    assert r["context"] == "【来源】\na\n\n【来源】u2\nb\n\n【图片占位符】\n- [[IMG:d2:1]]" and r["image_registry"] == {"[[IMG:d2:1]]": "i1"}
    t = spark.createDataFrame([("x [[IMG:d2:1]] y [[IMG:z:9]]", {"[[IMG:d2:1]]": "i1"})], "t string, m map<string,string>")
    assert t.select(context.rendered(F.col("t"), F.col("m")).alias("o")).first()["o"] == "x ![](i1) y [[IMG:z:9]]"
    e = spark.createDataFrame([([(1, "a"), (1, "b"), (None, "c"), (2, " ")],)], "e array<struct<idx:int,url:string>>")
    assert e.select(context.image_map_of(F.col("e")).alias("o")).first()["o"] == {"1": "b"}
    g = context.graded_text(spark.createDataFrame([(1, p, "x" * 2000, "u") for p in range(5)], "query_id int, position int, page_content string, source_url string")).first()["documents"]
    assert g.count("文档") == 3 and len(g) < 5000


def test_history(spark):
    rows = [(1, t, "user", "hi" if t == 0 else f"m{t}") for t in range(12)] + [(1, 12, "user", "<svg>")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {r["turn"] for r in context.history(df).collect()} == set(range(4, 12))
    assert {r["turn"] for r in context.history(df, welcome="hi").collect()} == set(range(1, 12))


def test_grade_table(spark):
    rows = [(False, 0, None, "rewrite"), (False, 1, None, "web"), (True, 0, "no", "rewrite"), (True, 0, "yes", "generate"), (True, 1, "yes", "web"), (True, 1, "no", "web"), (True, 0, None, "rewrite")]
    df = spark.createDataFrame(rows, "d boolean, l int, s string, want string")
    assert all(r["o"] == r["want"] for r in df.select("want", flow.grade_route(F.col("d"), F.col("l"), F.col("s")).alias("o")).collect())


def test_flow(spark):
    docs = spark.createDataFrame([("alpha", "alpha beta gamma"), ("delta", "delta text")], "word string, page_content string")

    def retrieve(q):
        hits = q.join(docs, F.lower("query").contains(F.col("word")))
        return hits.select("query_id", F.lit(1).alias("position"), F.col("word").alias("docid"), "page_content", F.lit("u").alias("source_url"), F.create_map().cast("map<string,string>").alias("image_map"))

    q = spark.createDataFrame([("1", "hello"), ("2", "alpha beta"), ("3", "alpha? delta?"), ("4", "nothing here")], "query_id string, query string")
    out = {r["query_id"]: r for r in flow.answer(q, flow.Models(retrieve)).collect()}
    assert {k: r["path"] for k, r in out.items()} == {"1": "chat", "2": "simple", "3": "parallel", "4": "web"}
    assert out["4"]["loop_step"] == 1 and "delta text" in out["3"]["context"] and "alpha beta gamma" in out["2"]["answer"]


def test_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "d")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted(map(tuple, crawl.breadth_first(edges, seeds, 2).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert crawl.breadth_first(edges, seeds, 5, max_pages=2).count() == 2
    files = ["README.md", "docs/a.md", "src/readme.md", "src/x.md", "docs/b.txt", "readme_cn.md", "Doc/z.md", "docs/dir.md"]
    tree = spark.createDataFrame([("r", p, n, "tree" if "dir" in p else "blob") for n, p in enumerate(files)], "repo string, path string, position int, type string")
    assert {r["path"] for r in crawl.repository_files(tree).collect()} == {"README.md", "docs/a.md", "readme_cn.md", "Doc/z.md"}
    assert {r["path"] for r in crawl.repository_files(tree, 2).collect()} == {"README.md", "docs/a.md"}
    sources = spark.createDataFrame([("docs",), ("learn",)], "name string")
    assert [r[0] for r in crawl.selected_sources(sources, " docs, x").collect()] == ["docs"] and crawl.selected_sources(sources, "").count() == 2
    report = crawl.link_report(spark.createDataFrame([(u,) for u in ("h/b", "h/a", "h/b", "h/", None, "h/ab")], "link string"))
    assert sorted((r["position"], r["link"]) for r in report.collect()) == [(1, "h/"), (2, "h/a"), (3, "h/ab"), (4, "h/b")]
    m = spark.createDataFrame([({"A": "https://d.example/docs/a/", "B": "https://d.example/docs/a", "C": "https://x.example/"},)], "m map<string,string>")
    assert [r["origin"] for r in crawl.mapping_origins(m, "m", "d.example").collect()] == ["https://d.example/docs/a"]


def test_evalset(spark):
    csv = spark.createDataFrame([(1, "", "问，答，案", "a| b|"), (2, "c", "", None)], "line int, case_id string, `问题，答案` string, docids string")
    rows = evalset.qa_cases(csv).collect()
    assert (rows[0]["case_id"], rows[0]["query"], rows[0]["reference_answer"], rows[0]["expected_docids"]) == ("qa_1", "问", "答，案", ["a", "b"])
    fb = spark.createDataFrame([(1, "q", "a", "5")], "line int, query string, bot_answer string, user_rating string")
    assert evalset.feedback_cases(fb).first()["case_id"] == "feedback_1"
    df = spark.createDataFrame([(1, ["x", "a", "b", "c", "d"], ["a", "b", "c", "d"])], "n int, p array<string>, b array<string>")
    r = df.select(evalset.linked_docids(F.col("p"), F.col("b"), F.lit("z")).alias("l"), evalset.questions_per_call(F.lit(3), 10, 25).alias("k")).first()
    assert r["l"] == ["a", "b", "c"] and r["k"] == 5


def test_config():
    assert config.model_for("judge", {"strong": "m"}, {}) == "m" and config.model_for("judge", {"strong": "m"}, {"MODEL_JUDGE": "x"}) == "x"
    with pytest.raises(ValueError):
        config.text_embedding_model("some-VL-embed")


def test_generated_cases(spark):
    docs = spark.createDataFrame([(f"d{i}", f"T{i}", f"https://x/{i}", "s") for i in range(7)], "docid string, title string, url string, snippet string")
    tries = []

    def ask(count, shown):
        tries.append(count)
        if shown[0]["docid"] in ("d0", "d1", "d2", "d3"):
            raise RuntimeError("no model")
        return [{"query": f"What of {d['title']} number {k}", "difficulty": "hard", "source_docids": ["nope"] if k else d["docid"]} for k, d in zip(range(count), shown)]

    for model in (None, ask):
        cases, counters = evalset.generated_cases(docs, 23, 42, 3, 5, model)
        rows, counts = cases.collect(), counters.first()
        numbers = sorted(int(r["case_id"].rsplit("_", 1)[1]) for r in rows)
        assert numbers == list(range(1, len(rows) + 1)) and len(rows) <= 23 and counts["llm_success"] + counts["fallback"] == 5
        assert all(1 <= len(r["expected_docids"]) <= 3 and r["query"] for r in rows) and len({r["query"] for r in rows}) == len(rows)
        assert {r["metadata"]["generation_source"] for r in rows} == ({"fallback"} if model is None else {"fallback", "llm"})
        if model is None:
            assert len(rows) == 23 and counts["fallback"] == 5
    with pytest.raises(ValueError):
        evalset.generated_cases(docs, 0)


def test_orders_without_one_task(spark):
    rows = spark.range(0, 5000, 1, 7).select("id", F.concat(F.lit("id-"), "id").alias("name"))
    order = [(r["position"], r["id"]) for r in evalset.shuffled(rows, "id", 3).collect()]
    assert sorted(p for p, _ in order) == list(range(5000))
    digest = lambda i: hashlib.sha1(f"3:{i}".encode()).hexdigest()
    assert [i for _, i in sorted(order)] == sorted(range(5000), key=digest)
    named = {r["name"]: r["n"] for r in evalset.numbered_by(rows, "name").collect()}
    assert [k for k, _ in sorted(named.items(), key=lambda x: x[1])] == sorted(f"id-{i}" for i in range(5000))
    lines = evalset.numbered(rows.withColumn("at", F.monotonically_increasing_id()), "at").collect()
    assert sorted((r["n"], r["id"]) for r in lines) == [(i + 1, i) for i in range(5000)]


def test_hybrid_with_one_branch(spark):
    one = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, id string, rank int")
    other = spark.createDataFrame([(1, "a", 1), (2, "c", 1)], "query_id int, id string, rank int")
    order = lambda df: [(r["query_id"], r["id"]) for r in df.orderBy("query_id", "rank").collect()]
    assert order(fusion.hybrid([one, None], [0.5, 0.5])) == order(fusion.hybrid([None, one], [0.5, 0.5])) == [(1, "b"), (1, "a")]
    assert order(fusion.hybrid([one, other], [0.5, 0.5])) == [(1, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        fusion.hybrid([None, None], [0.5, 0.5])


def test_gold_reads_a_text_once(spark):
    """Words are cut and digested once for each text, not again by a filter before the explosion; odd items and texts are found."""
    from tessera.plans.retrieval import gold_pairs

    long = "the quick brown fox jumps over the lazy dog"
    docs = spark.createDataFrame([(1, f"so {long} again"), (2, "brown fox"), (3, None), (4, ""), (5, "xthe quick brown foxy"), (6, " ".join(["a b"] * 20))], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "the quick brown fox"), (3, "quick brown fox"), (4, "fox"), (5, "a b a b a b a b"), (6, None), (7, ""), (8, "the quick  brown fox")], "item_id long, text string")
    want = {(i["item_id"], d["doc_id"]) for i in items.collect() for d in docs.collect() if i["text"] and d["text"] and i["text"] in d["text"]}
    found = gold_pairs(docs, items)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    seen, kind = [], type(docs)
    plan = kind.join

    def joined(self, *args, **kwargs):
        seen.append(self._jdf.queryExecution().optimizedPlan().toString())
        return plan(self, *args, **kwargs)

    kind.join = joined
    try:
        gold_pairs(docs, items)
    finally:
        kind.join = plan
    runs = [p for p in seen if "Generate explode" in p]
    assert runs and all(p.count("split(") == 1 for p in runs)
