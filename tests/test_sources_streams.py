import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import crawl
from tessera.sources import files, http, index
from tessera.streaming import streams


def test_markdown_and_index(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.md").write_text("# X\ntext")
    (tmp_path / "a" / "blank.md").write_text(" \n")
    (tmp_path / "a" / "n.txt").write_text("no")
    df = files.read_markdown(spark, files.target_directories(str(tmp_path / "a"), "  ") + [str(tmp_path / "missing")])
    assert [r["body"] for r in df.collect()] == ["# X\ntext"]
    assert files.read_index(spark, str(tmp_path / "none")) is None

    def embed(texts):
        if len(texts) > 1 or "bad" in texts[0]:
            raise RuntimeError
        return files.hashed_embedding(8)(texts)

    rows = spark.createDataFrame([("good",), ("bad",)], "page_content string").coalesce(1)
    out = files.embedded(rows, embed)
    files.write_index(out, str(tmp_path / "i"))
    got = {r["page_content"]: r["status"] for r in files.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {"good": "ok", "bad": "failed"}


def test_cases(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"case_id": "1", "query": "q", "expected_docids": ["d"]}) + "\n\n")
    assert files.read_cases(spark, str(p)).first()["difficulty"] == "easy"
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        files.read_cases(spark, str(tmp_path / "e.jsonl"))
    (tmp_path / "b.jsonl").write_text(json.dumps({"case_id": "", "query": "q"}))
    with pytest.raises(Exception, match="case_id is required"):
        files.read_cases(spark, str(tmp_path / "b.jsonl")).select("valid").collect()
    (tmp_path / "f.csv").write_text("﻿case_id,query\n,a\nx,\"b\nc\"\n", encoding="utf-8")
    assert [(r["line"], r["query"]) for r in files.read_csv(spark, str(tmp_path / "f.csv")).orderBy("line").collect()] == [(1, "a"), (2, "b\nc")]
    new = spark.createDataFrame([("1", "q"), ("2", "r")], "case_id string, query string")
    assert files.upsert_cases(new, str(tmp_path / "remote")) == 2 and files.upsert_cases(new, str(tmp_path / "remote")) == 0


def test_web_results(spark):
    raw = ['[{"title": "t", "content": "c"}, {"content": ""}]', "plain", '{"results": [{"url": "u", "content": "x", "score": 2}]}', '{"content": "one"}', "", None, "[broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "query_id int, raw string")
    rows = sorted((r["query_id"], r["content"], r["score"]) for r in files.web_results(df).collect())
    assert rows == [(0, "c", 0.0), (1, "plain", 0.0), (2, "x", 2.0), (3, "one", 0.0)]


def test_state_and_feedback(spark, tmp_path):
    assert files.load_state(spark, str(tmp_path / "s")).count() == 0
    now = spark.createDataFrame([("u", "h1")], "url string, hash string")
    at = files.save_state(now, str(tmp_path / "s"), 1)
    old = files.load_state(spark, at)
    later = spark.createDataFrame([("u", "h2"), ("v", "h")], "url string, hash string")
    assert {r["url"]: r["change"] for r in crawl.changes(later, old).collect()} == {"u": "updated", "v": "new"}
    fb = spark.createDataFrame([("1", "2026-01-02 03:04:05")], "id string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    files.save_feedback(fb, str(tmp_path / "f"))
    files.save_feedback(fb, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).count() == 2 and "date=2026-01-02" in os.listdir(tmp_path / "f")


def test_stream_equals_batch(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(src))
    batch = {tuple(r) for r in streams.daily(spark.read.parquet(str(src))).select("day", "event_type", "n").collect()}
    live = spark.readStream.schema(spark.read.parquet(str(src)).schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streams.daily(live, delay="400 days").select("day", "event_type", "n").writeStream.format("memory").queryName("daily").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("daily").collect():
        got[r["day"], r["event_type"]] = max(r["n"], got.get((r["day"], r["event_type"]), 0))
    assert {(d, e, n) for (d, e), n in got.items()} == batch


def test_ingest_and_conversations(spark, tmp_path):
    src = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "conv_id long, rewritten long").write.parquet(src)
    live = spark.readStream.schema("conv_id long, rewritten long").parquet(src)
    seen = []
    q = streams.ingest(live, lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sum(seen) == 3
    q = streams.conversation_steps(live).writeStream.format("memory").queryName("steps").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    want = {tuple(r) for r in streams.conversation_totals(spark.read.parquet(src)).collect()}
    assert {tuple(r) for r in spark.table("steps").collect()} == want


def test_command_line(spark, tmp_path):
    from tessera.__main__ import main

    raw = tmp_path / "raw"
    raw.mkdir()
    for n, t in enumerate(("alpha beta", "gamma delta", "epsilon zeta")):
        (raw / f"{n}.md").write_text(f"> Source URL: https://a.example/{n}\n\n# {t}\nsome {t} text")
    main(["build", "--raw", str(raw), "--index", str(tmp_path / "index")])
    ids = {r["source_url"]: r["docid"] for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps({"case_id": str(n), "query": q, "expected_docids": [ids[f"https://a.example/{n}"]]}) for n, q in enumerate(("alpha", "gamma", "missing"))))
    main(["evaluate", "--index", str(tmp_path / "index"), "--dataset", str(tmp_path / "cases.jsonl"), "--output", str(tmp_path / "report")])
    s = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert (s["hit"], s["evaluated_count"]) == (0.666667, 3.0)
    main(["badcases", "--items", str(tmp_path / "report" / "items"), "--dataset", str(tmp_path / "cases.jsonl"), "--output", str(tmp_path / "bad")])
    assert [r["case_id"] for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["2"]
    main(["run-eval", "--index", str(tmp_path / "index"), "--dataset", str(tmp_path / "cases.jsonl"), "--output", str(tmp_path / "evals"), "--upload", str(tmp_path / "sets")])
    report = str(tmp_path / "evals" / os.listdir(tmp_path / "evals")[0])
    assert spark.read.json(f"{report}/summary").first()["retrieval"]["hit"] == 0.666667 and spark.read.json(f"{report}/answers").count() == 3
    assert spark.read.json(str(tmp_path / "sets" / "cases" / "examples")).count() == 3
    assert spark.read.json(str(tmp_path / "sets" / "cases" / "summaries")).first()["type"] == "eval_summary"
    main(["evaluate", "--index", str(tmp_path / "index"), "--dataset", str(tmp_path / "cases.jsonl"), "--output", str(tmp_path / "by_url"), "--by", "url", "--branch", "hybrid", "-k", "1"])
    assert spark.read.json(str(tmp_path / "by_url" / "summary")).first()["evaluated_count"] == 3.0
    main(["generate", "--index", str(tmp_path / "index"), "--output", str(tmp_path / "made"), "--count", "7"])
    assert {r["case_id"] for r in spark.read.json(str(tmp_path / "made")).collect()} == {f"auto_q_{n}" for n in range(1, 8)}


def test_reports_and_data_sets(spark, tmp_path):
    links = spark.createDataFrame([("u/b",), ("u/a",), ("u/b",)], "url string")
    mapping = spark.createDataFrame([("u/b", "b.md"), ("u/a", "a.md")], "url string, file string")
    counts = files.write_link_reports(str(tmp_path / "r"), {"discovered": links, "origins": links.limit(1)}, mapping)
    assert {r["name"]: r["n"] for r in counts.collect()} == {"discovered": 2, "origins": 1, "mapped": 2}
    assert [(r["position"], r["url"]) for r in spark.read.json(str(tmp_path / "r" / "links" / "list=discovered")).orderBy("position").collect()] == [(1, "u/a"), (2, "u/b")]
    root = str(tmp_path / "sets")
    assert files.dataset(spark, root, "s", "first") == files.dataset(spark, root, "s", "second")
    assert spark.read.json(f"{root}/s/about").first()["description"] == "first"
    crawl_rows = spark.createDataFrame([("u", "fetched", "")], "url string, status string, reason string")
    assert files.write_reports(crawl_rows, str(tmp_path / "w")).first()["n"] == 1
    state = spark.createDataFrame([("u", "h")], "url string, hash string")
    for _ in range(2):  # the second is read from what it replaces
        files.replace_state(state, str(tmp_path / "state"))
        state = spark.read.parquet(str(tmp_path / "state" / "last"))
    assert state.first()["hash"] == "h"


def test_http_source(spark):
    def ask(url, headers, timeout):
        if headers.get("If-None-Match") == "e1":
            return 304, {}, b""
        return (200, {"content-type": "text/html", "etag": "e1"}, b"<p>x</p>") if "ok" in url else (599, {}, b"")

    urls = spark.createDataFrame([("http://ok",), ("http://bad",)], "url string")
    got = http.fetched(urls, None, 1, ask)
    assert {(r["url"], r["status"], r["html"]) for r in got.collect()} == {("http://ok", 200, "<p>x</p>"), ("http://bad", 599, "")}
    assert {r["url"]: r["status"] for r in http.fetched(urls, got, 1, ask).collect()} == {"http://ok": 304, "http://bad": 599}
    assert [tuple(r) for r in http.reader("http://reader/", 1, lambda u, h, t: (200, {}, u.encode()))(urls.limit(1)).collect()] == [("http://ok", "http://reader/http://ok")]


def test_embedded_texts_are_not_copied_whole(spark):
    """Other columns and texts stay in Arrow's memory, and nulls, failures and order are as before."""
    def embed(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError
        return [[float(len(t or ""))] for t in texts]

    rows = [(k, {"a": str(k)}, [None, "bad", "x" * k][k % 3]) for k in range(1_201)]
    out = files.embedded(spark.createDataFrame(rows, "k long, m map<string,string>, page_content string").coalesce(1), embed)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    want = [(k, m, t, None if t == "bad" else [float(len(t or ""))], "failed" if t == "bad" else "ok") for k, m, t in rows]
    assert [tuple(r) for r in out.collect()] == want
