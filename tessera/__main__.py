"""Command line: crawl a site, build an index, generate, convert and evaluate case sets, and search.

    python -m tessera crawl --source NAME --seeds URL[,URL] --hosts HOST[,HOST] --prefixes PATH[,PATH] --output DIR --state DIR [--reader URL]
    python -m tessera crawl --config JSON [--sources NAME[,NAME]] --output DIR --state DIR [--max-depth N] [--max-pages N] [--timeout S] [--loop] [--interval S]
    python -m tessera build --raw DIR [--extra DIR] --index DIR
    python -m tessera generate --index DIR --output DIR --count N [--seed N]
    python -m tessera convert {feedback,qa} --input CSV --output DIR
    python -m tessera evaluate --index DIR --dataset JSONL --output DIR [-k 10] [--by {docid,url}]
    python -m tessera run-eval --index DIR --dataset JSONL --output DIR [-k 10] [--upload DIR]
    python -m tessera badcases --items DIR --dataset JSONL --output DIR
    python -m tessera search --index DIR --query TEXT [-k 5]

An index is a table of chunks with their vectors, and the lexical index beside its files in ``_lexical``. ``--branch``
(lexical, vector or hybrid) says what is searched; without a branch's index the other is taken. Vectors are of hashed words
unless a model embeds them, so the default is lexical.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import chunking, crawl, evalset, fusion, metrics, rounds, vector
from .plans import flow
from .session import session
from .sources import files, http, index


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame | None, index.LexicalIndex | None]:
    return files.read_index(spark, path), index.read_lexical(spark, f"{path}/_lexical")


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, k: int, branch: str = "lexical") -> DataFrame:
    """(query_id, id, score, rank, docid, page_content, source_url): the branch of the index, or both fused; the one there
    is, if the other is missing.
    """
    chunks, lexical = open_index(spark, path)
    if chunks is None:
        raise ValueError(f"no chunks in {path}")
    vectored = "embedding" in chunks.columns and not chunks.isEmpty()
    words = lexical.search(queries, query_id, "query", k) if lexical and (branch != "vector" or not vectored) else None
    vectors = None
    if vectored and (branch != "lexical" or not lexical):
        embedded = files.embedded(queries.select(F.col(query_id).cast("string").alias("chunk"), "query"), files.hashed_embedding(), "query")
        vectors = vector.vector_topk(embedded.where("status = 'ok'"), chunks, "chunk", "embedding", k)
        vectors = vectors.withColumn("query_id", F.col("query_id").cast(queries.schema[query_id].dataType))
    found = fusion.hybrid([vectors, words], [0.5, 0.5], k)
    return found.join(chunks.select(F.col("chunk").alias("id"), "docid", "page_content", "source_url"), "id")


def lists_of(found: DataFrame, column: str, name: str) -> DataFrame:
    """(case_id, name): the column's values of each question in the order of ranks."""
    rows = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", column))).alias("r"))
    return rows.select(F.col("query_id").alias("case_id"), F.transform("r", lambda x: x[column]).alias(name))


def retrieval_items(spark: SparkSession, path: str, cases: DataFrame, k: int, by: str, branch: str = "lexical") -> DataFrame:
    found = search(spark, path, cases.select("case_id", "query"), "case_id", k, branch)
    if by == "docid":
        return metrics.retrieval_items(cases.join(lists_of(found, "docid", "predicted"), "case_id", "left"), k=k)
    # by address: expected ids stand for their documents' addresses
    chunks, _ = open_index(spark, path)
    address = chunks.groupBy("docid").agg(F.min("source_url").alias("address"))
    want = cases.select("case_id", F.explode("expected_docids").alias("docid")).join(address, "docid")
    want = want.groupBy("case_id").agg(F.sort_array(F.collect_set("address")).alias("expected_urls"))
    joined = cases.join(lists_of(found, "source_url", "predicted_urls"), "case_id", "left").join(want, "case_id", "left")
    return metrics.url_items(joined, k=k)


def run_eval(spark: SparkSession, path: str, cases: DataFrame, k: int, models: flow.Models | None = None, branch: str = "lexical", judge: Callable | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of an evaluation by name (answers, retrieval, similarity, feedback where there is any, the judge's scores
    where one is given), and the merged summary.
    """

    def retrieve(q: DataFrame) -> DataFrame:
        found = search(spark, path, q, "query_id", flow.RETRIEVED, branch)
        images = F.create_map().cast("map<string,string>")
        return found.select("query_id", F.col("rank").alias("position"), "docid", "page_content", "source_url", images.alias("image_map"))

    answers = flow.answer(cases.select(F.col("case_id").alias("query_id"), "query"), models or flow.Models(retrieve))
    answers = answers.select(F.col("query_id").alias("case_id"), "answer", "path")
    both = cases.join(answers, "case_id", "left").withColumn("similarity", tx.text_similarity(F.coalesce("answer", F.lit("")), F.coalesce("reference_answer", F.lit(""))))
    tables = {"answers": answers, "similarity": both.select("case_id", "similarity", "reference_answer"), "retrieval": retrieval_items(spark, path, cases, k, "docid", branch)}
    summaries = {"text_similarity": metrics.similarity_summary(tables["similarity"]), "retrieval": metrics.retrieval_summary(tables["retrieval"])}
    feedback = cases.where("dataset_type = 'feedback'")
    if not feedback.isEmpty():
        tables["feedback"] = feedback
        summaries["feedback"] = metrics.feedback_summary(feedback)
    if judge is not None:
        tables["judge"] = metrics.judged(both, judge).select("case_id", *metrics.JUDGED, "judge_score", "reason")
        summaries["judge"] = metrics.judge_summary(tables["judge"])
    return tables, metrics.merged_summary(**summaries)


def crawl_sources(spark: SparkSession, a: argparse.Namespace) -> list[dict]:
    """The sources to crawl: one from the command line, or those of a JSON file (name, seeds, hosts, prefixes), of which ``--sources`` picks some."""
    if a.config:
        return [r.asDict() for r in crawl.selected_sources(spark.read.option("multiLine", "true").json(a.config), a.sources).collect()]
    if not (a.source and a.seeds and a.hosts and a.prefixes):
        raise SystemExit("crawl needs --config, or --source with --seeds, --hosts and --prefixes")
    parts = lambda x: [p.strip() for p in x.split(",") if p.strip()]
    return [{"name": a.source, "seeds": parts(a.seeds), "hosts": parts(a.hosts), "prefixes": parts(a.prefixes)}]


def crawl_rounds(spark: SparkSession, a: argparse.Namespace) -> None:
    """A round of every source, and with ``--loop`` another after each ``--interval`` seconds (``--rounds`` of them, if given).

    Changed pages are written as markdown files at their paths, where ``build`` reads them; all others stay.
    """
    silent = lambda urls: urls.where("false").select("url", F.lit("").alias("page"))
    read = http.reader(a.reader, a.timeout) if a.reader else silent
    fetch = lambda urls: http.fetched(urls, None, a.timeout)
    done = 0
    while True:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        for source in crawl_sources(spark, a):
            seeds = spark.createDataFrame([(u,) for u in source["seeds"]], "url string")
            state = f"{a.state}/{source['name']}"
            rows, after = rounds.web_round(seeds, fetch, read, files.load_state(spark, f"{state}/last"), source["name"], source["hosts"], source["prefixes"], a.max_depth, a.max_pages, stamp)
            files.write_pages(rows.where("status = 'fetched' and change <> 'unchanged'"), a.output)
            report = rows.select("url", "status", F.coalesce("change", F.lit("")).alias("reason"))
            files.write_reports(report, f"{a.state}/{source['name']}/report")
            files.write_link_reports(f"{a.state}/{source['name']}/links", {s: rows.where(F.col("status") == s).select("url") for s in ("fetched", "skipped", "failed")}, rows.where("status = 'fetched'").select("url", F.col("path").alias("file")))
            files.replace_state(after, state)
            crawl.crawl_statistics(rows).show()
        done += 1
        if not a.loop or done == a.rounds:
            break
        time.sleep(a.interval)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    options = {
        "crawl": ("--output", "--state", "--reader"),
        "build": ("--raw", "--extra", "--index"),
        "generate": ("--index", "--output"),
        "convert": ("--input", "--output"),
        "evaluate": ("--index", "--dataset", "--output"),
        "run-eval": ("--index", "--dataset", "--output", "--upload"),
        "badcases": ("--items", "--dataset", "--output"),
        "search": ("--index", "--query"),
    }
    for name, names in options.items():
        sub = commands.add_parser(name)
        if name == "convert":
            sub.add_argument("mode", choices=("feedback", "qa"))
        for o in names:
            sub.add_argument(o, required=o not in ("--extra", "--reader", "--upload"))
        if name == "crawl":
            for o in ("--config", "--sources", "--source", "--seeds", "--hosts", "--prefixes"):
                sub.add_argument(o)
            for o, kind, default in (("--max-depth", int, 2), ("--max-pages", int, 120), ("--timeout", float, 20), ("--interval", float, 3600), ("--rounds", int, None)):
                sub.add_argument(o, type=kind, default=default)
            sub.add_argument("--loop", action="store_true")
        if name in ("evaluate", "run-eval", "search"):
            sub.add_argument("-k", type=int, default=5 if name == "search" else 10)
            sub.add_argument("--branch", choices=("lexical", "vector", "hybrid"), default="lexical")
        if name == "evaluate":
            sub.add_argument("--by", choices=("docid", "url"), default="docid")
        if name == "generate":
            sub.add_argument("--count", type=int, required=True)
            sub.add_argument("--seed", type=int, default=42)
    a = parser.parse_args(argv)
    spark = session()
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    if a.command == "crawl":
        crawl_rounds(spark, a)
    elif a.command == "build":
        chunks = chunking.corpus_chunks(files.read_markdown(spark, files.target_directories(a.raw, a.extra)))
        chunks = chunks.withColumn("chunk", F.concat_ws("#", "docid", "chunk_index"))
        files.write_index(files.embedded(chunks, files.hashed_embedding()).where("status = 'ok'").drop("status"), a.index)
        index.write_lexical(spark.read.parquet(a.index), "chunk", "page_content", f"{a.index}/_lexical")
    elif a.command == "generate":
        chunks, _ = open_index(spark, a.index)
        docs = chunks.groupBy("docid").agg(F.min(F.struct("chunk_index", "title", "source_url", "page_content")).alias("c"))
        shown = docs.select("docid", F.coalesce("c.title", F.lit("")).alias("title"), F.coalesce("c.source_url", F.lit("")).alias("url"), tx.snippet(F.col("c.page_content")).alias("snippet"))
        cases, counters = evalset.generated_cases(shown, a.count, a.seed)
        files.write_jsonl(cases, a.output)
        counters.show()
    elif a.command == "convert":
        csv = files.read_csv(spark, a.input)
        files.write_jsonl(evalset.feedback_cases(csv) if a.mode == "feedback" else evalset.qa_cases(csv), a.output)
    elif a.command == "evaluate":
        items = retrieval_items(spark, a.index, files.read_cases(spark, a.dataset), a.k, a.by, a.branch)
        files.write_jsonl(items, f"{a.output}/items")
        files.write_jsonl(metrics.retrieval_summary(items), f"{a.output}/summary")
    elif a.command == "run-eval":
        cases = files.read_cases(spark, a.dataset)
        tables, summary = run_eval(spark, a.index, cases, a.k, None, a.branch)
        for name, rows in tables.items():
            files.write_jsonl(rows, f"{a.output}/eval_report_{stamp}/{name}")
        files.write_jsonl(summary, f"{a.output}/eval_report_{stamp}/summary")
        if a.upload:
            files.upsert_cases(cases, f"{files.dataset(spark, a.upload, 'cases')}/examples")
            files.upload_summary(summary, a.upload, "cases", f"eval_report_{stamp}")
    elif a.command == "badcases":
        files.write_jsonl(metrics.bad_cases(files.read_cases(spark, a.dataset), spark.read.json(a.items)), a.output)
    else:
        query = spark.createDataFrame([("q", a.query)], "query_id string, query string")
        search(spark, a.index, query, "query_id", a.k, a.branch).orderBy("rank").select("rank", "score", "docid", "page_content").show(a.k, 120)


if __name__ == "__main__":
    main()
