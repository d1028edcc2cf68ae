"""Evaluation sets: validation, conversion from CSV, and question generation without a model."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

DATASET_TYPES, LEVELS = ("qa", "feedback"), ("easy", "medium", "hard")


def validated(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of ``schemas.EVAL_CASE`` with ``valid`` and ``error``, the first rule broken. ``strict`` fails the job on it."""
    field = lambda c, default="": tx.stripped(F.coalesce(F.col(c).cast("string"), F.lit(default)))
    kind, level = F.lower(field("dataset_type", "qa")), F.lower(field("difficulty", "easy"))
    feedback = kind == "feedback"
    error = F.coalesce(
        F.when(field("case_id") == "", "case_id is required"),
        F.when(field("query") == "", "query is required"),
        F.when(~kind.isin(*DATASET_TYPES), "dataset_type must be qa or feedback"),
        F.when(~level.isin(*LEVELS), "difficulty must be easy, medium or hard"),
        F.when(feedback & F.col("bot_answer").isNull(), "feedback dataset requires bot_answer"),
        F.when(feedback & F.col("user_rating").isNotNull() & F.col("user_rating").cast("string").try_cast("double").isNull(), "user_rating must be numeric when provided"),
    )
    out = raw.withColumns(
        {
            "error": error,
            "case_id": field("case_id"),
            "query": field("query"),
            "dataset_type": kind,
            "difficulty": level,
            "expected_docids": F.coalesce(F.col("expected_docids"), F.array().cast("array<string>")),
            "tags": F.coalesce(F.col("tags"), F.array().cast("array<string>")),
            "user_rating": F.col("user_rating").cast("string").try_cast("double"),
        }
    ).withColumn("valid", F.col("error").isNull())
    if strict:
        return out.withColumn("valid", F.when(F.col("valid"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid case: "), "error")).cast("boolean")))
    return out


def _with_offsets(rows: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 1 by bucket, then ``order``: numbers within a bucket, plus the rows of the buckets before. Only
    the buckets' counts meet in one task, so buckets must be few.
    """
    dealt = rows.withColumn("__bucket", bucket)
    counts = dealt.groupBy("__bucket").agg(F.count("*").alias("__rows"))
    before = counts.select("__bucket", (F.sum("__rows").over(Window.orderBy("__bucket")) - F.col("__rows")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return dealt.withColumn("__n", own).join(F.broadcast(before), "__bucket").withColumn(name, (F.col("__before") + F.col("__n")).cast("int")).drop("__bucket", "__n", "__before")


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order of a column of ``monotonically_increasing_id``, whose upper bits are a partition's number."""
    return _with_offsets(rows, F.shiftright(F.col(order), 33), [order], name)


def numbered_by(rows: DataFrame, column: str, name: str = "n", width: int = 2) -> DataFrame:
    """Rows numbered from 1 in the order of a text column's code points. A bucket holds the texts that agree in
    ``width`` characters after the prefix that all of them share.
    """
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    a, b = ends["a"] or "", ends["b"] or ""
    common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return _with_offsets(rows, F.substring(column, 1, common + width), [column], name)


def _first(df: DataFrame, *names: str) -> Column:
    there = [tx.blank_to_null(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


#: Column names of the CSV files, the first that is filled counts.
FEEDBACK_NAMES = {"query": ("问题", "query"), "bot_answer": ("答疑机器人回答", "bot_answer"), "user_rating": ("用户评分", "user_rating"), "user_feedback": ("用户反馈", "user_feedback")}
QA_NAMES = {"docids": ("expected_docids", "docids"), "query": ("问题", "query", "question"), "reference_answer": ("标准答案", "reference_answer", "答案", "answer")}
MERGED_NAMES = ("问题，答案", "问题,答案", "query，reference_answer", "query,reference_answer")


def _filled_parts(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), tx.stripped), lambda x: x != "")


def feedback_cases(csv: DataFrame, line: str = "line") -> DataFrame:
    """Feedback rows of a CSV file (``line`` is the row's number) as cases."""
    text = lambda c: tx.repair_mojibake(F.coalesce(_first(csv, *FEEDBACK_NAMES[c]), F.lit("")))
    return csv.select(
        F.coalesce(_first(csv, "case_id"), F.concat(F.lit("feedback_"), F.col(line).cast("string"))).alias("case_id"),
        text("query").alias("query"),
        text("bot_answer").alias("bot_answer"),
        _first(csv, *FEEDBACK_NAMES["user_rating"]).alias("user_rating"),
        text("user_feedback").alias("user_feedback"),
        F.lit("feedback").alias("dataset_type"),
        F.coalesce(_first(csv, "difficulty"), F.lit("easy")).alias("difficulty"),
        F.array().cast("array<string>").alias("expected_docids"),
        F.array(F.lit("feedback")).alias("tags"),
    )


def qa_cases(csv: DataFrame, line: str = "line") -> DataFrame:
    """Question and answer rows of a CSV file as cases; a merged column is cut at its first full-width comma, else its first comma."""
    merged = F.coalesce(_first(csv, *MERGED_NAMES), F.lit(""))
    at = F.when(F.instr(merged, "，") > 0, F.instr(merged, "，")).otherwise(F.instr(merged, ","))
    query, answer = F.coalesce(_first(csv, *QA_NAMES["query"]), F.lit("")), F.coalesce(_first(csv, *QA_NAMES["reference_answer"]), F.lit(""))
    cut = (query == "") & (answer == "") & (at > 0)
    query = F.when(cut, tx.stripped(F.left(merged, at - 1))).otherwise(query)
    answer = F.when(cut, tx.stripped(F.substr(merged, at + 1))).otherwise(answer)
    return csv.select(
        F.coalesce(_first(csv, "case_id"), F.concat(F.lit("qa_"), F.col(line).cast("string"))).alias("case_id"),
        tx.repair_mojibake(query).alias("query"),
        tx.repair_mojibake(answer).alias("reference_answer"),
        _filled_parts(_first(csv, *QA_NAMES["docids"])).alias("expected_docids"),
        F.lit("qa").alias("dataset_type"),
        F.coalesce(_first(csv, "difficulty"), F.lit("easy")).alias("difficulty"),
        _filled_parts(F.coalesce(_first(csv, "tags"), F.lit("qa"))).alias("tags"),
    )


#: Questions asked where no model is at hand, two of each difficulty; the answer-bearing ones; and what parts repeated ones.
TEMPLATES = {
    "easy": ("在 {title} 场景下，完成基础配置需要哪些前置条件？", "如果第一次使用 {title}，最小可运行流程应该怎么走？"),
    "medium": ("基于 {title} 实施时，常见报错的定位与修复步骤是什么？", "把 {title} 接入现有系统时，接口和数据流应如何设计？"),
    "hard": ("在高并发与高准确率并存的条件下，{title} 的优化策略应如何取舍？", "围绕 {title} 做生产级架构时，稳定性与成本该如何平衡？"),
}
ANSWERED = {"easy": ("{title}主要能做什么？", 120), "medium": ("如果我是新手，使用{title}的大致步骤是什么？", 140), "hard": ("想把{title}用于真实业务场景时，需要重点关注哪些限制或关键步骤？", 160)}
ANSWERS = {"easy": "可参考文档《{title}》中的功能说明。", "medium": "可按《{title}》文档给出的流程逐步操作。", "hard": "可参考《{title}》中的限制条件与关键步骤说明。"}
SUFFIXES = {
    "easy": ("请给出一步步操作清单（场景{n}）？", "按新手视角说明关键步骤（样本{n}）？"),
    "medium": ("请补充失败重试与回滚策略（场景{n}）？", "若与现有模块集成，边界条件如何定义（样本{n}）？"),
    "hard": ("请给出性能、成本、可维护性的权衡方案（场景{n}）？", "如果跨团队落地，治理与监控方案如何设计（样本{n}）？"),
}


def _by_level(level: Column, values: dict, make) -> Column:
    out = make(values["easy"])  # also of an unknown level
    for name in ("hard", "medium"):
        out = F.when(level == name, make(values[name])).otherwise(out)
    return out


def fill(template: str, mark: str, value: Column) -> Column:
    before, after = template.split(mark)
    return F.concat(F.lit(before), value, F.lit(after))


def template_question(title: Column, level: Column, choice: Column) -> Column:
    """A question on a title; ``choice``, a number from a hash, takes the place of a random pick."""
    return _by_level(level, TEMPLATES, lambda t: F.when(F.pmod(choice, F.lit(2)) == 0, fill(t[0], "{title}", title)).otherwise(fill(t[1], "{title}", title)))


def template_question_answer(title: Column, snippet: Column, level: Column) -> tuple[Column, Column]:
    question = _by_level(level, ANSWERED, lambda t: fill(t[0], "{title}", title))
    answer = _by_level(level, ANSWERED, lambda t: F.left(snippet, F.lit(t[1])))
    return question, F.when(F.coalesce(snippet, F.lit("")) == "", _by_level(level, ANSWERS, lambda t: fill(t, "{title}", title))).otherwise(answer)


def diversified(rows: DataFrame, query: str, title: str, level: str, position: str) -> DataFrame:
    """Questions whose key was met before, in the order of ``position``, get an ending by difficulty and place."""
    again = F.row_number().over(Window.partitionBy(tx.query_key(F.col(query))).orderBy(position)) > 1
    n = F.col(position).cast("string")
    ending = _by_level(F.col(level), SUFFIXES, lambda t: F.when(F.pmod(F.col(position), F.lit(2)) == 0, fill(t[0], "{n}", n)).otherwise(fill(t[1], "{n}", n)))
    longer = F.concat(F.regexp_replace(query, "？+$", ""), F.lit("，针对“"), title, F.lit("”"), ending)
    return rows.withColumn("__again", again).withColumn(query, F.when(F.col("__again"), longer).otherwise(F.col(query))).drop("__again")


def shuffled(rows: DataFrame, id_col: str, seed: int) -> DataFrame:
    """A fixed order that looks random: ``position`` from 0 by a digest of the seed and the id. The digest's first three
    digits deal the rows in 4096 buckets, so no task sorts the whole set.
    """
    digest = F.sha1(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    dealt = _with_offsets(rows.withColumn("__d", digest), F.substring("__d", 1, 3), ["__d", id_col], "position")
    return dealt.withColumn("position", F.col("position") - 1).drop("__d")


def cyclic_batches(ordered: DataFrame, batches: int, size: int) -> DataFrame:
    """Batches of ``size`` rows of a set ordered by ``position``, that start again at its head when it ends."""
    spark = ordered.sparkSession
    total = ordered.agg(F.count("*").alias("total"))
    slots = spark.range(batches * size).select(F.col("id").alias("slot")).crossJoin(F.broadcast(total)).where("total > 0")  # one row
    slots = slots.select((F.col("slot") / size).cast("long").alias("batch"), (F.col("slot") % size).alias("place"), F.pmod("slot", "total").cast("int").alias("position"))
    return slots.join(ordered, "position")


def questions_per_call(call: Column, per_call: int, total: int) -> Column:
    """How many questions the ``call``-th call asks for: at most ``per_call``, and no more than are left."""
    return F.greatest(F.lit(0), F.least(F.lit(per_call), F.lit(total) - (call - 1) * per_call))


def linked_docids(proposed: Column, batch: Column, fallback: Column) -> Column:
    """The first three proposed ids that are of the batch, else the fallback alone."""
    own = F.slice(F.filter(proposed, lambda x: F.array_contains(batch, x)), 1, 3)
    return F.when(F.size(own) > 0, own).otherwise(F.array(fallback))


#: What marks a generated case.
CASE_TAGS = ("auto_generated", "need_human_review", "docid_labeled", "question_only")


def generated_cases(docs: DataFrame, total: int, seed: int = 42, docs_per_call: int = 5, per_call: int = 30, ask: Callable[[int, list[dict]], list[dict]] | None = None, model: str = "") -> tuple[DataFrame, DataFrame]:
    """``total`` question cases on documents (docid, title, url, snippet), and the counters of their calls.

    A call shows a model a few documents of a fixed shuffle and asks for questions: ``ask(count, documents)`` gives rows
    (query, difficulty, source_docids), is tried twice, and may fail; templates then make the call's questions. Calls are
    rows of a table and run in parallel, so each asks for its full share, and numbers are given afterwards in order.
    Returns (case_id, query, expected_docids, difficulty, dataset_type, tags, metadata), and one row (llm_success, fallback).
    """
    if total <= 0 or docs_per_call <= 0 or per_call <= 0:
        raise ValueError("counts must be positive")
    calls = -(-total // per_call)
    payload = F.struct("docid", "title", "url", "snippet")
    placed = cyclic_batches(shuffled(docs, "docid", seed), calls, docs_per_call)
    batches = placed.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", payload.alias("d")))).alias("ds"))
    batches = batches.select("batch", F.transform("ds", lambda x: x["d"]).alias("documents"), questions_per_call(F.col("batch") + 1, per_call, total).alias("wanted"))
    item = "struct<query:string,difficulty:string,source_docids:array<string>>"

    @F.pandas_udf(f"array<{item}>")
    def asked(documents: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(shown, count):
            own = [dict(d) for d in shown]
            for _ in range(2):
                try:
                    found = [x for x in ask(int(count), own) if isinstance(x, dict)]
                except Exception:  # noqa: BLE001 - a model's failure must not lose the call
                    continue
                if found:
                    ids = lambda v: [v] if isinstance(v, str) else [x for x in v or [] if isinstance(x, str)]
                    return [{"query": str(x.get("query") or ""), "difficulty": str(x.get("difficulty") or ""), "source_docids": ids(x.get("source_docids"))} for x in found[: int(count)]]
            return []

        return pd.Series([one(d, n) for d, n in zip(documents, wanted)], dtype=object)

    got = batches.withColumn("items", asked("documents", "wanted") if ask else F.array().cast(f"array<{item}>"))
    got = got.withColumn("llm", F.size("items") > 0)
    blank = F.transform(F.sequence(F.lit(1), F.greatest(F.col("wanted"), F.lit(1))), lambda _: F.lit(None).cast(item))
    rows = got.where("wanted > 0").select("batch", "documents", "llm", F.posexplode(F.when(F.col("llm"), F.col("items")).otherwise(blank)).alias("place", "item"))
    before = got.groupBy("batch").agg(F.sum(F.when(F.col("llm"), F.size("items")).otherwise(F.col("wanted"))).alias("made"))
    before = before.select("batch", (F.sum("made").over(Window.orderBy("batch")) - F.col("made")).alias("before"))  # a row a call
    rows = rows.join(F.broadcast(before), "batch").withColumn("n", (F.col("before") + F.col("place") + 1).cast("int")).where(F.col("n") <= total)
    known = F.transform("documents", lambda d: d["docid"])
    choice = F.pmod(F.xxhash64(F.lit(seed), "n"), F.size("documents")).cast("int")
    rows = rows.withColumn("docids", linked_docids(F.coalesce(F.col("item.source_docids"), F.array().cast("array<string>")), known, F.get(known, choice)))
    meta = lambda c: F.transform("docids", lambda x: F.coalesce(F.get(F.filter("documents", lambda d: d["docid"] == x), 0)[c], F.lit("")))
    rows = rows.withColumn("titles", meta("title")).withColumn("addresses", meta("url"))
    rows = rows.withColumn("difficulty", tx.normalize_difficulty(F.col("item.difficulty"), F.col("n"), F.lit(total)))
    title = F.coalesce(F.get("titles", 0), F.lit(""))
    query = tx.normalize_query(F.coalesce(F.col("item.query"), F.lit("")))
    template = template_question(title, F.col("difficulty"), F.xxhash64(F.lit(seed), "n", F.lit(1)))
    rows = rows.withColumn("query", F.when((tx.stripped(F.coalesce(F.col("item.query"), F.lit(""))) == "") | tx.is_weak_question(query), tx.normalize_query(template)).otherwise(query))
    rows = diversified(rows.withColumn("title", title), "query", F.col("title"), "difficulty", "n")
    facts = F.struct(
        F.lit("pending").alias("review_status"),
        F.col("docids").alias("source_docids"),
        F.col("titles").alias("source_titles"),
        F.col("addresses").alias("source_urls"),
        F.lit(model).alias("embedding_model"),
        F.lit("llm_question_only").alias("generation_mode"),
        F.when(F.col("llm"), "llm").otherwise("fallback").alias("generation_source"),
    )
    cases = rows.select(F.concat(F.lit("auto_q_"), F.col("n")).alias("case_id"), "query", F.col("docids").alias("expected_docids"), "difficulty", F.lit("qa").alias("dataset_type"), F.array(*map(F.lit, CASE_TAGS)).alias("tags"), facts.alias("metadata"))
    return cases, got.where("wanted > 0").agg(F.count_if("llm").alias("llm_success"), F.count_if(~F.col("llm")).alias("fallback"))
